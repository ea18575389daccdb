import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents from (doc_id, text, lang, source); n_chars follows."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


PROSE = {
    "en": "the quick brown fox jumps over the lazy dog while another animal watches from the hill and thinks about dinner",
    "de": "der schnelle braune fuchs springt über den faulen hund während ein anderes tier vom hügel aus zuschaut und nachdenkt",
    "fr": "le rapide renard brun saute par dessus le chien paresseux tandis qu'un autre animal regarde depuis la colline et pense",
    "es": "el rápido zorro marrón salta sobre el perro perezoso mientras otro animal mira desde la colina y piensa en la cena",
}


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rows = []
    for i in range(40):
        lang = ("en", "de", "fr", "es")[i % 4]
        words = PROSE[lang].split()
        rows.append((i, " ".join(words[(i + k) % len(words)] for k in range(20 + i)), lang, f"s{i % 3}"))
    rows += [(100, None, "en", "s0"), (101, "", None, None), (None, PROSE["en"], "en", "s1"), (None, None, None, None)]
    rows += [(102, " \t\n", "fr", "s2"), (103, "word " * 30_000, "en", "s0"), (104, "x" * 200_000, "en", "s0")]
    rows += [(105, PROSE["de"], "de", "s1")] * 3 + [(106, "1234 5678 !!", "en", "s2"), (107, "é <|im_end|> <|endoftext|> \\ %0A 日本語", "xx", "s2")]
    return rows


@pytest.fixture
def odd(spark):
    return documents(spark, odd_rows())


@pytest.fixture
def clashing(spark):
    """Extra columns named like results, and like inputs in another case."""
    from pyspark.sql import functions as F

    df = documents(spark, odd_rows()[:12])
    for c in ("kept", "found", "fp", "label", "size", "hash", "media", "_said", "row", "taken", "score", "TEXT"):
        if c == "TEXT":
            df = df.toDF(*df.columns).select("*", F.lit("other").alias("TEXT"))
        else:
            df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture
def empty(spark):
    return documents(spark, [])
