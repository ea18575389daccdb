import math
import random
import string
import zlib

from splitbench.llm import langid


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_prediction_sees_only_the_text(spark, odd):
    from pyspark.sql import functions as F

    model = langid.train(odd.where(~langid.held_out(F.col("doc_id"))))
    said = {r.text: model.predict(r.text) for r in odd.collect()}
    out = langid.identify_languages(odd).join(odd.select("doc_id", "text").where("doc_id is not null").distinct(), "doc_id")
    assert all((r.lang_pred, r.score) == said[r.text] for r in out.collect())


def test_odd_rows(spark, odd, empty, clashing):
    rows = {r.doc_id: r for r in langid.identify_languages(odd).collect()}
    assert [rows[i].lang_pred for i in (100, 101, 102, 106)] == ["und"] * 4 and rows[100].score == 0
    assert rows[105].lang_pred == "de" and rows[103].lang_pred in ("en", "de", "fr", "es", "xx")
    assert langid.identify_languages(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    kept = langid.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == 12


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify_languages(df).first().lang_pred == "und"
    one = spark.createDataFrame([(i, "some words", "en") for i in range(5)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_languages(one).collect()} == {"en"}


def test_families():
    assert langid.FAMILY_OF["de"] == langid.FAMILY_OF["en"] != langid.FAMILY_OF["fr"] == langid.FAMILY_OF["es"]


def slow_predict(model, text):
    """The prediction from scratch: counts by dictionary, one sum at a time."""
    letters = [b if b >= 0x80 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode("utf-8", "replace")]
    kept = [b for i, b in enumerate(letters) if not i or b != 32 or letters[i - 1] != 32]
    counts = {}
    for n, factor in ((2, 2654435761), (3, 2246822519)):
        for i in range(len(kept) - n + 1):
            code = int.from_bytes(bytes(kept[i : i + n])) * factor % 2**32 >> 20
            counts[code] = counts.get(code, 0) + 1
    length = math.sqrt(sum(counts.values()))
    margin = lambda w: sum(float(w[c]) * math.sqrt(n) / length for c, n in counts.items()) + float(w[-1])
    sure = lambda x: 1 / (1 + math.exp(-3 * max(-10, min(10, x))))
    family = max(sorted(model.families), key=lambda f: margin(model.family_weights[f]))
    langs, votes = model.families[family], {}
    for a in langs:
        p = [sure(margin(model.pair_weights[a, b])) if (a, b) in model.pair_weights else 1 - sure(margin(model.pair_weights[b, a])) for b in langs if b != a]
        votes[a] = sum(p) / len(p) if p else 1.0
    best = max(langs, key=votes.get)
    return best, sure(margin(model.family_weights[family])) * votes[best]


def test_predictions_match_a_slow_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df)
    for r in df.where("text is not null").orderBy("doc_id").limit(60).collect():
        if langid.has_letter(r.text):
            lang, score = slow_predict(model, r.text)
            got = model.predict(r.text)
            assert got[0] == lang and abs(got[1] - score) < 1e-4


def test_most_texts_of_no_learnt_language_go(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(2)
    junk = ["".join(rng.choices(string.ascii_lowercase + "    ", k=400)) for _ in range(100)]
    junk += [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(40)) for _ in range(100)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    ]
    more = spark.createDataFrame([(-i - 1, t, None) for i, t in enumerate(junk + other)], "doc_id long, text string, lang string")
    kept = langid.keep_identified(df.unionByName(more))
    assert kept.where("doc_id < 0").count() <= 22  # most go; the cut is low enough to keep every clean text
    assert kept.where((F.col("doc_id") >= 0) & F.col("lang").isNotNull()).count() == df.where("lang is not null and text rlike '\\\\p{L}'").count()


def test_equal_votes_go_to_the_first_by_name():
    import numpy as np

    flat = np.zeros(langid.WIDTH + 1, np.float32)
    model = langid.LanguageModel({"germanic": ["de", "en"], "romance": ["es"]}, {"germanic": flat, "romance": flat}, {("de", "en"): flat})
    assert model.predict("some text") == ("de", 0.25)
