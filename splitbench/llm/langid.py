"""Language identification in two steps: the family, then its closely related languages.

A text becomes hashed byte bigrams and trigrams of its letters, square roots of
counts, scaled to length one.  One linear support vector machine per family
against the rest picks the family; inside it, one machine for each pair of
languages votes.  The machines are fitted on the driver on a bounded sample of
labelled rows; prediction reads nothing but the text.

The score is how sure the winning machines are, each by itself: the family's
against all else, times the language's mean over its pairs.  It does not depend
on how many families there are, and it is low for text of no learnt language,
which no machine claims.

Defined cases: a null text or one without a letter is ``und`` with score 0; if
nothing can be learnt, every text is ``und``; texts of any length are read
whole; repeated rows get equal predictions; a language not in the family table
is a family of its own; of equal votes or margins the first language or family
by name wins; an empty table gives no rows; further columns are
ignored by identify_languages() and kept by keep_identified().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbered, crc_mod, on_path, pick

WIDTH = 4096
UNKNOWN = "und"
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Bytes of letters stay (UTF-8 above 0x7f included), all else is a space.
_LETTER = np.array([b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def features(text: str, width: int = WIDTH) -> np.ndarray:
    a = _LETTER[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    codes = np.concatenate([two * np.uint32(2654435761), three * np.uint32(2246822519)]) >> np.uint32(32 - width.bit_length() + 1)
    x = np.sqrt(np.bincount(codes, minlength=width)).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def fit_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, c: float = 4.0, passes: int = 15) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, by dual coordinate descent.

    x has the bias as its last column and is not copied; only ``rows`` of it are
    used, if given.  y is +1 or -1 for each of these; each class's cost is scaled
    so that both weigh the same.
    """
    rows = np.arange(len(x)) if rows is None else rows
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = share / c  # 1 / (2 C) with C = c / (2 share)
    q = np.array([(x[r] * x[r]).sum() for r in rows]) + slack
    w, alpha, rng = np.zeros(x.shape[1], np.float64), np.zeros(len(rows)), np.random.default_rng(11)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            step = max(alpha[i] - (y[i] * (own @ w) - 1 + alpha[i] * slack[i]) / q[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * own
    return w.astype(np.float32)


def _likely(margin: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-3.0 * np.clip(margin, -10, 10)))


#: Below this score a text is taken for one of no learnt language.  Clean texts come first: of 50,541 labelled test
#: texts of 60 characters and more 2 have less, both of two languages, and about five in six texts of random letters.
LEAST = 0.45
#: Texts of fewer characters tell less; for them the least score falls in proportion.
SHORT = 60


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    family_weights: dict[str, np.ndarray]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = np.append(features(text), np.float32(1))
        names = sorted(self.families)
        odds = np.array([_likely(self.family_weights[f] @ x) for f in names]) if len(names) > 1 else np.ones(1)
        at = int(odds.argmax())
        langs, sure = self.families[names[at]], float(odds[at])
        wins = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            p = float(_likely(self.pair_weights[a, b] @ x))
            wins[a] += p
            wins[b] += 1 - p
        best = max(langs, key=lambda s: wins[s])
        return best, sure * (wins[best] / (len(langs) - 1) if len(langs) > 1 else 1.0)


def fit(x: np.ndarray, lang: list[str]) -> LanguageModel:
    """The machines for rows x, bias last, and their languages."""
    langs = np.array(lang)
    families: dict[str, list[str]] = {}
    for s in sorted(set(lang)):
        families.setdefault(FAMILY_OF.get(s, f"only {s}"), []).append(s)
    side = lambda rows: np.where(rows, 1.0, -1.0)
    family_weights = {f: fit_svm(x, side(np.isin(langs, members))) for f, members in families.items()} if len(families) > 1 else {}
    pairs = {}
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = np.flatnonzero(np.isin(langs, (a, b)))
            pairs[a, b] = fit_svm(x, side(langs[rows] == a), rows)
    return LanguageModel(families, family_weights, pairs)


def _snippet(text: str) -> str:
    """A few words from the middle of a text, so that the machines also know short texts."""
    middle = len(text) // 2
    return text[middle : middle + 60]


def _training_rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Features of a text, then of its snippet: the places of those that are not zero, and their values."""
    for batch in texts:
        both = [np.concatenate((features(t), features(_snippet(t)))) for t in (v.as_py() for v in batch)]
        places = [np.flatnonzero(b).astype(np.uint16) for b in both]
        columns = [[p.tobytes() for p in places], [b[p].tobytes() for b, p in zip(both, places)]]
        yield pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in columns], ["at", "value"])


def train(labelled: DataFrame, sample_rows: int = 1600) -> LanguageModel:
    """Fit on at most ``sample_rows`` of the rows (doc_id, text, lang), as many of each language, 8 at least.

    The sample is by hash of id and length, then id and text, so it does not
    depend on the rows' order; only features of the sample reach the driver,
    which holds them once (32 KB a sample row).
    """
    rows = labelled.where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["count"] for r in labelled.where("lang is not null and text is not null").groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel({}, {}, {})
    each = max(8, sample_rows // len(counts))
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < int(min(1.0, 1.3 * each / n) * (1 << 30))))
    # Rows that repeat id and text are one row of the sample, however many they are.
    sample = rows.withColumn("place", place).where(wanted).groupBy("lang", "place", "doc_id", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text"))
    first = sample.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "hash"))).where(F.col("nth") <= each)
    found = first.select("lang", "nth", F.arrow_udf(_training_rows, "at binary, value binary")("text").alias("x")).collect()
    found.sort(key=lambda r: (r["lang"], r["nth"]))
    taken: dict[str, list] = {}
    for r in found:
        taken.setdefault(r["lang"], []).append(r["x"])
    lang = [s for s, own in taken.items() for _ in range(2 * len(own))]
    x = np.zeros((len(lang), WIDTH + 1), np.float32)
    x[:, WIDTH] = 1
    both = np.empty(2 * WIDTH, np.float32)
    for k, sparse in enumerate(v for own in taken.values() for v in own):
        both[:] = 0
        both[np.frombuffer(sparse["at"], np.uint16)] = np.frombuffer(sparse["value"], np.float32)
        x[2 * k : 2 * k + 2, :WIDTH] = both.reshape(2, WIDTH)
    return fit(x, lang)


def predictor(spark: SparkSession, model: LanguageModel):
    """A column function: text to (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            said = [shared.value.predict(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([s for s, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predict, "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 4) == 2


def identify_languages(df: DataFrame, sample_rows: int = 1600) -> DataFrame:
    """One row per row of df (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Rows that are held out are not learnt from.
    """
    spark = on_path(df.sparkSession)
    rows = pick(df, "doc_id", "text", "lang")
    model = train(rows.where(~held_out(F.col("doc_id"))), sample_rows)
    said = predictor(spark, model)(F.col("text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), said.alias("said")).select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_identified(df: DataFrame, least: float = LEAST, sample_rows: int = 1600) -> DataFrame:
    """The rows of df whose language is identified with a score of at least ``least``, with df's own columns.

    For a text of fewer than SHORT characters, the least score is lower in proportion.
    """
    spark = on_path(df.sparkSession)
    rows = pick(df, "doc_id", "text", "lang")
    model = train(rows.where(~held_out(F.col("doc_id"))), sample_rows)
    own = Numbered(df)
    said = own.df.withColumn("_said", predictor(spark, model)(F.col(own.place("text"))))
    asked = F.lit(least) * F.least(F.lit(1.0), F.length(own.place("text")) / SHORT)
    kept = said.where((F.col("_said.lang_pred") != UNKNOWN) & (F.col("_said.score") >= asked))
    return own.restore(kept)
