"""Secret scans: patterns, and a randomness test battery over long tokens.

The battery's null hypothesis is that a token is made by people: words,
identifiers, numbers.  Three tests look at each token, by the encoding inferred
from its characters:

* chi-squared: how near the counts of the alphabet's characters are to uniform,
  against the non-central distribution that letter frequencies of prose give;
* runs: how often the character class changes, against identifiers, in which a
  class lasts for several characters;
* serial correlation: how little a vowel tells of the next character, against
  the alternation of vowels and consonants in words.

The sum of their normal scores is no normal score, as the tests depend on each
other; its distribution under the null is simulated for each encoding and length
with tokens made of words, dates, counters and the like, and its lower tail
carried on by an exponential.  So a token's p-value is uniform for such tokens.
Over all tokens of all documents a weighted Benjamini-Hochberg procedure controls
the false-discovery rate; a token's weight is its information content, so that
long tokens, which the tests can tell apart, get more of the error budget than
short ones.  Its threshold comes from a histogram of p-values, whose size is fixed.

Tokens of digits alone are not tested: nothing tells a random number from an
account's.  UUIDs in their usual form name things and are left alone.

Defined cases: a null or empty text has no spans; texts of any length are read
whole; repeated rows are scanned alike; equal p-values are all discoveries or
none; an empty table gives no rows; further columns are ignored by
scan_secrets() and kept by redact_secrets().
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Located, broadcast_if_few, on_path, pick, shared_table

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Every match of access and hex lies in such a run, and so does every tested token.
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PART = re.compile(r"[A-Za-z0-9]{20,}")
VOWELS = frozenset("aeiouyAEIOUY")

UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: What prose and identifiers are like: sum of squared letter frequencies, share of class changes, share of vowels in letters, their correlation.
PROSE_MATCH, CLASS_CHANGE, VOWEL_SHARE, VOWEL_CORRELATION = 0.066, 0.35, 0.4, -0.35
#: What the simulated null makes names of, and the words among these letters that hex numbers can spell.
PEOPLE_WORDS = (
    "account address amount archive average backup bereich bericht branch buffer button cache campo canal client color commande compte config "
    "contact content counter country customer data datei default delete digest document drucker entry error escuela event example export factura "
    "feature field file filter format frage function gebiet gruppe header history house image import index input invoice item jardin kunde label "
    "länge letter level liste logger maison manager mensaje message model module monitor nachricht name nombre number object order output page "
    "parent pedido period person prefix product profile project quelle query range record region report request response result review route "
    "schema school search server service session setting source status street string system table target template test ticket titre trabajo "
    "update upload user value vehicle version view ville window worker zahlung"
).split()
HEX_WORDS = "ace add bad bed bee cab cafe dead deaf decade face facade fade fed feed".split()
#: Simulated tokens for each encoding and length, and the share of them that the tail is fitted to.
SIMULATED, TAIL, LONGEST = 2000, 0.05, 64
BIN = 0.01


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping per kind, in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in LONG.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text, run.start(), run.end())]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def encoding_of(token: str) -> tuple[str, int]:
    """The encoding that a token's characters suggest, and the size of its alphabet."""
    lower, upper, digit = (any(map(f, token)) for f in (str.islower, str.isupper, str.isdigit))
    if re.search(r"[^A-Za-z0-9]", token):
        return "base64", 64
    if digit and not (lower and upper) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return ("hex", 16) if lower or upper else ("decimal", 10)
    if lower + upper + digit == 1:
        return "letters", 26
    if upper and digit and not lower and re.fullmatch(r"[A-Z2-7]+", token):
        return "base32", 32
    return ("base62", 62) if lower and upper else ("base36", 36)


def scores(token: str) -> tuple[float, float, float]:
    """Scores of the three tests; the lower, the less the token is like text."""
    n, (kind, m) = len(token), encoding_of(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    chi = m / n * sum(v * v for v in counts.values()) - n
    match = max(PROSE_MATCH, 1.6 / m)
    shift = n * (m * match - 1)
    uniform = (chi - (m - 1) - shift) / math.sqrt(2 * (m - 1 + 2 * shift))
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    usual = CLASS_CHANGE if kind in ("base62", "base64") else 0.6 * CLASS_CHANGE
    runs = ((n - 1) * usual - changes + 0.5) / math.sqrt((n - 1) * usual * (1 - usual))
    vowels = [c in VOWELS for c in token]
    p = sum(vowels) / n if kind == "hex" else VOWEL_SHARE * sum(map(str.isalpha, token)) / n  # the null's share
    spread = p * (1 - p)
    serial = 0.0
    if spread:
        r = sum((a - p) * (b - p) for a, b in zip(vowels, vowels[1:])) / ((n - 1) * spread)
        serial = (VOWEL_CORRELATION - r) * math.sqrt(n - 1) / 2
    return uniform, runs, serial


def _number(rng: random.Random, digits: str) -> str:
    n = rng.choice((1, 2, 2, 3, 4, 4, 4, 6, 8))
    if n in (4, 8) and digits == "0123456789":  # a year or a date
        return f"{rng.choice((19, 20))}{rng.randrange(100):02}" + (f"{rng.randrange(1, 13):02}{rng.randrange(1, 29):02}" if n == 8 else "")
    return "".join(rng.choices(digits, k=n))


def made_by_people(rng: random.Random, kind: str, n: int) -> str:
    """A token of the null hypothesis: n characters of an encoding, put together as people do."""
    while True:
        parts: list[str] = []
        upper, style = rng.random() < 0.3, rng.randrange(3)
        often = rng.choice((0.05, 0.15, 0.3)) if kind != "letters" else 0.0
        digits = "234567" if kind == "base32" else "0123456789"
        while sum(map(len, parts)) < n:
            if kind == "hex":
                word = rng.choice((rng.choice(HEX_WORDS), _number(rng, digits), "0" * rng.randrange(1, 9), rng.choice("0123456789abcdef") * rng.randrange(2, 7), _number(rng, digits)))
                parts.append(word.upper() if upper else word)
                continue
            if rng.random() < often:
                parts.append(_number(rng, digits))
                continue
            word = rng.choice(PEOPLE_WORDS).replace("ä", "ae")
            if kind in ("base62", "base64") and style:
                word = word.title() if style == 1 or parts else word
            elif kind == "base32" or upper and kind in ("letters", "base36", "base64"):
                word = word.upper()
            parts.append(word)
            if kind == "base64":
                parts.append(rng.choice("-_/") if style == 0 or rng.random() < 0.5 else "")
        if kind != "letters" and kind != "hex" and kind != "base64" and not any(map(str.isdigit, "".join(parts)[:n])):
            parts.insert(rng.randrange(max(1, len(parts) // 2)), _number(rng, digits))
        token = "".join(parts)[:n]
        if encoding_of(token)[0] == kind:
            return token


@functools.lru_cache(maxsize=1024)
def null_sums(kind: str, n: int) -> tuple[list[float], float]:
    """Sorted sums of scores of simulated tokens, and the mean depth of their lower tail."""
    rng = random.Random(f"{kind} {n}")
    sums = sorted(sum(scores(made_by_people(rng, kind, n))) for _ in range(SIMULATED))
    k = int(TAIL * SIMULATED)
    return sums, sum(sums[k] - x for x in sums[:k]) / k


def p_value(token: str) -> float:
    """How probable a sum of scores as low as the token's is for tokens made by people."""
    sums, depth = null_sums(encoding_of(token)[0], min(len(token), LONGEST))
    s, edge = sum(scores(token)), sums[int(TAIL * SIMULATED)]
    if s >= edge:
        return min(1.0, bisect_right(sums, s) / SIMULATED)
    return max(TAIL * math.exp(-(edge - s) / depth), 1e-30)


def tested_tokens(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, float, float]]:
    """(start, end, p, weight) of the long tokens that no pattern has found."""
    out = []
    for run in LONG.finditer(text):
        whole = run.group()
        if UUID.fullmatch(whole):
            continue
        mixed = any(map(str.islower, whole)) and any(map(str.isupper, whole)) and any(map(str.isdigit, whole))
        words = max(map(len, re.split(r"[-_/+=]", whole))) < 12
        places = [run.span()] if mixed and not words else [m.span() for m in PART.finditer(text, *run.span())]
        for start, end in places:
            token = text[start:end].rstrip("=")
            if len(token) < 20 or any(start < e and s < end for s, e, _ in taken):
                continue
            kind, m = encoding_of(token)
            if kind != "decimal":
                out.append((start, end, p_value(token), len(token) * math.log2(m)))
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
TESTED = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("weight", pa.float64())])
FOUND = pa.struct([("base", pa.list_(SPAN)), ("tested", pa.list_(TESTED))])


FOUND_DDL = "base array<struct<start int, end int, kind string>>, tested array<struct<start int, end int, p double, weight double>>"


def _find_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = []
        for value in batch:
            text = value.as_py() or ""
            base = base_spans(text)
            rows.append(
                {
                    "base": [{"start": s, "end": e, "kind": k} for s, e, k in base],
                    "tested": [dict(zip(("start", "end", "p", "weight"), t)) for t in tested_tokens(text, base)],
                }
            )
        yield pa.array(rows, FOUND)


def _find(text: str) -> Column:
    return F.arrow_udf(_find_batches, FOUND_DDL)(text)


def _bin(p: Column, weight: Column, mean_weight: float) -> Column:
    return F.floor(-F.log10(F.least(p * mean_weight / weight, F.lit(1.0))) / BIN).cast("long")


def discovery_threshold(tested: DataFrame, rate: float) -> tuple[int, float]:
    """The least bin of weighted p-values whose expected share of false discoveries is at most ``rate``.

    tested has p and weight, one row per token.  Two sums and a histogram of at
    most 3,300 bins come to the driver.
    """
    total = tested.agg(F.count("*").alias("n"), F.avg("weight").alias("w")).first()
    if not total["n"]:
        return 1 << 40, 1.0
    bins = tested.groupBy(_bin(F.col("p"), F.col("weight"), total["w"]).alias("bin")).count().collect()
    best, above = 1 << 40, 0
    for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
        above += n
        if total["n"] * 10 ** (-b * BIN) / above <= rate:
            best = b
    return best, total["w"]


def _spans(found: DataFrame, rate: float) -> DataFrame:
    """found with all: base spans and discoveries, as one ordered array."""
    least, mean = discovery_threshold(found.select(F.inline("found.tested")), rate)
    hits = F.filter("found.tested", lambda t: _bin(t["p"], t["weight"], mean) >= least)
    tokens = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("token").alias("kind")))
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.transform(F.concat("found.base", tokens), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.withColumn("all", F.array_sort(keyed))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(df: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, base and spans, arrays of (start, end, kind).

    Spans count code points, end exclusive, in order of start, then kind.  What
    the texts hold is found once and kept in a shared table of spans; the texts
    are not moved.
    """
    on_path(df.sparkSession)
    found = shared_table(pick(df, "doc_id", "text").select("doc_id", _find("text").alias("found")), "secrets")
    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return _spans(found, rate).select("doc_id", F.col("found.base").alias("base"), plain("all").alias("spans"))


def digest_spans(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
    )


def _mask_batches(mask: str):
    def cover(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for value, found in zip(texts, spans):
                text, parts, at = value.as_py(), [], 0
                if text is not None:
                    for s in sorted((s["start"], s["end"]) for s in found.as_py()):
                        if s[0] >= at:
                            parts += [text[at : s[0]], mask]
                        at = max(at, s[1])
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.array(out, pa.string())

    return cover


def redact_secrets(df: DataFrame, rate: float = 0.01, mask: str = "[SECRET]") -> DataFrame:
    """df with every found span in text replaced by ``mask``, overlapping spans by one.

    n_chars, if df has it, follows where the text changes.  The texts are scanned
    once; what was found is kept with the rows' places, for rows in which
    something was, and joined to a second pass, in which only texts to change go
    to Python.  Texts are not moved, unless more rows change than may be broadcast.
    """
    on_path(df.sparkSession)
    own = Located(df)
    name = own.place("text")
    found = own.df.select("_file", "_row", _find(name).alias("found")).where("size(found.base) > 0 or size(found.tested) > 0")
    found = shared_table(found, "secrets")
    spans = _spans(found, rate).select("_file", "_row", F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    spans = shared_table(spans.where(F.size("spans") > 0), "secret-spans")
    rows = own.df.join(broadcast_if_few(spans), ["_file", "_row"], "left")
    changed = F.col("spans").isNotNull()
    new = F.arrow_udf(_mask_batches(mask), "string")(F.when(changed, F.col(name)), F.col("spans"))
    out = rows.withColumn("_new", new).withColumn(name, F.when(changed, F.col("_new")).otherwise(F.col(name)))
    if "n_chars" in own.names:
        count = own.place("n_chars")
        out = out.withColumn(count, F.when(changed, F.length("_new").cast("long")).otherwise(F.col(count)))
    return own.restore(out)
