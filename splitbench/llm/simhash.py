"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions.  Two fingerprints with at
most three differing bits differ in at most three bytes, so they share five
positional bytes or more, and of any seven positions four or more.  Posting
lists of single positional bytes would have a 256th of all fingerprints each, so
the index is kept behind a prefix filter that loses nothing: it has a posting
list for each choice of four of the first seven positions and the bytes there,
and only pairs on one list are tallied.  The tally counts the positional bytes
that a pair shares, out of all eight; pairs below five are dropped, and the rest
verified by counting differing bits.  A pair that meets on several lists is
reported on the first only.  No list is cut short.

Equal fingerprints are one class before any pair is made, so copies cost nothing
and lose no link.  Classes are joined to components by alternating stars.

Defined cases: a null or empty text has fingerprint zero and links like any other
zero; fewer than three words are one shingle; repeated rows are a class; a null
id belongs to its class but is never its smallest id; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Located, broadcast_if_few, on_path, pick, shared_table
from .components import connected_components

NEAR = 3
BYTES = 8
SHARED = BYTES - NEAR
KEY_BYTES = 4
#: Two fingerprints that share SHARED of all positions share KEY_BYTES of these.
POSITIONS = KEY_BYTES + NEAR
KEYS = tuple(combinations(range(POSITIONS), KEY_BYTES))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z fold, and only the six ASCII blanks split
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch), np.uint64, len(batch))
        yield pa.array(prints.view(np.int64))


def fingerprint_of(text: Column | str) -> Column:
    return F.arrow_udf(_fingerprints, "long")(text)


def _byte(x: Column, position: int) -> Column:
    return F.shiftrightunsigned(x, 8 * position).bitwiseAND(255)


def _postings(prints: DataFrame) -> DataFrame:
    """(key, fp): the index; a key is a choice of positions and the bytes at them."""

    def key(k: int, positions: tuple[int, ...]) -> Column:
        parts = [F.shiftleft(_byte(F.col("fp"), p), 8 * i) for i, p in enumerate(positions)]
        value = F.lit(k << 8 * KEY_BYTES).cast("long")
        for part in parts:
            value = value.bitwiseOR(part)
        return value

    return prints.select("fp", F.explode(F.array(*[key(k, p) for k, p in enumerate(KEYS)])).alias("key"))


def _first_key(mask: int) -> int:
    """The first list on which a pair meets that shares the positions in mask; -1 if none."""
    shared = [p for p in range(POSITIONS) if mask >> p & 1]
    return KEYS.index(tuple(shared[:KEY_BYTES])) if len(shared) >= KEY_BYTES else -1


def near_pairs(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints in column fp that differ in at most three bits.

    The fingerprints are dealt out before each becomes 35 postings, and both sides
    of the join read one shuffled index.  The planner takes the index to be as small
    as the fingerprints and would send it to the driver whole, so the join is by
    shuffle at any size.
    """
    if near > NEAR:
        raise ValueError(f"the index guarantees {NEAR} differing bits")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = _postings(prints.repartition(parts, "fp"))
    left, right = index.alias("l"), index.alias("r")
    fp, other, key = F.col("l.fp"), F.col("r.fp"), F.col("l.key")
    apart = fp.bitwiseXOR(other)
    same = [(_byte(apart, p) == 0).cast("int") for p in range(BYTES)]
    tally = sum(same[1:], same[0])
    mask = sum((F.shiftleft(same[p], p) for p in range(1, POSITIONS)), same[0])
    firsts = F.array(*[F.lit(_first_key(m)) for m in range(1 << POSITIONS)])
    met = F.shiftrightunsigned(key, 8 * KEY_BYTES).cast("int") == F.element_at(firsts, mask + 1)
    on = (key == F.col("r.key")) & (fp < other) & (tally >= SHARED) & (F.bit_count(apart) <= near) & met
    return left.join(right.hint("merge"), on).select(fp.alias("a"), other.alias("b"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, fp and component_id, the smallest id linked to it.

    The texts are read once; everything after works on ids and fingerprints.
    """
    on_path(df.sparkSession)
    rows = shared_table(pick(df, "doc_id", "text").select("doc_id", fingerprint_of("text").alias("fp")), "simhash")
    return rows.join(components_of(rows), "fp").select("doc_id", "fp", "component_id")


def components_of(rows: DataFrame) -> DataFrame:
    """(fp, label, component_id) for the distinct fingerprints of rows (doc_id, fp).

    label is a fingerprint that names the component; component_id its smallest
    id, null if none of its rows has one.
    """
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(near_pairs(rows.select("fp").distinct()))
    labelled = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"), F.col("label").isNotNull().alias("linked"))
    labelled = shared_table(labelled, "simhash-classes")
    alone = labelled.where(~F.col("linked")).select("fp", "label", F.col("least").alias("component_id"))
    linked = labelled.where("linked")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    return alone.unionByName(linked.join(least, "label").select("fp", "label", "component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of df without all but one row of each component, df's own columns.

    The row that stays has the smallest id; among equal ids, or where there is
    none, the smallest hash of its text, and of repeated rows one.  The choice is
    made on ids, fingerprints and places; texts are read twice and not moved,
    unless more rows go than may be broadcast.
    """
    on_path(df.sparkSession)
    own = Located(df)
    ident, text = F.col(own.place("doc_id")), F.col(own.place("text"))
    small = shared_table(own.df.select(ident.alias("doc_id"), fingerprint_of(text).alias("fp"), F.xxhash64(text).alias("hash"), "_file", "_row"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("hash"), F.col("_file"), F.col("_row")))
    per_class = small.groupBy("fp").agg(first.alias("best"))
    best = per_class.join(components_of(small), "fp").groupBy("label").agg(F.min("best").alias("best"))
    gone = small.select("_file", "_row").join(best.select("best._file", "best._row"), ["_file", "_row"], "left_anti")
    gone = shared_table(gone, "simhash-gone")
    return own.restore(own.df.join(broadcast_if_few(gone), ["_file", "_row"], "left_anti"))


def digest_components(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
