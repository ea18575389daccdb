"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition tokenises its documents, cuts the long ones and packs the pieces
by best fit, longest first, a block of pieces at a time; every bin with room is
open until the partition ends.  The open bins then go up a tree as single items:
a node packs the bins of ``FAN`` nodes by best fit again and passes them on.
Only bins move in the tree, each with the places of the bins inside it; pieces
are not moved until a join gives those in merged bins their final place.

Of two bins that fit into one, the smaller is at most half full, and best fit
leaves a partition at most one such bin.  With n of them no fuller than g, at
most n bins with room g are ever filled further, and bins of equal room are as
good as each other: a node reads and passes on n of each room, and the packing
is the one without that limit.

Defined cases: of pieces of equal length the first read is placed first, of bins
with equal room the one that got it last is filled first; a null or empty text is
one piece holding the end id alone;
repeated rows and null ids are documents of their own; texts of any length are
tokenised whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import on_path, pick, shared_table

CAPACITY = 1024
END_ID = 2
BLOCK = 1 << 16
FAN = 8
#: Characters on which the two tokenizer libraries agree by construction: their tables of letters and blanks are the same here.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa0-ɏ]*")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str, ranks_path: str | None = None) -> np.ndarray:
    """The ids of the tokenizer at path, without added special tokens, and the end id.

    ranks_path names the same vocabulary as ranks; it gives the same ids faster,
    and is used for texts of plain characters without a special token's string.
    """
    text = text or ""
    if ranks_path and "<|endoftext|>" not in text and PLAIN.fullmatch(text):
        ids = _ranks(ranks_path).encode_to_numpy(text, disallowed_special=())
    else:
        ids = _tokenizer(path).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, dtype="<u4"), np.uint32(END_ID)).astype("<u4")


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full ones after a shorter first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


class BestFit:
    """Open bins by free room; put() finds the fullest bin that an item fits."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit f: a bin with room f is open

    def add(self, bin_id: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_id)
            self.some |= 1 << free

    def put(self, length: int) -> tuple[int, int] | None:
        """(bin, offset) for an item, or None if no open bin has room for it."""
        fits = self.some >> length
        if not fits:
            return None
        free = length + (fits & -fits).bit_length() - 1
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.some ^= 1 << free
        self.add(bin_id, free - length)
        return bin_id, self.capacity - free

    def bins(self) -> Iterator[tuple[int, int]]:
        for free, held in enumerate(self.by_free):
            for bin_id in held:
                yield bin_id, free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, node long"
#: In the table of pieces, a row with this piece number is an open bin; its length is the bin's filling.
OPEN_BIN = -1


def _packer(path: str, ranks_path: str | None, capacity: int):
    names = [f.split()[0] for f in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32() if n == "piece" else pa.int64() for n in names]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        next_bin = node << 33
        fit, held = BestFit(capacity), []

        def place() -> pa.RecordBatch:
            nonlocal next_bin, held
            rows = []
            for length, doc_id, piece, start, crc in sorted(held, key=lambda h: -h[0]):
                at = fit.put(length)
                if at is None:
                    at, next_bin = (next_bin, 0), next_bin + 1
                    fit.add(at[0], capacity - length)
                rows.append((doc_id, piece, start, length, crc, *at, node))
            held = []
            return batch(rows)

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                ids = token_ids(text.as_py(), path, ranks_path)
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    held.append((length, doc_id.as_py(), piece, start, zlib.crc32(ids[start : start + length].tobytes())))
            if len(held) >= BLOCK:
                yield place()
        yield place()
        bins = fit.bins()
        while rows := [(None, OPEN_BIN, 0, capacity - free, 0, bin_id, 0, node) for bin_id, free in itertools.islice(bins, BLOCK)]:
            yield batch(rows)

    return pack


MERGED = "node long, bin long, fill long, inside array<struct<bin:long,base:long>>, open boolean"


def _merger(capacity: int, needed: list[int]):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best fit of a node's bins, fullest first."""
        fit, inside, fill = BestFit(capacity), {}, {}
        for node, bin_id, size, held in sorted(zip(pdf["node"], pdf["bin"], pdf["fill"], pdf["inside"]), key=lambda r: (-r[2], r[1])):
            held = [(h["bin"], h["base"]) for h in held]
            at = fit.put(size)
            if at is None:
                inside[bin_id], fill[bin_id] = held, size
                fit.add(bin_id, capacity - size)
            else:
                into, base = at
                inside[into] += [(b, base + o) for b, o in held]
                fill[into] += size
        still = {b for free, held in enumerate(fit.by_free) for b in held[: needed[free]]}
        node = int(pdf["node"].iloc[0])
        rows = [(node, b, fill[b], [{"bin": x, "base": o} for x, o in held], b in still) for b, held in inside.items()]
        return pd.DataFrame(rows, columns=["node", "bin", "fill", "inside", "open"])

    return merge


def pack_documents(
    df: DataFrame,
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    df has doc_id and text.  Without paths the 50k byte-level vocabulary is used.
    The packed pieces are written once; a rerun of a task therefore cannot give a
    piece another bin than the tree has seen.
    """
    on_path(df.sparkSession)
    if tokenizer_path is None:
        tokenizer_path, ranks_path = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    rows = pick(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # A partition is a node, so partitions may not be joined once they are packed.
    table = shared_table(rows.mapInArrow(_packer(tokenizer_path, ranks_path, capacity), PIECES), "pieces", as_is=True)
    pieces = table.where(F.col("piece") != OPEN_BIN)
    moved = merge_tree(table.where(F.col("piece") == OPEN_BIN).select("node", "bin", F.col("length").alias("fill")), capacity)
    return pieces.join(moved, "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def merge_tree(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bin, sequence_id, base) for the bins (node, bin, fill) that end inside another bin."""
    counts = {r["fill"]: r["count"] for r in bins.where(F.col("fill") <= capacity // 2).groupBy("fill").count().collect()}
    # By room: how many bins are small enough for it, and so how many bins of that room can be of use.
    needed = list(itertools.accumulate(counts.get(g, 0) for g in range(capacity + 1)))
    alike = F.row_number().over(Window.partitionBy("node", "fill").orderBy("bin"))
    bins = bins.withColumn("nth", alike).where(F.col("nth") <= F.element_at(F.lit(needed), (capacity - F.col("fill") + 1).cast("int"))).drop("nth")
    state = bins.withColumn("inside", F.array(F.struct(F.col("bin"), F.lit(0).cast("long").alias("base"))))
    last = bins.agg(F.max("node").alias("n")).first()["n"] or 0
    done = []
    while True:
        last //= FAN
        up = state.select(F.expr(f"node div {FAN}").alias("node"), "bin", "fill", "inside")
        level = shared_table(up.groupBy("node").applyInPandas(_merger(capacity, needed), MERGED), "bins")
        done.append(level.where("not open") if last else level)
        if not last:
            break
        state = level.where("open")
    final = functools.reduce(DataFrame.unionByName, done).where(F.size("inside") > 1)
    return final.select(F.col("bin").alias("sequence_id"), F.inline("inside")).where("bin <> sequence_id")
