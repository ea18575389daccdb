import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitbench.llm import packing

from .conftest import documents

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_give_the_same_ids(text):
    slow = packing.token_ids(text, JSON)
    assert slow.tolist() == packing.token_ids(text, JSON, RANKS).tolist()
    assert slow.tolist() == packing._tokenizer(JSON).encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)]], max_size=120))
def test_plain_characters_take_the_fast_way_to_the_same_ids(text):
    assert packing.token_ids(text, JSON).tolist() == packing.token_ids(text, JSON, RANKS).tolist()


def test_special_strings():
    text = "a <|endoftext|> b"
    assert packing.token_ids(text, JSON, RANKS).tolist() == packing._tokenizer(JSON).encode(text, add_special_tokens=False).ids + [2]


@given(st.integers(1, 10_000))
def test_cuts(n):
    cuts = packing.cut_points(n)
    assert sum(length for _, length in cuts) == n and cuts[0][0] == 0
    assert all(length == 1024 for _, length in cuts[1:]) and all(a + length == b for (a, length), (b, _) in zip(cuts, cuts[1:]))


@given(st.lists(st.integers(1, 1024), max_size=200))
def test_best_fit_never_overfills(lengths):
    fit, fill = packing.BestFit(), {}
    for i, n in enumerate(sorted(lengths, reverse=True)):
        at = fit.put(n)
        if at is None:
            assert all(1024 - f < n for f in fill.values())
            fill[i] = n
            fit.add(i, 1024 - n)
        else:
            assert at[1] == fill[at[0]]
            # No other open bin would have been left with less room.
            assert not any(fill[at[0]] < f <= 1024 - n for f in fill.values())
            fill[at[0]] += n
    assert all(f <= 1024 for f in fill.values())


def check(df, packed):
    rows = packed.collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(packing.token_ids(r.text, JSON))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in texts.items():
        assert sorted((r.piece, r.start, r.length) for r in by_doc[doc]) == sorted((i, *c) for x in ids for i, c in enumerate(packing.cut_points(len(x))))
        assert all(any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids) for r in by_doc[doc])
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by_sequence), -(-sum(r.length for r in rows) // 1024)


def test_every_token_has_one_place(spark, odd):
    check(odd, packing.pack_documents(odd))


def test_few_sequences_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a " * int(n), "en", "s") for i, n in enumerate(rng.integers(1, 1500, 3000))]
    used, least = check(df := documents(spark, rows).repartition(30, "doc_id"), packing.pack_documents(df))
    assert used <= 1.03 * least


def test_tree_merges_small_bins(spark):
    bins = spark.createDataFrame([(n, n, 100) for n in range(100)], "node long, bin long, fill long")
    moved = packing.merge_tree(bins).collect()
    left = {n for n in range(100)} - {r.bin for r in moved}
    # A node holds eight bins of 100, and two such nodes no longer fit one bin.
    assert len(left) == 13 and all(r.base % 100 == 0 and r.base < 800 for r in moved)


def test_lengths_in_file_order_fill_the_bins_of_earlier_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1000)
    text = {n: "a" + " a" * (n - 2) for n in (600, 400, 20)}
    assert all(len(packing.token_ids(t, JSON, RANKS)) == n for n, t in text.items())
    rows = [(i, text[(600, 400, 20)[i // 2000]], "en", "s") for i in range(6000)]
    used, _ = check(df := documents(spark, rows).coalesce(1), packing.pack_documents(df))
    # One 600, one 400 and one 20 in each, as without a limit on open bins.
    assert used == 2000


def test_tree_equals_one_that_passes_on_every_bin(spark):
    def uncut(bins):
        state, last = {}, max(n for n, _, _ in bins)
        for node, b, fill in bins:
            state.setdefault(node, []).append((fill, b))
        while True:
            up = {}
            for node, held in state.items():
                up.setdefault(node // packing.FAN, []).extend(held)
            state, last = {}, last // packing.FAN
            for node, held in up.items():
                fit, fill = packing.BestFit(), {}
                for size, b in sorted(held, key=lambda x: (-x[0], x[1])):
                    at = fit.put(size)
                    if at is None:
                        fill[b] = size
                        fit.add(b, 1024 - size)
                    else:
                        fill[at[0]] += size
                state[node] = [(size, b) for b, size in fill.items()]
            if not last:
                return sum(map(len, state.values()))

    nearly_full = spark.createDataFrame([(0, 0, 1022), (39, 1, 2)], "node long, bin long, fill long")
    assert [tuple(r) for r in packing.merge_tree(nearly_full).select("bin", "sequence_id", "base").collect()] == [(1, 0, 1022)]
    rng = np.random.default_rng(3)
    bins = [(n, n << 33 | i, int(f)) for n in range(0, 40, 3) for i, f in enumerate([rng.integers(1, 512), *rng.integers(513, 1024, 1500)])]
    bins += [(0, 1 << 30, 1022), (39, 39 << 33 | 1 << 30, 2)]
    moved = packing.merge_tree(spark.createDataFrame(bins, "node long, bin long, fill long")).collect()
    assert len(moved) == len({r.bin for r in moved}) and len(bins) - len(moved) == uncut(bins)


def test_empty_and_clashing(spark, empty, clashing):
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(clashing.withColumn("piece", F.lit("x"))).count() == 12


def least_bins(lengths, capacity):
    """The least number of bins, by trying every way to add the longest piece left."""
    best = [len(lengths)]

    def go(left, free):
        if len(free) >= best[0]:
            return
        if not left:
            best[0] = len(free)
            return
        for room in set(free):
            if room >= left[0]:
                rest = list(free)
                rest[rest.index(room)] = room - left[0]
                go(left[1:], rest)
        go(left[1:], [*free, capacity - left[0]])

    go(sorted(lengths, reverse=True), [])
    return best[0]


def test_best_fit_is_near_the_least_for_small_sets():
    rng = random.Random(6)
    exact = 0
    for _ in range(200):
        lengths = [rng.randrange(1, 1025) for _ in range(rng.randrange(1, 9))]
        fit, used = packing.BestFit(), 0
        for n in sorted(lengths, reverse=True):
            if fit.put(n) is None:
                fit.add(used, 1024 - n)
                used += 1
        least = least_bins(lengths, 1024)
        exact += used == least
        assert least <= used <= 11 / 9 * least + 6 / 9
    assert exact >= 190
