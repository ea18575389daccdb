import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from splitbench.llm import lattice

from .conftest import documents, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_recursion_sums_all_segmentations():
    size = lattice._vocabulary(PATH).get_piece_size()
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(size)))
    model = lattice.PieceLattice(PATH, log_p)

    def listed(s):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            w = model.piece.get(s[:n])
            if w is None and n == 1:
                w = sum(model.byte[b] for b in s[0].encode())
            if w is not None:
                total += math.exp(w) * listed(s[n:])
        return total

    for word in ("a", "the", "thinking", "étés", "日本", "a\u0000b", "ﬁx"):
        assert model.log_prob(word) == pytest.approx(math.log(listed("▁" + word)), rel=1e-9)
    assert math.isfinite(model.log_prob("x" * 5000))


def segmentations(s, numbers):
    """All ways to cut s into pieces, as lists of piece numbers; a character without a piece is its bytes."""
    if not s:
        yield []
    for n in range(1, len(s) + 1):
        own = [numbers[s[:n]]] if s[:n] in numbers else [numbers[b] for b in s[0].encode()] if n == 1 else None
        if own:
            for rest in segmentations(s[n:], numbers):
                yield own + rest


def slow_scores(rows):
    """The model from scratch: weights by rank, expected counts by listing all segmentations, scores by listing them again."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    size = sp.get_piece_size()
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
    p = np.array([1 / (2 + (size if special[i] else max(0, -sp.get_score(i)))) for i in range(size)])
    p /= p.sum()
    numbers = {sp.id_to_piece(i): i for i in range(size) if not special[i]} | {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    total = np.ones(size)
    for _, text, *_ in train:
        for w in text.lower().split():
            ways = list(segmentations("▁" + w, numbers))
            weight = np.array([p[x].prod() for x in ways])
            for x, share in zip(ways, weight / weight.sum()):
                np.add.at(total, x, share)
    everything = total.sum() + len(train) + 1
    q = total / everything
    end = math.log10((len(train) + 1) / everything)
    return {i: sum(math.log10(sum(q[x].prod() for x in segmentations("▁" + w, numbers))) for w in text.lower().split()) + end for i, text, *_ in rows}


def test_query_scores_match_a_slow_model(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(["the cat sat", "a dog, a cat", "", "étés 日本 zqx", "the the the", "unseen word", "x9 - y", "The DOG sat"] * 2)]
    want = slow_scores(rows)
    for r in lattice.score_documents(documents(spark, rows), block_rows=3).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-4)


def test_expected_counts_of_long_and_strange_words():
    model = lattice.PieceLattice(PATH, lattice.first_weights(PATH))
    for word in ("x" * 3000, "日本" * 400):
        total = {}
        model.count_into(total, word, 1)
        text = "▁" + word
        length = {v: len(k.encode()) for k, v in model.number.items()} | dict.fromkeys(model.byte_number, 1)
        assert sum(n * length[k] for k, n in total.items()) / lattice.PARTS == pytest.approx(len(text.encode()), rel=0.02)


def test_repeated_rows_are_spread(spark):
    df = documents(spark, [(2, "same text", "en", "s")] * 50)
    got = lattice.score_documents(df, block_rows=5).collect()
    assert len(got) == 50 and len({r.score for r in got}) == 1 and got[0].train_tokens == 150


def brute(rows):
    words = {i: (r[1] or "").encode().lower().split() for i, r in enumerate(rows)}
    train = [i for i, r in enumerate(rows) if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2]
    counts = Counter(w for i in train for w in [*words[i], None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, r in enumerate(rows):
        tokens = [*words[i], None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((str(r[0]), i not in train, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    return sorted(out)


def test_base_scores_match_brute_force(spark):
    rows = odd_rows()
    for per_block in (7, 4096):
        got = lattice.score_documents(documents(spark, rows), block_rows=per_block).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_are_sums_over_words(spark):
    texts = ["the cat", "cat the", "the", "cat", "", "dog dog unseenword"]
    got = {r.doc_id: r.score for r in lattice.score_documents(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx(got[2] + got[3] - got[4])


def test_empty_and_clashing(spark, empty, clashing):
    assert lattice.score_documents(empty).count() == 0
    assert lattice.score_documents(clashing).count() == 12
