"""Language-model scores from a lattice of subword pieces, and a word-count base score.

The model is a unigram model over the pieces of an existing vocabulary.  A text's
probability is the product over its words, and an end, of a word's marginal
probability: the sum over all ways to cut it into pieces, by forward recursion in
log space.  The vocabulary file's scores are merge ranks, not probabilities: a
piece starts with a weight that falls with its rank, and is then weighted by its
expected count, plus one, over all segmentations of all words of the training
texts, by forward and backward recursion.

Words repeat, so everything is done once per word: texts are dealt to blocks of
about ``BLOCK_ROWS`` rows or ``BLOCK_BYTES``, a block sends each of its distinct
words once, counts are summed per word, the lattice is run once per word, and
each block gets back a dictionary of its own words.  No table of all words is
ever held in one place, and a word of every text is one row per block.  Rows are
dealt by their place, so that repeated rows are spread like others.

Defined cases: a null or empty text is the end token alone; if nothing is
trained on, counts are 0 and pieces are equally likely; a character without a
piece is its bytes' pieces; texts of any length are read whole; repeated rows and
null ids are rows of their own; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .common import Located, crc_mod, on_path, shared_table

BLOCK_ROWS, BLOCK_BYTES = 4096, 16 << 20
#: Expected counts are summed as whole numbers of such parts, so that their order is nothing to the sum.
PARTS = 1 << 12
#: The piece number of the end token in tables of counts.
END_PIECE = -1
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; on bytes only A-Z fold and only the six ASCII blanks split."""
    return (text or "").encode().lower().split()


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class PieceLattice:
    """Marginal log probabilities of words, and expected counts of pieces, under given log probabilities of pieces."""

    def __init__(self, path: str, log_p: np.ndarray):
        sp = _vocabulary(path)
        self.piece: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.byte, self.byte_number = [0.0] * 256, [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[b], self.byte_number[b] = float(log_p[i]), i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece[sp.id_to_piece(i)] = float(log_p[i])
                self.number[sp.id_to_piece(i)] = i
        self.plain = {s: (math.exp(w), self.number[s]) for s, w in self.piece.items()}
        #: By a piece's last two characters: the longest such piece; no longer one can end where these two do.
        self.reach: dict[str, int] = {}
        for s in self.piece:
            if len(s) > 1:
                self.reach[s[-2:]] = max(self.reach.get(s[-2:], 1), len(s))

    def _bytes(self, c: str) -> float:
        return sum(self.byte[b] for b in c.encode())

    def log_prob(self, word: str) -> float:
        """ln of the summed probability of all segmentations of the word."""
        return self._forward("▁" + word)[-1]

    def _forward(self, s: str) -> list[float]:
        get, reach = self.piece.get, self.reach.get
        alpha = [0.0] * (len(s) + 1)
        exp, log = math.exp, math.log
        for j in range(1, len(s) + 1):
            terms = []
            longest = reach(s[j - 2 : j], 1) if j > 1 else 1
            for i in range(j - longest if j > longest else 0, j):
                w = get(s[i:j])
                if w is not None:
                    terms.append(alpha[i] + w)
                elif i == j - 1:
                    terms.append(alpha[i] + self._bytes(s[i]))
            top = max(terms)
            alpha[j] = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top
        return alpha

    def count_into(self, total: dict[int, int], word: str, times: int) -> None:
        """Add the expected counts of pieces in ``times`` occurrences of a word, in PARTS."""
        s = "▁" + word
        n, get, reach = len(s), self.plain.get, self.reach.get
        alpha, edges = [1.0] + [0.0] * n, []
        for j in range(1, n + 1):
            a, longest = 0.0, reach(s[j - 2 : j], 1) if j > 1 else 1
            for i in range(j - longest if j > longest else 0, j):
                found = get(s[i:j])
                if found is not None:
                    a += alpha[i] * found[0]
                    edges.append((i, j, found[0], found[1]))
                elif i == j - 1:
                    p = math.exp(self._bytes(s[i]))
                    a += alpha[i] * p
                    edges.append((i, j, p, -1))
            alpha[j] = a
        if alpha[n] > 1e-280:
            beta, each = [0.0] * n + [times * PARTS / alpha[n]], []
            for i, j, p, number in reversed(edges):  # all that starts at j comes before what ends there
                q = p * beta[j]
                beta[i] += q
                each.append((alpha[i] * q, number, i))
        else:  # a long or strange word, whose probability is too small for a float
            up = self._forward(s)
            down, each = [-math.inf] * n + [0.0], []
            for i, j, p, number in reversed(edges):
                w = self.piece[s[i:j]] if number >= 0 else self._bytes(s[i])
                a, b = down[i], w + down[j]
                down[i] = max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -math.inf else b
                each.append((times * PARTS * math.exp(up[i] + b - up[n]), number, i))
        for x, number, i in each:
            parts = int(x + 0.5)
            if number >= 0:
                total[number] = total.get(number, 0) + parts
            else:
                for b in s[i].encode():
                    total[self.byte_number[b]] = total.get(self.byte_number[b], 0) + parts


def _block_words(table: pa.Table) -> pa.Table:
    """A block's distinct words with their counts in its training texts."""
    every, trained = set(), Counter()
    for text, train in zip(table.column("text"), table.column("train")):
        words = words_of(text.as_py())
        every.update(words)
        if train.as_py():
            trained.update(words)
    words = list(every)
    return pa.table(
        {
            "block": pa.array(np.full(len(words), table.column("block")[0].as_py() if len(table) else 0, np.int64)),
            "word": pa.array(words, pa.binary()).cast(pa.string()),
            "n": pa.array([trained[w] for w in words], pa.int64()),
        }
    )


def _piece_counts(path: str, shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = PieceLattice(path, shared.value), {}
        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lattice.count_into(total, word, n)
        some = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[i] for i in some], pa.int64())], names=["piece", "n"])

    return count


def _word_scores(path: str, shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(path, shared.value)
        for b in batches:
            p = pa.array([lattice.log_prob(w) / LN10 for w in b.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, p], names=["word", "c", "log10_p"])

    return score


def _score_block(end_count: int, end_log10: float):
    def score(texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        place = {w: i for i, w in enumerate(dictionary.column("word").cast(pa.binary()).to_pylist())}
        c = dictionary.column("c").to_numpy()
        base, log10_p = np.log10(c + 1.0), dictionary.column("log10_p").to_numpy()
        rows = []
        for text in texts.column("text"):
            words = words_of(text.as_py())
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            rows.append(
                (
                    len(words) + 1,
                    int((c[at] > 0).sum()) + (end_count > 0),
                    float(base[at].sum()) + math.log10(end_count + 1),
                    float(log10_p[at].sum()) + end_log10,
                )
            )
        n, known, over, p = zip(*rows) if rows else ((), (), (), ())
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "train": texts.column("train"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "counted": pa.array(over, pa.float64()),
                "score": pa.array(p, pa.float64()),
            }
        )

    return score


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2


def score_documents(df: DataFrame, vocabulary_path: str | None = None, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The counts and the piece weights come from all rows that are not held out.
    ``block_rows`` and ``block_bytes`` bound what a task holds, on average: so
    many texts and their words.
    """
    spark = on_path(df.sparkSession)
    path = vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")
    own = Located(df)
    rows = own.df.select(F.col(own.place("doc_id")).cast("long").alias("doc_id"), F.col(own.place("text")).alias("text"), "_file", "_row")
    train = ~held_out(F.col("doc_id"))
    all_of = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.count_if(train).alias("train")).first()
    blocks = max(1, -(-all_of["n"] // block_rows), -(-(all_of["size"] or 0) // block_bytes))
    texts = rows.select(F.pmod(F.xxhash64("_file", "_row"), F.lit(blocks)).alias("block"), "doc_id", "text", train.alias("train"))
    n_train = all_of["train"]

    by_block = shared_table(texts.groupBy("block").applyInArrow(_block_words, "block long, word string, n long"), "block-words")
    counts = by_block.groupBy("word").agg(F.sum("n").alias("c"))
    counts = spread(shared_table(counts, "words"))  # few bytes a word, but much work
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    train_tokens, distinct = sums["n"] + n_train, sums["v"] + (n_train > 0)

    log_p, end_log10 = _piece_weights(counts, path, n_train)
    shared = spark.sparkContext.broadcast(log_p)  # one number per piece of the vocabulary
    known = shared_table(counts.mapInArrow(_word_scores(path, shared), "word string, c long, log10_p double"), "word-scores")
    dictionary = by_block.join(known, "word").select("block", "word", "c", "log10_p")

    fields = "doc_id long, train boolean, n_tokens long, n_known long, counted double, score double"
    scored = texts.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(_score_block(n_train, end_log10), fields)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)).alias("base_score"),
        "score",
    )


def first_weights(path: str) -> np.ndarray:
    """ln probabilities of pieces that fall with their ranks, which the file gives as scores from 0 down; bytes come last."""
    sp = _vocabulary(path)
    n = sp.get_piece_size()
    rank = np.array([n if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) else max(0.0, -sp.get_score(i)) for i in range(n)])
    p = 1.0 / (2.0 + rank)
    return np.log(p / p.sum())


def _piece_weights(counts: DataFrame, path: str, n_train: int) -> tuple[np.ndarray, float]:
    """ln probabilities of the vocabulary's pieces, and log10 of the end's, from expected counts plus one.

    At most one row per piece of the vocabulary comes to the driver.
    """
    shared = counts.sparkSession.sparkContext.broadcast(first_weights(path))
    seen = counts.where("c > 0").mapInArrow(_piece_counts(path, shared), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    total = np.ones(_vocabulary(path).get_piece_size(), np.float64)
    for r in seen:
        total[r["piece"]] += r["n"] / PARTS
    everything = total.sum() + n_train + 1
    return np.log(total / everything), math.log10((n_train + 1) / everything)
