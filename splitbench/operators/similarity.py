"""Similarity of genomes by canonical k-mer sketches, or from a supplied table."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna, hashing, text
from ..session import materialize

CHUNK = 256
NO_MATCH = "no_detectable_match"


def chunks(df: DataFrame, k: int, sequence: str = "sequence", size: int = CHUNK, place: str | None = None) -> DataFrame:
    """df's other columns with piece: stretches that hold each k-mer exactly once; and their numbers as ``place``.

    Stretches are dealt evenly: one long sequence, or a file that one task reads,
    does not leave the work on its k-mers to one core.
    """
    keep = [c for c in df.columns if c != sequence]
    long_enough = df.where(F.length(sequence) >= k)
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length(sequence) - k) / size).cast("int"))).alias("_c")
    pieces = long_enough.select(*keep, sequence, at).select(*keep, "_c", F.expr(f"substring({sequence}, _c * {size} + 1, {size + k - 1})").alias("piece"))
    dealt = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keep, "_c")
    return dealt.withColumnRenamed("_c", place) if place else dealt.drop("_c")


def kmers(df: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """Every unambiguous k-mer occurrence, beside df's other columns."""
    pieces = chunks(df, k, sequence)
    keep = [c for c in pieces.columns if c != "piece"]
    spread = pieces.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - (k - 1)), lambda i: F.substr("piece", i, F.lit(k)))).alias("kmer"))
    return spread.where(F.col("kmer").rlike("^[ACGT]+$"))


#: Longest k-mer that is a long, two bits a letter; letters that are numbered at once; letters of a sequence that one task reduces.
PACKED, AT_ONCE, LONG = 31, 1 << 18, 1 << 20
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = range(4)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _numbers(letters: bytes, k: int) -> np.ndarray:
    """The canonical k-mer at each place as a number, which sort as the k-mers do; -1 where a letter is ambiguous.

    k-mers are joined from those of lengths that are powers of two, on both strands.
    """
    code = _CODE[np.frombuffer(letters, np.uint8)]
    n = len(code) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    unclear = code > 3
    there = np.where(unclear, 0, code).astype(np.int64)
    back, size, length = 3 - there, 1, 0
    while size <= k:
        if k & size:
            if length:
                m = len(there) - length
                one, two = one[:m] << 2 * size | there[length:], back[length:] << 2 * length | two[:m]
            else:
                one, two = there, back
            length += size
        there, back = there[:-size] << 2 * size | there[size:], back[size:] << 2 * size | back[:-size]
        size *= 2
    found = np.minimum(one[:n], two[:n])
    if unclear.any():
        run = np.concatenate(([0], np.cumsum(unclear)))
        found[run[k:] > run[:-k]] = -1
    return found


def _by_row(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text its unambiguous canonical k-mers as numbers in order, repeats included; short texts are numbered together."""
    at = 0
    while at < len(texts):
        end, held = at + 1, len(texts[at])
        while end < len(texts) and held + len(texts[end]) < AT_ONCE:
            held += len(texts[end]) + 1
            end += 1
        found, place = _numbers(b"\n".join(texts[at:end]), k), 0
        for t in texts[at:end]:
            own = np.sort(found[place : place + max(0, len(t) - k + 1)])
            yield own[np.searchsorted(own, 0) :]
            place += len(t) + 1
        at = end


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct number of an ordered array begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _repeated(df: DataFrame, ident: str) -> DataFrame | None:
    """The values of ident that several rows have, as _several; None if there are none."""
    found = materialize(df.groupBy(F.col(ident).alias("_several")).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    return None if found.isEmpty() else found.select("_several", F.lit(True).alias("_again"))


def _marked(df: DataFrame, ident: str) -> DataFrame:
    """df with _again: whether other rows have the same ident."""
    several = _repeated(df, ident)
    if several is None:
        return df.withColumn("_again", F.lit(False))
    return df.join(several, F.col(ident).eqNullSafe(F.col("_several")), "left").drop("_several").withColumn("_again", F.coalesce("_again", F.lit(False)))


def kmer_counts(df: DataFrame, k: int, genome: str = "genome_id", sequence: str = "sequence") -> DataFrame:
    """(genome, n, n_distinct, first): its unambiguous canonical k-mers, how many differ, and the least.

    A genome in one row is counted where the row is read, so none of its k-mers
    is shuffled.  Only k-mers of genomes in several rows, and of sequences of more
    than LONG letters, become rows: one for each that differs in a row or stretch.
    """
    if k > PACKED:
        every = canonical_kmers(df.select(genome, sequence), k, sequence)
        return every.groupBy(genome).agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("n_distinct"), F.min("kmer").alias("first"))
    kind = df.schema[genome].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, again = b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
            rows, n, different, least = [], [], [], []
            whole = [i for i, t in enumerate(texts) if not again[i] and len(t) <= LONG]
            for i, own in zip(whole, _by_row([texts[i] for i in whole], k)):
                if len(own):
                    rows.append(i), n.append(len(own)), different.append(len(_distinct(own))), least.append(own[0])
            yield made(b, rows, n, pa.array(different, pa.int64()), least)
            for i in sorted({*range(len(texts))} - {*whole}):
                for c in range(0, len(texts[i]) - k + 1, AT_ONCE):
                    own = next(_by_row([texts[i][c : c + AT_ONCE + k - 1]], k))
                    at = _distinct(own)
                    yield made(b, np.full(len(at), i), np.diff(at, append=len(own)), pa.nulls(len(at), pa.int64()), own[at])

    def made(b, rows, n, different, least) -> pa.RecordBatch:
        columns = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), different, pa.array(least, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[genome, "n", "n_distinct", "least"])

    rows = _marked(df.select(genome, sequence), genome).where(F.length(sequence) >= k)
    parts = rows.mapInArrow(count, f"`{genome}` {kind}, n long, n_distinct long, least long")
    each = parts.groupBy(genome, F.when(F.col("n_distinct").isNull(), F.col("least")).alias("_kmer")).agg(
        F.sum("n").alias("n"), F.max("n_distinct").alias("n_distinct"), F.min("least").alias("least")
    )
    counts = each.groupBy(genome).agg(F.sum("n").alias("n"), F.sum(F.coalesce("n_distinct", F.lit(1))).alias("n_distinct"), F.min("least").alias("least"))
    first = F.translate(F.lpad(F.conv(F.col("least").cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return counts.select(genome, "n", "n_distinct", first.alias("first"))


def canonical_kmers(df: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    return kmers(df, k, sequence).withColumn("kmer", dna.canonical(F.col("kmer")))


def kmer_hashes(df: DataFrame, k: int, sequence: str = "sequence") -> DataFrame:
    """The hash of every unambiguous canonical k-mer occurrence, beside df's other columns.

    A stretch is complemented once; the reverse complement of its i-th k-mer is a
    slice of that.  Only stretches with an ambiguous letter look at each k-mer.
    """
    pieces = chunks(df, k, sequence)
    keep = [c for c in pieces.columns if c != "piece"]
    both = pieces.select(*keep, "piece", dna.reverse_complement(F.col("piece")).alias("back"), F.col("piece").rlike("[^ACGT]").alias("unclear"))
    at = both.select("*", F.explode(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("_i"))
    here = F.substr("piece", "_i", F.lit(k))
    back = F.substr("back", F.length("piece") - F.col("_i") - (k - 2), F.lit(k))
    hashed = F.when(~(F.col("unclear") & here.rlike("[^ACGT]")), hashing.kmer_hash(F.least(here, back)))
    return at.select(*keep, hashed.alias("h")).where("h is not null")


#: Letters of a stretch that a row reduces to its smallest hashes, and stretches whose hashes a task merges.
STRETCH, MERGED = 8192, 64


def _smallest(hashes: Column, size: int) -> Column:
    """The ``size`` smallest distinct numbers of an array, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def _stretch_hashes(k: int) -> Column:
    """The hash numbers of the unambiguous canonical k-mers of column piece.

    Taking a substring walks the text from its start, so a stretch is cut into
    short parts first, each turned around once.
    """

    def of_part(both: Column) -> Column:
        part, back = both["part"], both["back"]
        kmer = lambda i: F.substr(part, i, F.lit(k))
        places = F.sequence(F.lit(1), F.length(part) - (k - 1))
        clear = F.when(part.rlike("[^ACGT]"), F.filter(places, lambda i: ~kmer(i).rlike("[^ACGT]"))).otherwise(places)
        return F.transform(clear, lambda i: hashing.number(hashing.kmer_hash(F.least(kmer(i), F.substr(back, F.length(part) - i - (k - 2), F.lit(k))))))

    starts = F.sequence(F.lit(0), F.floor((F.length("piece") - k) / CHUNK).cast("int"))
    parts = F.transform(starts, lambda c: F.substr("piece", c * CHUNK + 1, F.lit(CHUNK + k - 1)))
    turned = F.transform(parts, lambda p: F.struct(p.alias("part"), dna.reverse_complement(p).alias("back")))
    return F.flatten(F.transform(turned, of_part))


def sketches(df: DataFrame, k: int, size: int, genome: str = "genome_id", sequence: str = "sequence", blake2: bool = False) -> DataFrame:
    """(genome, hashes, unique_kmers, is_exact): the ``size`` smallest distinct k-mer hashes, as ordered numbers.

    A genome in one row is sketched where the row is read: nothing is shuffled.
    The smallest of a whole are among the smallest of its parts, so genomes in
    several rows and sequences of more than LONG letters are cut into stretches
    that are merged.  unique_kmers stops at size + 1, which means: more than the
    sketch holds.
    """
    if blake2 or k > PACKED:
        return _sketch_columns(_merged_parts(df, k, size, genome, sequence, blake2), size, genome)
    rows = _marked(df.select(genome, sequence), genome)
    kind = rows.schema[genome].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [_smallest_hashes(own[_distinct(own)], k, size + 1) for own in _by_row(b.column(1).cast(pa.binary()).to_pylist(), k)]
            ends = np.cumsum([0, *map(len, held)])
            parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*held, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), parts.cast(pa.list_(pa.int64()))], names=[genome, "part"])

    long = F.length(sequence) > LONG
    short = rows.where((F.length(sequence) >= k) & ~long & ~F.col("_again")).select(genome, sequence)
    whole = short.mapInArrow(sketch, f"`{genome}` {kind}, part array<bigint>").where(F.size("part") > 0)
    rest = _merged_parts(rows.where(long | F.col("_again")).select(genome, sequence), k, size, genome, sequence)
    return _sketch_columns(whole.unionByName(rest), size, genome)


def _smallest_hashes(kmers: np.ndarray, k: int, size: int) -> np.ndarray:
    """The ``size`` smallest distinct hashes, in order, of k-mers given as distinct numbers."""
    letters = np.empty((len(kmers), k), np.uint8)
    for i in range(k):
        letters[:, i] = _LETTERS[kmers >> 2 * (k - 1 - i) & 3]
    text = letters.tobytes()
    heads = b"".join([sha256(text[i : i + k]).digest()[:8] for i in range(0, len(text), k)])
    hashes = np.sort((np.frombuffer(heads, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64))
    return hashes[_distinct(hashes)[:size]]


def _merged_parts(df: DataFrame, k: int, size: int, genome: str, sequence: str, blake2: bool = False) -> DataFrame:
    """(genome, part): the size + 1 smallest distinct hashes.

    A row reduces its stretch to at most size + 1 numbers, which are merged over
    ``MERGED`` stretches and then over the genome, so that no k-mer becomes a row
    and eight bytes a retained hash are shuffled.
    """
    pieces = chunks(df.select(genome, sequence), k, sequence, max(STRETCH, 4 * size), place="_s")
    if blake2:
        rows = canonical_kmers(pieces.withColumnRenamed("piece", sequence), k, sequence).distinct()
        hashed = rows.select(genome, "_s", hashing.number(hashing.kmer_hash_blake2(F.col("kmer"))).alias("h"))
        parts = hashed.groupBy(genome, "_s").agg(_smallest(F.collect_set("h"), size + 1).alias("part"))
    else:
        parts = pieces.select(genome, "_s", _smallest(_stretch_hashes(k), size + 1).alias("part"))
    merge = _smallest(F.flatten(F.collect_list("part")), size + 1).alias("part")
    some = parts.groupBy(genome, F.floor(F.col("_s") / MERGED).alias("_m")).agg(merge)
    return some.groupBy(genome).agg(merge).where(F.size("part") > 0)


def _sketch_columns(held: DataFrame, size: int, genome: str) -> DataFrame:
    return held.select(
        genome,
        F.slice("part", 1, size).alias("hashes"),
        F.size("part").cast("long").alias("unique_kmers"),
        (F.size("part") <= size).alias("is_exact"),
    )


def hex_hashes(hashes: Column) -> Column:
    """A sketch's numbers as 16 hex digits each."""
    return F.transform(hashes, hashing.number_hex)


def mash_identity(j: Column, k: int) -> Column:
    """Identity from Jaccard; null if nothing is shared."""
    estimate = 1 + F.ln(2 * j / (1 + j)) / k
    return F.when(j == 1, F.lit(1.0)).when(j > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def _classes(sketched: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sketches: (class, hashes, is_exact), and their members (class, ident)."""
    own = sketched.select(ident, "hashes", "is_exact", F.sha2(F.concat_ws(",", F.col("hashes").cast("array<string>"), F.col("is_exact").cast("string")), 256).alias("class"))
    one = own.groupBy("class").agg(F.any_value("hashes").alias("hashes"), F.any_value("is_exact").alias("is_exact"))
    return one, own.select("class", ident)


def candidate_pairs(queries: DataFrame, references: DataFrame, query: str = "query_id", reference: str = "reference_id") -> DataFrame:
    """(query, reference, met): pairs that share retained hashes, with the ranks of each such hash on both sides; all others have no detectable match."""
    q = queries.select(query, F.posexplode("hashes").alias("rq", "h"))
    r = references.select(reference, F.posexplode("hashes").alias("rr", "h"))
    return q.join(r, "h").groupBy(query, reference).agg(F.collect_list(F.struct("rq", "rr")).alias("met"))


def pairwise(queries: DataFrame, references: DataFrame, k: int, size: int, query: str = "query_id", reference: str = "reference_id") -> DataFrame:
    """(query, reference, jaccard, identity) for every pair that shares a hash.

    Equal sketches are one class on each side, so strains that hardly differ meet
    once.  An inverted index over hashes finds the pairs of classes.  A shared
    hash of ranks i and j, the c-th that a pair shares, has place i + j - c among
    the pair's hashes, so ranks tell which shared hashes are among the smallest of
    the union, and no sketch is fetched again.  No cross join.
    """
    (qc, qm), (rc, rm) = _classes(queries, query), _classes(references, reference)
    qc, rc = materialize(qc, "query-classes"), materialize(rc, "reference-classes")
    met = candidate_pairs(qc.withColumnRenamed("class", "qc"), rc.withColumnRenamed("class", "rc"), "qc", "rc")
    sizes = lambda d, c, n, e: d.select(F.col("class").alias(c), F.size("hashes").alias(n), F.col("is_exact").alias(e))
    both = met.join(sizes(qc, "qc", "qn", "qe"), "qc").join(sizes(rc, "rc", "rn", "re"), "rc")
    union = F.col("qn") + F.col("rn") - F.size("met")
    # Ranks count from 0 here, and so does the index: place - 1 = rq + rr - index.
    in_head = F.size(F.filter(F.sort_array("met"), lambda x, i: x["rq"] + x["rr"] - i < size))
    value = F.when(F.col("qe") & F.col("re"), F.size("met") / union).otherwise(in_head / F.least(union, F.lit(size)))
    scored = both.select("qc", "rc", value.alias("jaccard")).where("jaccard > 0")
    pairs = scored.join(qm.withColumnRenamed("class", "qc"), "qc").join(rm.withColumnRenamed("class", "rc"), "rc")
    return pairs.select(query, reference, "jaccard", mash_identity(F.col("jaccard"), k).alias("identity"))


def nearest(hits: DataFrame, queries: DataFrame, query: str = "query_id", reference: str = "reference_id", value: str = "identity") -> DataFrame:
    """For each query its most similar reference, ties to the smallest id; nulls if none is detected."""
    best = hits.groupBy(query).agg(
        F.max(value).alias("max_similarity"),
        F.min_by(reference, F.struct((-F.col(value)).alias("v"), F.col(reference))).alias("nearest_id"),
    )
    return queries.select(query).join(best, query, "left")


#: Hashes of a block of sketches; a task scores one block of queries against one of references.
BLOCK = 4 << 20


def nearest_of_classes(classes: DataFrame, k: int, size: int) -> DataFrame:
    """(query, max_similarity, nearest_id) as nearest() of pairwise() gives them, without a row for any pair.

    classes has a row for each side and different sketch: side (query or not),
    class, hashes, is_exact, first (the least id) and members (ids, of queries).
    Each task scores a block of query classes against a block of references by an
    inverted index in memory and returns the best of each query, so what is
    shuffled is the sketches, once for each block that they meet.
    """
    spark = classes.sparkSession
    held = {r["side"]: r["n"] for r in classes.groupBy("side").agg(F.sum(F.size("hashes")).alias("n")).collect()}
    nq, nr = held.get(True, 0), held.get(False, 0)
    tasks = 3 * spark.sparkContext.defaultParallelism
    least_q, least_r = -(-nq // BLOCK) or 1, -(-nr // BLOCK) or 1
    grids = [(max(least_q, -(-tasks // r)), r) for r in range(least_r, max(least_r, tasks) + 1)]
    of_q, of_r = min(grids, key=lambda g: nq * g[1] + nr * g[0])
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = classes.where("side").select("class", "hashes", "is_exact", block(of_q).alias("_q")).select("*", every(of_r).alias("_r"))
    renamed = [F.col(c).alias(f"of_{c}") for c in ("hashes", "is_exact", "first")]  # a cogroup confuses columns that both sides have from one table
    r = classes.where("not side").select(*renamed, block(of_r).alias("_s")).select("*", every(of_q).alias("_p"))
    clamped = float(np.exp(-k) / (2 - np.exp(-k)))  # the identity of such a Jaccard is 0, as of all smaller ones

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_block(left, right, size, clamped)

    met = q.groupBy("_q", "_r").cogroup(r.groupBy("_p", "_s")).applyInArrow(score, "class string, jaccard double, first string")
    best = nearest(met.withColumn("identity", mash_identity(F.col("jaccard"), k)), classes.where("side"), "class", "first")
    members = classes.where("side").select("class", F.explode("members").alias("query_id"))
    return members.join(best, "class").select("query_id", "max_similarity", "nearest_id")


def _best_of_block(queries: pa.Table, references: pa.Table, size: int, clamped: float) -> pa.Table:
    """(class, jaccard, first): the best reference of each query that shares a hash with any, ties to the least id.

    The shared hashes of a pair are met in order; one of ranks i and j that is the
    c-th has place i + j - c among the pair's hashes, and counts if that is among
    the ``size`` smallest.  Only references whose number of shared hashes could
    beat the best found so far are scored.
    """

    def flat(t: pa.Table, of: str = "") -> tuple:
        column = t.column(f"{of}hashes").combine_chunks()
        n = np.diff(column.offsets.to_numpy())
        ends = np.concatenate(([0], np.cumsum(n)))
        return column.flatten().to_numpy(), n, ends, t.column(f"{of}is_exact").to_numpy().astype(bool)

    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and references.num_rows:
        q, qn, q_ends, q_exact = flat(queries)
        r, rn, r_ends, r_exact = flat(references, "of_")
        firsts = references.column("of_first").to_pylist()
        order = np.argsort(r, kind="stable")
        index = r[order]
        owner = np.repeat(np.arange(len(rn), dtype=np.int32), rn)[order]
        rank = (np.arange(len(r)) - np.repeat(r_ends[:-1], rn)).astype(np.int32)[order]
        del order, r
        begin, end = np.searchsorted(index, q, "left"), np.searchsorted(index, q, "right")
        for i, name in enumerate(queries.column("class").to_pylist()):
            lo, n = begin[q_ends[i] : q_ends[i + 1]], end[q_ends[i] : q_ends[i + 1]] - begin[q_ends[i] : q_ends[i + 1]]
            total = int(n.sum())
            if not total:
                continue
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
            who = owner[at]
            shared = np.bincount(who, minlength=len(rn))
            seen = np.flatnonzero(shared)
            m = shared[seen]
            union = qn[i] + rn[seen] - m
            exact = r_exact[seen] & q_exact[i]
            whole = np.where(exact, union, np.minimum(union, size))
            most = np.minimum(m, whole) / whole

            def scored(chosen: np.ndarray) -> np.ndarray:
                """The Jaccard of the chosen places of seen."""
                number = np.full(len(rn), -1, np.int32)
                number[seen[chosen]] = np.arange(len(chosen))
                to = number[who]
                keep = np.flatnonzero(to >= 0)
                keep = keep[np.argsort(to[keep], kind="stable")]
                to = to[keep]
                before = np.arange(len(to)) - np.searchsorted(to, to, "left")
                place = np.repeat(np.arange(len(n)), n)[keep] + rank[at[keep]] - before
                in_head = np.bincount(to[place < size], minlength=len(chosen))
                return np.where(exact[chosen], m[chosen], in_head) / whole[chosen]

            found = scored(np.array([np.argmax(most)]))[0]
            chosen = np.flatnonzero(most >= found) if found > clamped else np.arange(len(seen))
            values = scored(chosen)
            top = max(values.max(), clamped)
            if values.max() > 0:
                ties = chosen[(values >= top) | ((values > 0) & (top == clamped))]
                best = min(ties, key=lambda j: firsts[seen[j]])
                out[0].append(name), out[1].append(values[np.flatnonzero(chosen == best)[0]]), out[2].append(firsts[seen[best]])
    return pa.table({"class": pa.array(out[0], pa.string()), "jaccard": pa.array(out[1], pa.float64()), "first": pa.array(out[2], pa.string())})


def classify(similarity: Column, high: float = 0.90, moderate: float = 0.70, low: float = 0.30) -> Column:
    """The band of a similarity; null is its own band."""
    return (
        F.when(similarity.isNull(), NO_MATCH)
        .when(similarity < low, "distant_detectable")
        .when(similarity < moderate, "low_similarity")
        .when(similarity < high, "moderate_similarity")
        .otherwise("high_similarity")
    )


def gated(similarity: Column, coverage: Column, most: float, least_coverage: float) -> Column:
    """Whether a hit excludes its candidate: above the identity limit, and coverage unknown or enough."""
    return F.coalesce((similarity > most) & (coverage.isNull() | (coverage >= least_coverage)), F.lit(False))


def gate_reason(similarity: Column, excluded: Column, most: float) -> Column:
    return (
        F.when(excluded, "similarity_above_strict_identity_and_coverage_gate")
        .when(similarity > most, "similarity_above_identity_below_minimum_coverage")
        .otherwise("similarity_within_strict_identity_threshold")
    )


def collapse_table(table: DataFrame, most: float, least_coverage: float) -> DataFrame:
    """One row per query of a similarity table: its best hit, and independently its best hit that qualifies.

    Undetected pairs rank last; if nothing is detected the provenance is that of
    the smallest reference id and the hit's id is null.
    """
    sim, ref = F.col("similarity"), F.col("reference_genome_id")
    order = F.struct((-F.coalesce(sim, F.lit(-1.0))).alias("s"), ref.alias("r"))
    row = F.struct(ref.alias("id"), sim.alias("similarity"), F.col("coverage").alias("coverage"), F.col("method").alias("method"))
    passes = gated(sim, F.col("coverage"), most, least_coverage)
    best = table.groupBy("query_genome_id").agg(
        F.min_by(row, order).alias("best"), F.min_by(F.when(passes, row), F.when(passes, order)).alias("gate")
    )
    return best.select(
        "query_genome_id",
        F.when(F.col("best.similarity").isNotNull(), F.col("best.id")).alias("nearest_train_genome_id"),
        F.col("best.similarity").alias("max_train_similarity"),
        F.col("best.coverage").alias("similarity_coverage"),
        F.col("best.method").alias("similarity_method"),
        F.col("gate.id").alias("strict_gate_train_genome_id"),
        F.col("gate.similarity").alias("strict_gate_similarity"),
        F.col("gate.coverage").alias("strict_gate_coverage"),
        F.col("gate.method").alias("strict_gate_method"),
    )


def similarity_rows(hits: DataFrame) -> DataFrame:
    """Best hits (query_genome_id, reference_genome_id, similarity, coverage, method) as rows of text, blank where unknown."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return hits.select(
        "query_genome_id", blank(F.col("reference_genome_id")).alias("reference_genome_id"), text.float_text(F.col("similarity")).alias("similarity"),
        text.float_text(F.col("coverage")).alias("coverage"), "method",
    )


def incomplete_queries(table: DataFrame, n_references: int) -> DataFrame:
    """Queries without exactly one row for each reference."""
    return table.groupBy("query_genome_id").agg(F.count_distinct("reference_genome_id").alias("n_pairs"), F.count("*").alias("n_rows")).where(
        (F.col("n_pairs") != n_references) | (F.col("n_rows") != n_references)
    )
