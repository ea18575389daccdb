"""Fragment sampling with replacement from all coordinates of a genome, and the random split."""

from __future__ import annotations

import random
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InputError, require_empty
from ..functions import dna, hashing
from ..session import discard, materialize

MAX_ATTEMPTS = 10_000
FIRST_ATTEMPTS = 8
#: Rounds in which contradictory fragments are drawn again; what is left then is for label_conflicts() to refuse.
REDRAWS = 100
#: Fragments to be drawn again, up to this many, go to the contigs; more of them and the contigs meet by shuffle.
FEW = 100_000


def length_preflight(contigs: DataFrame, lengths: list[int]) -> DataFrame:
    """(genome_id, fragment_length, longest) where no contig of a genome is long enough."""
    longest = contigs.groupBy("genome_id").agg(F.max(F.length("sequence")).cast("long").alias("longest"))
    asked = longest.withColumn("fragment_length", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])))
    return asked.where("longest < fragment_length").select("genome_id", "fragment_length", "longest")


def length_counts(genomes: DataFrame, lengths: list[int], per_genome: int, seed: int) -> DataFrame:
    """(genome_id, fragment_length, n): equal shares, the remainder to the lengths first in a seeded order."""
    share, more = divmod(per_genome, len(lengths))
    spread = genomes.select("genome_id", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])).alias("fragment_length"))
    key = hashing.semantic_rank(seed, "length-balance", F.concat_ws("|", "genome_id", "fragment_length"))
    order = Window.partitionBy("genome_id").orderBy(key, "fragment_length")
    return spread.withColumn("n", (F.lit(share) + (F.row_number().over(order) <= more).cast("int")).cast("long"))


def coordinate_space(contigs: DataFrame, lengths: list[int]) -> DataFrame:
    """(genome_id, sequence_id, fragment_length, lo, hi): which tickets of a genome fall on a contig.

    A contig has as many starts as a fragment fits at; on a circle, everywhere.
    """
    n = F.length("sequence").cast("long")
    long_enough = contigs.select("genome_id", "sequence_id", "topology", n.alias("source_length")).withColumn(
        "fragment_length", F.explode(F.array(*[F.lit(x).cast("long") for x in lengths]))
    )
    starts = F.when(F.col("topology") == "circular", F.col("source_length")).otherwise(F.col("source_length") - F.col("fragment_length") + 1)
    fit = long_enough.where("source_length >= fragment_length").withColumn("starts", starts)
    order = Window.partitionBy("genome_id", "fragment_length").orderBy("sequence_id")
    hi = F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return fit.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("starts"))


def _drawn(wanted: DataFrame, space: DataFrame, contigs: DataFrame, seed: int, strand_mode: str, few: bool = False) -> DataFrame:
    """Coordinates and sequences for rows of (genome_id, fragment_length, local_index, attempt); few: they are at most FEW times the attempts tried."""
    sent = F.broadcast if few else lambda d: d
    on = ["genome_id", "fragment_length"]
    total = space.groupBy(*on).agg(F.max("hi").alias("total"), F.count("*").alias("contigs"))
    what = F.concat_ws("|", "genome_id", "fragment_length", "local_index", "attempt")
    tickets = sent(wanted).join(total, on).withColumn("ticket", hashing.draw(hashing.semantic_rank(seed, "coordinates", what)) % F.col("total"))
    # A genome's axis has as many bins as contigs: a ticket meets the few contigs of its bin, not all of the genome.
    bin_of = lambda x: F.floor(x.cast("double") * F.col("contigs") / F.col("total")).cast("long")
    binned = space.join(total, on).withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi") - 1)))).drop("total", "contigs")
    placed = sent(tickets.withColumn("bin", bin_of(F.col("ticket"))).drop("contigs")).join(binned, [*on, "bin"]).where("ticket >= lo and ticket < hi").drop("bin")
    placed = placed.withColumn("start", F.col("ticket") - F.col("lo")).withColumn("end", F.col("start") + F.col("fragment_length"))
    joined = sent(placed).join(contigs.select("genome_id", "sequence_id", "sequence"), ["genome_id", "sequence_id"])
    forward = dna.slice_forward(F.col("sequence"), F.col("start").cast("int"), F.col("fragment_length").cast("int"))
    out = joined.withColumn("forward", forward).drop("sequence")
    strand = F.concat_ws("|", "genome_id", "fragment_length", "local_index")
    minus = (hashing.draw(hashing.semantic_rank(seed, "strands", strand)) % 2 == 1) & F.lit(strand_mode == "both")
    return out.withColumn("strand", F.when(minus, "-").otherwise("+"))


def _accepted(wanted: DataFrame, space: DataFrame, contigs: DataFrame, seed: int, strand_mode: str, max_ambiguous: float, few: bool = False) -> DataFrame:
    """For rows of (genome_id, fragment_length, local_index, first) the first draw, from attempt ``first`` on, that is clear enough.

    A few attempts are tried at once, and only what none of them satisfied is
    tried again with more, up to MAX_ATTEMPTS.
    """
    if max_ambiguous >= 1:
        return _drawn(wanted.withColumnRenamed("first", "attempt"), space, contigs, seed, strand_mode, few)
    keys = ["genome_id", "fragment_length", "local_index"]
    fine = dna.ambiguous_fraction(F.col("forward")) <= max_ambiguous
    accepted, tried, size = None, 0, FIRST_ATTEMPTS
    while True:
        since = F.col("first") + tried
        tries = wanted.withColumn("attempt", F.explode(F.sequence(since, since + size - 1))).drop("first")
        good = materialize(_drawn(tries, space, contigs, seed, strand_mode).where(fine), "draws")
        best = good.groupBy(*keys).agg(F.min("attempt").alias("attempt"))
        got = good.join(best, [*keys, "attempt"], "left_semi")
        accepted = got if accepted is None else accepted.unionByName(got)
        wanted = wanted.join(best, keys, "left_anti")
        tried += size
        size = min(size * 4, MAX_ATTEMPTS - tried)
        if wanted.isEmpty():
            return accepted
        if size <= 0:
            require_empty(wanted.drop("first"), f"no window within {MAX_ATTEMPTS} attempts has max_ambiguous_fraction={max_ambiguous:g}")


def sample_fragments(
    contigs: DataFrame,
    lengths: list[int],
    per_genome: int,
    seed: int,
    strand_mode: str = "both",
    max_ambiguous: float = 0.05,
    contradictions: str = "keep",
) -> DataFrame:
    """The fragment library: per_genome fragments of each genome, with replacement.

    Each draw is a hash of (seed, genome, length, index, attempt), so any
    fragment can be drawn alone.  With contradictions="redraw" fragments whose
    content was drawn under both labels are drawn again from their next attempt
    on, all of them, until none is left.
    """
    if per_genome < len(lengths):
        raise InputError("fragments per genome must cover every length")
    labels = contigs.groupBy("genome_id").agg(F.max("label").alias("label"))
    counts = length_counts(labels, lengths, per_genome, seed)
    space = coordinate_space(contigs, lengths)
    wanted = counts.where("n > 0").select("genome_id", "fragment_length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("local_index"))
    keys = ["genome_id", "fragment_length", "local_index"]
    ident = hashing.semantic_rank(seed, "fragment-id", F.concat_ws("|", "genome_id", "sequence_id", "fragment_length", "local_index", "start", "strand"))

    if contradictions == "redraw":
        space, labels = materialize(space, "space"), materialize(labels, "labels")

    def drawn(wanted: DataFrame, few: bool = False) -> DataFrame:
        found = _accepted(wanted, space, contigs, seed, strand_mode, max_ambiguous, few)
        return (F.broadcast(found) if few else found).join(labels, "genome_id").select(
            F.concat(F.lit("frag-"), F.substring(ident, 1, 32)).alias("fragment_id"),
            F.when(F.col("strand") == "-", dna.reverse_complement(F.col("forward"))).otherwise(F.col("forward")).alias("sequence"),
            "label",
            "genome_id",
            "sequence_id",
            "start",
            "end",
            "strand",
            "fragment_length",
            "local_index",
            "source_length",
            "attempt",
        )

    library = drawn(wanted.withColumn("first", F.lit(0)))
    if contradictions != "redraw":
        return library.drop("attempt")
    library, spent = library.withColumn("digest", _content()), []
    for _ in range(REDRAWS):
        library = materialize(library, "drawn")
        discard(*spent)
        again = materialize(library.join(_of_both_labels(library), "digest", "left_semi").select(*keys, (F.col("attempt") + 1).alias("first")), "again")
        n = again.count()
        if not n:
            break
        few, spent = n <= FEW, [library, again]
        library = library.join(F.broadcast(again) if few else again, keys, "left_anti").unionByName(drawn(again, few).withColumn("digest", _content()))
    return library.drop("attempt", "digest")


#: A genome's place among all is by ranges of ids; this many, so that no task ranks all genomes.
RANGES = 64


def with_ordinals(fragments: DataFrame) -> DataFrame:
    """Consecutive numbers over genome, length and draw.

    Genomes are dealt to ranges of their ids, whose sums are the only thing that
    one task sees whole; inside a range and a genome, ranks do the rest.
    """
    per = fragments.groupBy("genome_id").agg(F.count("*").alias("_n"))
    dealt = materialize(per.repartitionByRange(RANGES, "genome_id").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range").agg(F.sum("_n").alias("_s"))
    offsets = sums.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("genome_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.join(F.broadcast(offsets), "_range").select("genome_id", (F.col("_o") + within).alias("_before"))  # at most RANGES rows
    inside = F.row_number().over(Window.partitionBy("genome_id").orderBy("fragment_length", "local_index"))
    return fragments.join(before, "genome_id").withColumn("ordinal", F.col("_before") + inside - 1).drop("_before")


def _content() -> Column:
    """The digest of a fragment's content, on either strand."""
    return hashing.sequence_digest(dna.canonical(F.col("sequence")), False)


def _of_both_labels(fragments: DataFrame) -> DataFrame:
    """(digest, n_fragments) of fragments with digest, where it occurs under both labels."""
    both = fragments.groupBy("digest").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n_fragments"))
    return both.where("a <> b").select("digest", "n_fragments")


def label_conflicts(fragments: DataFrame) -> DataFrame:
    """Canonical fragment contents that occur under both labels."""
    return _of_both_labels(fragments.select("label", _content().alias("digest")))


def random_split(fragments: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """fragments with partition: a seeded share of each genome and length, one fragment at least on both sides."""
    stratum = Window.partitionBy("genome_id", "fragment_length")
    key = hashing.semantic_rank(seed, "random-membership", F.concat_ws("|", "genome_id", "fragment_length", "fragment_id"))
    n = F.count("*").over(stratum)
    test_n = F.least(n - 1, F.greatest(F.lit(1), F.floor(n * test_fraction + 0.5)))
    rn = F.row_number().over(stratum.orderBy(key, "fragment_id"))
    return fragments.withColumn("partition", F.when(rn <= test_n, "test").otherwise("train"))


def small_strata(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("genome_id", "fragment_length").agg(F.count("*").alias("n")).where("n < 2")


def reconstruction_violations(fragments: DataFrame, contigs: DataFrame) -> DataFrame:
    """Fragments that their coordinates do not reproduce."""
    source = contigs.select("genome_id", "sequence_id", F.col("sequence").alias("source"), "topology")
    joined = fragments.join(source, ["genome_id", "sequence_id"], "left")
    forward = dna.slice_forward(F.col("source"), F.col("start").cast("int"), F.col("fragment_length").cast("int"))
    again = F.when(F.col("strand") == "-", dna.reverse_complement(forward)).otherwise(forward)
    n = F.length("source")
    inside = (F.col("start") >= 0) & (F.col("start") < n) & ((F.col("end") <= n) | (F.col("topology") == "circular"))
    return joined.where(~F.coalesce(inside & (again == F.col("sequence")) & (F.col("end") - F.col("start") == F.length("sequence")), F.lit(False))).select(
        "fragment_id", "genome_id", "sequence_id"
    )


def semantic_order(df: DataFrame, seed: int, namespace: str, ident: str) -> DataFrame:
    return df.orderBy(hashing.semantic_rank(seed, f"output-order:{namespace}", F.col(ident)), ident)


SEQUENTIAL = "fragment_id string, sequence string, genome_id string, sequence_id string, start long, end long, strand string, fragment_length long, local_index long"


def sample_sequential(contigs: DataFrame, lengths: list[int], per_genome: int, seed: int, max_ambiguous: float = 0.05, strand_mode: str = "both") -> DataFrame:
    """The sampler as one seeded generator per genome and length, draw after draw.

    Rejected draws advance the generator, so a genome is one group of one task;
    sample_fragments() is the parallel form.
    """
    turned = str.maketrans(dna.IUPAC, dna.COMPLEMENT)
    names = [f.split()[0] for f in SEQUENTIAL.split(", ")]

    def sample(pdf: pd.DataFrame) -> pd.DataFrame:
        genome = pdf["genome_id"].iloc[0]
        sources = sorted(zip(pdf["sequence_id"], pdf["sequence"], pdf["topology"]))
        share, more = divmod(per_genome, len(lengths))
        order = list(lengths)
        random.Random(hashing.derive_seed(seed, "length-balance", genome)).shuffle(order)
        rows = []
        for n in lengths:
            fit = [s for s in sources if len(s[1]) >= n]
            ends, total = [], 0
            for _, s, topology in fit:
                total += len(s) if topology == "circular" else len(s) - n + 1
                ends.append(total)
            if not total:
                raise InputError(f"genome {genome} has no contig of {n}")
            place = random.Random(hashing.derive_seed(seed, "coordinates", genome, n))
            strand = random.Random(hashing.derive_seed(seed, "strands", genome, n))
            for i in range(share + (n in order[:more])):
                for _ in range(MAX_ATTEMPTS):
                    ticket = place.randrange(total)
                    at = bisect_right(ends, ticket)
                    ident, source, _ = fit[at]
                    start = ticket - (ends[at - 1] if at else 0)
                    piece = (source + source)[start : start + n]
                    if sum(c not in "ACGT" for c in piece) / n <= max_ambiguous:
                        break
                else:
                    raise InputError(f"no clear window in genome {genome}")
                minus = strand_mode == "both" and strand.random() < 0.5
                name = hashing.derive_seed(seed, "fragment-id", genome, ident, n, i, start, "-" if minus else "+")
                rows.append((f"frag-{name:032x}", piece.translate(turned)[::-1] if minus else piece, genome, ident, start, start + n, "-" if minus else "+", n, i))
        return pd.DataFrame(rows, columns=names)

    return contigs.select("genome_id", "sequence_id", "sequence", "topology").groupBy("genome_id").applyInPandas(sample, SEQUENTIAL)
