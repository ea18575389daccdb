"""The split protocols: which genomes train, which test, which are left out, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConfigurationError
from ..functions.hashing import semantic_rank
from ..functions.text import casefold
from ..operators import similarity as sim
from ..session import materialize

KINDS = ("random", "genome", "similarity", "temporal", "taxonomy")
#: Digits of the rank by which ranking is dealt to tasks.
DEALT = 3


def ranked(groups: DataFrame, by: list[str], rank: Column, tie: str, weight: str) -> DataFrame:
    """groups with idx, cum and total: place and running weight in rank order within ``by``, exactly.

    Ranks are uniform hex digits, so their first digits deal the groups to
    buckets of like size; a bucket's offset comes from a table of bucket sums.
    No task sorts a whole label.
    """
    dealt = groups.withColumn("_rank", rank).withColumn("_b", F.substring("_rank", 1, DEALT))
    sums = dealt.groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by,
        "_b",
        F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_w").over(run), F.lit(0)).alias("_w0"),
        F.sum("_w").over(whole).alias("total"),
        F.sum("_n").over(whole).alias("n_groups"),
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_rank", tie)
    placed = dealt.join(offsets, [*by, "_b"])
    placed = placed.withColumn("idx", F.col("_n0") + F.row_number().over(inside))
    placed = placed.withColumn("cum", F.col("_w0") + F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.drop("_b", "_n0", "_w0", "_rank")


def cut_candidates(ranked_groups: DataFrame, fraction: float, seed: int, namespace: str) -> DataFrame:
    """(label, idx, cum, distance, tie): every prefix but the whole as a cut."""
    distance = F.abs(F.col("cum") - F.col("total") * F.lit(fraction))
    tie = semantic_rank(seed, F.concat(F.lit(f"{namespace}:"), F.col("label"), F.lit(":cut")), F.col("idx"))
    return ranked_groups.where("idx < n_groups").select("label", "idx", "cum", distance.alias("distance"), tie.alias("tie"))


def partition_groups(genomes: DataFrame, fraction: float, seed: int, namespace: str) -> DataFrame:
    """(label, group_id, side): by label, the groups first in seeded order test, up to the cut nearest the fraction."""
    groups = genomes.groupBy("label", "group_id").agg(F.count("*").alias("n_genomes"))
    rank = semantic_rank(seed, F.concat(F.lit(f"{namespace}:"), F.col("label")), F.col("group_id"))
    placed = ranked(groups, ["label"], rank, "group_id", "n_genomes")
    cuts = cut_candidates(placed, fraction, seed, namespace).groupBy("label").agg(F.min_by("idx", F.struct("distance", "tie", "idx")).alias("cut"))
    side = F.when(F.col("idx") <= F.col("cut"), "test").otherwise("train")
    return placed.join(F.broadcast(cuts), "label", "left").select("label", "group_id", side.alias("side"))  # two labels


def require_groups(genomes: DataFrame) -> None:
    """Each label needs two content groups, one for each side."""
    counts = {r["label"]: r["n"] for r in genomes.groupBy("label").agg(F.count_distinct("group_id").alias("n")).collect()}
    for label in ("virus", "host"):
        if counts.get(label, 0) < 2:
            raise ConfigurationError(f"{label} needs at least two content groups")


def genome_holdout(genomes: DataFrame, fraction: float = 0.20, seed: int = 42, namespace: str = "genome-holdout") -> DataFrame:
    """(genome_id, label, group_id, partition, reason) for genomes with genome_id, label and group_id."""
    sides = partition_groups(genomes, fraction, seed, namespace)
    return genomes.join(sides, ["label", "group_id"]).select(
        "genome_id", "label", "group_id", F.col("side").alias("partition"), F.lit("label_stratified_genome_holdout").alias("reason")
    )


def cutoff_candidates(genomes: DataFrame, fraction: float, seed: int) -> DataFrame:
    """(cutoff, label_error, overall_error, tie) for each date that leaves both labels on both sides.

    One row per distinct date, from running counts; only dated genomes count.
    """
    dated = genomes.where("release_date is not null")
    least = dated.groupBy("group_id").agg(F.min("release_date").alias("cutoff"))
    counts = dated.join(least, "group_id").groupBy("cutoff").agg(F.count_if(F.col("label") == "virus").alias("v"), F.count_if(F.col("label") == "host").alias("h"))
    run, whole = Window.orderBy("cutoff"), Window.partitionBy()
    c = counts.select(
        "cutoff", F.sum("v").over(run).alias("vt"), F.sum("h").over(run).alias("ht"), F.sum("v").over(whole).alias("v"), F.sum("h").over(whole).alias("h")
    ).where("vt > 0 and ht > 0 and v > vt and h > ht")
    label_error = F.abs((F.col("v") - F.col("vt")) / F.col("v") - fraction) + F.abs((F.col("h") - F.col("ht")) / F.col("h") - fraction)
    overall = F.abs((F.col("v") - F.col("vt") + F.col("h") - F.col("ht")) / (F.col("v") + F.col("h")) - fraction)
    tie = semantic_rank(seed, "temporal-cutoff", F.col("cutoff").cast("string"))
    return c.select("cutoff", F.round(label_error, 12).alias("label_error"), F.round(overall, 12).alias("overall_error"), tie.alias("tie"))


def choose_cutoff(genomes: DataFrame, fraction: float, seed: int):
    best = cutoff_candidates(genomes, fraction, seed).agg(F.min(F.struct("label_error", "overall_error", "tie", "cutoff")).alias("b")).first()["b"]
    if best is None:
        raise ConfigurationError("no release date leaves both labels on both sides")
    return best["cutoff"]


def temporal_holdout(genomes: DataFrame, cutoff, missing: str = "exclude", historical_snapshot: str | None = None) -> DataFrame:
    """Groups known on or before the cutoff train, later ones test; undated genomes are excluded or an error.

    A snapshot's name, if given, goes with every row as historical_snapshot.
    """
    if historical_snapshot is not None and not historical_snapshot.strip():
        raise ConfigurationError("historical_snapshot cannot be blank")
    least = genomes.groupBy("group_id").agg(F.min("release_date").alias("effective_date"))
    joined = genomes.join(least, "group_id")
    limit = F.lit(str(cutoff)).cast("date")
    if missing == "error" and not joined.where("release_date is null").isEmpty():
        raise ConfigurationError("genomes without a release date")
    own, group = F.col("release_date"), F.col("effective_date")
    partition = F.when(own.isNull(), "excluded").when(group <= limit, "train").otherwise("test")
    reason = (
        F.when(own.isNull(), "missing_release_date")
        .when(own <= limit, "release_date_on_or_before_cutoff")
        .when(group <= limit, "sequence_group_available_on_or_before_cutoff")
        .otherwise("release_date_after_cutoff")
    )
    named = [] if historical_snapshot is None else [F.lit(historical_snapshot.strip()).alias("historical_snapshot")]
    return joined.select("genome_id", "label", "group_id", partition.alias("partition"), reason.alias("reason"), "release_date", *named)


def choose_taxa(viruses: DataFrame, rank: str, count: int, seed: int) -> DataFrame:
    """(taxon): ``count`` represented taxa in seeded order; spellings that differ by case are one."""
    taxa = viruses.where("taxon is not null").groupBy(casefold(F.col("taxon")).alias("folded")).agg(F.min("taxon").alias("taxon"))
    return taxa.withColumn("_r", semantic_rank(seed, f"taxonomy:{rank}", F.col("folded"))).orderBy("_r", "folded").limit(count).select("taxon")


def taxonomic_holdout(genomes: DataFrame, held: list[str], rank: str = "family", fraction: float = 0.20, seed: int = 42) -> DataFrame:
    """Viruses of the held-out taxa test, other viruses train; hosts by the genome holdout.

    genomes has a taxon column, the value of the rank.
    """
    folded = [t.casefold() for t in held]
    v = genomes.where("label = 'virus'")
    t = casefold(F.col("taxon"))
    partition = F.when(t.isNull(), "excluded").when(t.isin(folded), "test").otherwise("train")
    reason = F.when(t.isNull(), f"missing_taxonomy_{rank}").when(t.isin(folded), "selected_taxon_holdout").otherwise("non_holdout_taxon")
    viral = v.select("genome_id", "label", "group_id", partition.alias("partition"), reason.alias("reason"), "taxon")
    hosts = genome_holdout(genomes.where("label = 'host'"), fraction, seed, "taxonomy:host")
    return viral.unionByName(
        hosts.select("genome_id", "label", "group_id", "partition", F.lit("host_label_stratified_genome_holdout").alias("reason"), F.lit(None).cast("string").alias("taxon"))
    )


EVIDENCE = (
    "nearest_train_genome_id", "max_train_similarity", "similarity_coverage", "similarity_method", "strict_gate_train_genome_id",
    "strict_gate_similarity", "strict_gate_coverage", "strict_gate_method",
)


def similarity_proposal(genomes: DataFrame, fraction: float = 0.20, seed: int = 42) -> DataFrame:
    return genome_holdout(genomes, fraction, seed, "similarity-proposal").withColumnRenamed("partition", "candidate_partition").drop("reason")


def apply_gate(proposal: DataFrame, hits: DataFrame, most: float = 0.95, bands: tuple[float, float, float] = (0.90, 0.70, 0.30)) -> DataFrame:
    """The final sides from a proposal and its candidates' hits (genome_id and the evidence columns).

    Training rows carry no evidence; an excluded candidate keeps candidate_partition test.
    """
    test = F.col("candidate_partition") == "test"
    j = proposal.join(hits, "genome_id", "left")
    excluded = test & F.col("strict_gate_similarity").isNotNull()
    top = F.col("max_train_similarity")
    return j.select(
        "genome_id",
        "label",
        "group_id",
        F.when(~test, "train").when(excluded, "excluded").otherwise("test").alias("partition"),
        "candidate_partition",
        F.when(~test, "label_stratified_training_proposal").otherwise(sim.gate_reason(top, excluded, most)).alias("reason"),
        F.when(test, sim.classify(top, *bands)).alias("similarity_bin"),
        *[F.when(test, F.col(c)).alias(c) for c in EVIDENCE],
    )


def sketch_hits(proposal: DataFrame, sketched: DataFrame, k: int, size: int, most: float) -> DataFrame:
    """Evidence for the test candidates of a proposal from genome sketches (genome_id, hashes, is_exact)."""
    sided = sketched.join(proposal.select("genome_id", (F.col("candidate_partition") == "test").alias("side")), "genome_id")
    equal = F.sha2(F.concat_ws(",", F.col("hashes").cast("array<string>"), F.col("is_exact").cast("string")), 256)
    classes = sided.groupBy("side", equal.alias("class")).agg(
        F.any_value("hashes").alias("hashes"), F.any_value("is_exact").alias("is_exact"), F.min("genome_id").alias("first"), F.collect_list(F.when(F.col("side"), F.col("genome_id"))).alias("members")
    )
    near = sim.nearest_of_classes(materialize(classes, "sketch-classes"), k, size)
    method = F.lit(f"kmer_mash_k{k}_s{size}")
    top = F.col("max_similarity")
    gate = top > most
    return near.select(
        F.col("query_id").alias("genome_id"),
        F.col("nearest_id").alias("nearest_train_genome_id"),
        top.alias("max_train_similarity"),
        F.lit(None).cast("double").alias("similarity_coverage"),
        method.alias("similarity_method"),
        F.when(gate, F.col("nearest_id")).alias("strict_gate_train_genome_id"),
        F.when(gate, top).alias("strict_gate_similarity"),
        F.lit(None).cast("double").alias("strict_gate_coverage"),
        F.when(gate, method).alias("strict_gate_method"),
    )


def exclusion_rows(assignments: DataFrame, split: str) -> DataFrame:
    """What the exclusions table lists of a plan."""
    cols = [c for c in EVIDENCE if c in assignments.columns]
    return assignments.where("partition = 'excluded'").select("genome_id", "label", F.lit(split).alias("split"), "reason", *cols)
