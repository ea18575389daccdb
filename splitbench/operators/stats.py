"""Fragment statistics, truth summaries and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .similarity import NO_MATCH

BANDS = (NO_MATCH, "distant_detectable", "low_similarity", "moderate_similarity", "high_similarity")
TRUTH_COLUMNS = (
    "sequence_id", "label", "source_accession_version", "source_genome_id", "source_content_group_id", "source_sequence_id", "source_start",
    "source_end", "coordinate_system", "strand", "fragment_length", "partition", "view", "similarity_bin", "max_train_similarity",
    "nearest_train_genome_id", "release_date", "synthetic",
)


def partition_stats(fragments: DataFrame, *by: str) -> DataFrame:
    """Records, bases and base composition; fractions are null where there are no bases."""
    n = F.length("sequence").cast("long")
    counted = fragments.select(*by, "genome_id", n.alias("n"), dna.count_of(F.col("sequence"), "GC").alias("gc"), dna.ambiguous_count(F.col("sequence")).alias("amb"))
    sums = counted.groupBy(*by).agg(
        F.count("*").alias("records"), F.sum("n").alias("bases"), F.sum("gc").alias("gc"), F.sum("amb").alias("amb"), F.count_distinct("genome_id").alias("source_genomes")
    )
    share = lambda c: F.when(F.col("bases") > 0, F.col(c) / F.col("bases"))
    return sums.select(*by, "records", "bases", share("gc").alias("gc_fraction"), share("amb").alias("ambiguous_fraction"), "source_genomes")


def record_counts(fragments: DataFrame, *by: str) -> DataFrame:
    """Records by label, by length, by both and by genome: one pass over grouping sets."""
    sets = fragments.withColumn("length", F.length("sequence")).groupingSets(
        [[*map(F.col, by), F.col("label")], [*map(F.col, by), F.col("label"), F.col("length")], [*map(F.col, by), F.col("length")], [*map(F.col, by), F.col("genome_id")]],
        *map(F.col, by), F.col("label"), F.col("length"), F.col("genome_id"),
    )
    counted = sets.agg(F.count("*").alias("n"), F.grouping("label").alias("no_label"), F.grouping("length").alias("no_length"), F.grouping("genome_id").alias("no_genome"))
    kind = (
        F.when(F.col("no_genome") == 0, "genome")
        .when((F.col("no_label") == 0) & (F.col("no_length") == 0), "label_and_length")
        .when(F.col("no_label") == 0, "label")
        .otherwise("length")
    )
    key = F.coalesce(F.when(F.col("no_genome") == 0, F.col("genome_id")), F.concat_ws(":", "label", F.col("length").cast("string")))
    return counted.select(*by, kind.alias("counted_by"), key.alias("key"), "n")


def stats_maps(fragments: DataFrame) -> dict:
    """The statistics of one partition as a driver-side record, maps in their documented order."""
    total = partition_stats(fragments).first()
    maps: dict[str, dict[str, int]] = {f"records_by_{k}": {} for k in ("label", "label_and_length", "length", "genome")}
    rows = sorted(record_counts(fragments).collect(), key=lambda r: (r["counted_by"], int(r["key"]) if r["counted_by"] == "length" else 0, r["key"]))
    for r in rows:
        maps[f"records_by_{r['counted_by']}"][r["key"]] = r["n"]
    head = {k: total[k] for k in ("records", "bases", "gc_fraction", "ambiguous_fraction", "source_genomes")}
    head["bases"] = head["bases"] or 0
    return head | maps


def truth_summary(truth: DataFrame) -> DataFrame:
    return truth.groupBy("partition", "label").agg(F.count("*").alias("n"))


def truth_view(fragments: DataFrame, assignments: DataFrame, contigs: DataFrame, view: str | None = None) -> DataFrame:
    """The 18 truth columns of fragments; date and accession are the segment's, not the genome's."""
    details = assignments.select("genome_id", "partition", F.col("group_id").alias("source_content_group_id"), *_evidence(assignments))
    segment = contigs.select("genome_id", "sequence_id", "accession_version", "release_date", "topology")
    own = fragments.drop("partition") if "partition" not in assignments.columns or "partition" in fragments.columns else fragments
    joined = own.join(details, "genome_id").join(segment, ["genome_id", "sequence_id"])
    return joined.select(
        F.col("fragment_id").alias("sequence_id"),
        "label",
        F.col("accession_version").alias("source_accession_version"),
        F.col("genome_id").alias("source_genome_id"),
        "source_content_group_id",
        F.col("sequence_id").alias("source_sequence_id"),
        F.col("start").alias("source_start"),
        F.col("end").alias("source_end"),
        F.when(F.col("topology") == "circular", "zero_based_half_open_unwrapped").otherwise("zero_based_half_open").alias("coordinate_system"),
        "strand",
        "fragment_length",
        "partition",
        (F.lit(view) if view else F.col("partition")).alias("view"),
        "similarity_bin",
        "max_train_similarity",
        "nearest_train_genome_id",
        "release_date",
        F.lit(True).alias("synthetic"),
    )


def _evidence(assignments: DataFrame) -> list:
    kinds = {"similarity_bin": "string", "max_train_similarity": "double", "nearest_train_genome_id": "string"}
    return [F.col(c) if c in assignments.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]


def strata_views(truth: DataFrame) -> DataFrame:
    """Records per similarity band of the test candidates; every band has a row, even an empty one."""
    spark = truth.sparkSession
    bands = spark.createDataFrame([(b,) for b in BANDS], "similarity_bin string")
    counted = truth.groupBy("similarity_bin").agg(F.count("*").alias("n"))
    return bands.join(counted, "similarity_bin", "left").select("similarity_bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
