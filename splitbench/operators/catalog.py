"""The reference catalogue: contigs, their metadata, genomes and content groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dna, hashing, text

RANKS = ("realm", "kingdom", "phylum", "class", "order", "family", "genus", "species")
VIRUS, HOST = "virus", "host"


def metadata_join_audit(contigs: DataFrame, metadata: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Sequences without metadata and metadata without a sequence: one full join."""
    c = contigs.select(key, F.lit(True).alias("in_contigs"))
    m = metadata.select(key, F.lit(True).alias("in_metadata"))
    problem = F.when(F.col("in_metadata").isNull(), "missing_metadata").when(F.col("in_contigs").isNull(), "unused_metadata")
    return c.join(m, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def join_metadata(contigs: DataFrame, metadata: DataFrame, key: str = "sequence_id") -> DataFrame:
    return contigs.join(metadata, key, "left")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def label_channel_conflicts(df: DataFrame) -> DataFrame:
    """Rows whose metadata label, if any, is not that of the channel they came in by."""
    own = F.lower(F.trim("metadata_label"))
    return df.where(own.isNotNull() & (own != "") & (own != F.col("channel")))


def with_digests(contigs: DataFrame, domain: str = hashing.DOMAIN, native_rotation: bool = False) -> DataFrame:
    """contigs with length_nt, sha256, canonical_sha256 and linear_sha256.

    Rotations are only computed for circular rows.
    """
    seq, circular = F.col("sequence"), F.col("topology") == "circular"
    canonical = F.when(circular, dna.canonical_circular(F.when(circular, seq), native_rotation)).otherwise(dna.canonical(seq))
    return contigs.withColumns(
        {
            "length_nt": F.length(seq).cast("long"),
            "sha256": F.sha2(seq, 256),
            "canonical_sha256": hashing.sequence_digest(canonical, circular, domain),
            "linear_sha256": hashing.sequence_digest(dna.canonical(seq), False, domain),
        }
    )


def all_or_nothing_date(date: Column) -> Column:
    """Aggregate: the latest date if every row has one, else null."""
    return F.when(F.count(date) == F.count(F.lit(1)), F.max(date))


def only_value(value: Column) -> Column:
    """Aggregate: the value if exactly one distinct value is known, else null."""
    return F.when(F.min(value) == F.max(value), F.max(value))


def genomes_from_contigs(contigs: DataFrame, domain: str = hashing.DOMAIN) -> DataFrame:
    """One row per genome from contigs with digests; taxonomy and extras are joined by their own operators."""
    return contigs.groupBy("genome_id").agg(
        F.max("label").alias("label"),
        F.count("*").alias("contig_count"),
        F.sum("length_nt").alias("length_nt"),
        all_or_nothing_date(F.col("release_date")).alias("release_date"),
        only_value(F.col("accession_version")).alias("accession_version"),
        hashing.genome_digest(F.col("canonical_sha256"), domain).alias("digest"),
        hashing.topology_agnostic_digest(F.col("linear_sha256"), domain).alias("agnostic_digest"),
        F.sort_array(F.collect_list("sequence_id")).alias("sequence_ids"),
    )


def mixed_label_genomes(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("genome_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("genome_id")


def taxonomy_conflicts(ranked: DataFrame, genome: str = "genome_id") -> DataFrame:
    """(genome, rank, n_values) where a genome's segments disagree; segments without the rank do not count.

    ranked has the genome, rank and value columns, one row per segment and rank.
    """
    known = ranked.where("value is not null and value <> ''")
    return known.groupBy(genome, "rank").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def common_extras(extras: DataFrame, sizes: DataFrame, genome: str = "genome_id") -> DataFrame:
    """(genome, key, value) that every segment has with one value.

    extras has genome, key and value, one row per segment and key; sizes has
    genome and n, its number of segments.
    """
    same = extras.groupBy(genome, "key").agg(F.count("*").alias("have"), F.min("value").alias("value"), F.max("value").alias("other"))
    return same.where("value = other").join(sizes, genome).where("have = n").select(genome, "key", "value")


def content_groups(genomes: DataFrame) -> DataFrame:
    """One row per digest: its genomes and labels, counted."""
    return genomes.groupBy("digest").agg(
        F.min("genome_id").alias("first_genome_id"),
        F.count("*").alias("n_genomes"),
        F.count_distinct("label").alias("n_labels"),
    )


def cross_label_conflicts(genomes: DataFrame, digest: str = "agnostic_digest") -> DataFrame:
    """Digests that occur under both labels, whatever the topology."""
    both = genomes.groupBy(F.col(digest).alias("digest")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n_genomes"))
    return both.where("a <> b").select("digest", "n_genomes")


def rank_duplicates(genomes: DataFrame) -> DataFrame:
    """genomes with duplicate_of: the representative of their content and label, null for itself.

    The representative has the earliest date, undated genomes last, then the smallest id.
    """
    best = F.min(F.struct(F.col("release_date").isNull().alias("undated"), F.col("release_date").alias("date"), F.col("genome_id").alias("id")))
    chosen = genomes.groupBy("digest", "label").agg(best.alias("best")).select("digest", "label", F.col("best.id").alias("representative"))
    joined = genomes.join(chosen, ["digest", "label"])
    return joined.withColumn("duplicate_of", F.when(F.col("genome_id") != F.col("representative"), F.col("representative"))).drop("representative")


def duplicate_audit(genomes: DataFrame) -> DataFrame:
    """What a representative records of the genomes dropped for it, one row per group of copies."""
    ranked = rank_duplicates(genomes)
    keeper = F.coalesce("duplicate_of", "genome_id")
    return (
        ranked.groupBy(keeper.alias("genome_id"))
        .agg(
            F.count("*").alias("n_copies"),
            F.min("release_date").alias("earliest_release_date"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("duplicate_of").isNotNull(), F.col("genome_id")))), ",").alias("dropped_ids"),
        )
        .where("n_copies > 1")
    )


def copy_taxonomy_conflicts(genomes: DataFrame) -> DataFrame:
    """(digest, label, n_taxonomies): copies of one class whose taxonomies, maps of ranks, are not the same."""
    known = text.sorted_map_json(F.coalesce(F.col("taxonomy"), F.create_map().cast("map<string,string>")))
    return genomes.groupBy("digest", "label").agg(F.count_distinct(known).alias("n_taxonomies")).where("n_taxonomies > 1")


#: Fixed value: how the date of a merged genome is chosen.
MERGE_POLICY = "earliest_known_public_release"


def merge_facts(genomes: DataFrame, contigs: DataFrame) -> DataFrame:
    """(genome_id, facts): what a kept genome records of all copies of its class, itself included.

    genomes have genome_id, label, digest, release_date and duplicate_of; contigs
    genome_id, accession_version and sha256.  Genomes without a copy have no row.
    """
    keeper = F.coalesce("duplicate_of", "genome_id").alias("keeper")
    copies = genomes.select(keeper, "genome_id", "release_date")
    shown = F.concat_ws(":", "genome_id", F.coalesce(F.col("release_date").cast("string"), F.lit("unknown")))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    own = copies.groupBy("keeper").agg(F.count("*").alias("n"), joined(F.collect_list("genome_id")).alias("ids"), F.array_sort(F.collect_list(F.struct("genome_id", shown.alias("shown")))).alias("dates"))
    own = own.where("n > 1").withColumn("dates", F.array_join(F.col("dates.shown"), ","))
    of_contigs = contigs.join(copies.select("genome_id", "keeper"), "genome_id").join(own.select("keeper"), "keeper", "left_semi")
    told = of_contigs.groupBy("keeper").agg(joined(F.collect_set("accession_version")).alias("accessions"), joined(F.collect_set("sha256")).alias("digests"))
    fact = lambda k, v: (F.lit(k), v)
    facts = [
        *fact("duplicate_genome_ids", F.col("ids")),
        *fact("duplicate_accession_versions", F.col("accessions")),
        *fact("duplicate_release_dates", F.col("dates")),
        *fact("duplicate_source_sequence_digests", F.col("digests")),
        *fact("duplicate_merge_policy", F.lit(MERGE_POLICY)),
    ]
    return own.join(told, "keeper").select(F.col("keeper").alias("genome_id"), F.create_map(*facts).alias("facts"))


def effective_dates(genomes: DataFrame) -> DataFrame:
    """genomes with effective_date: the earliest known date of their content group."""
    least = genomes.groupBy("group_id").agg(F.min("release_date").alias("effective_date"))
    return genomes.join(least, "group_id")


def stable_id_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(~text.is_stable_id(F.col(column)))


def label_counts(genomes: DataFrame) -> DataFrame:
    return genomes.groupBy("label").agg(F.count("*").alias("n"))


def ordered_inventory(genomes: DataFrame) -> DataFrame:
    return genomes.orderBy("label", "genome_id")


def row_numbers(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)))
