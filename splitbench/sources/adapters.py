"""The engine's tables as projections of general tables: documents, orders, parts, events, line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..session import spread

#: Letters to nucleotides, in alphabet order.
ALPHABET, NUCLEOTIDES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nucleotides(text):
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), ALPHABET, NUCLEOTIDES)


def contigs_from_documents(spark: SparkSession, sf_dir: str, iupac: bool = False) -> DataFrame:
    """One linear or circular contig per document; every fifth is circular, hosts are every third id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    sequence = F.upper(F.regexp_replace("text", f"[^{dna.IUPAC}{dna.IUPAC.lower()}]", "")) if iupac else nucleotides(F.col("text"))
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("sequence_id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("genome_id"),
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "host").otherwise("virus").alias("label"),
        sequence.alias("sequence"),
        F.when(F.col("doc_id") % 5 == 0, "circular").otherwise("linear").alias("topology"),
        F.col("lang").alias("family"),
        F.col("source").alias("genus"),
        F.lit(None).cast("string").alias("accession_version"),
        F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).alias("release_date"),
    )


def segments_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments (orders) of genomes (customers); every seventh has no date, every third an accession of its priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return o.join(places, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").alias("genome_id"),
        F.col("o_orderkey").alias("sequence_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate")).alias("release_date"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("accession_version"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "host").otherwise("virus").alias("label"),
        F.col("n_name").alias("family"),
        F.col("r_name").alias("order_rank"),
        F.col("o_orderstatus").alias("status"),
    )


def intervals_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of users in seconds; every third event is on the test side."""
    e = table(spark, sf_dir, "events")
    start = F.unix_timestamp("ts")
    return e.select(
        "event_id",
        "user_id",
        start.alias("start"),
        (start + 60 * (F.col("event_id") % 10 + 1)).alias("end"),
        F.when(F.col("event_id") % 3 == 0, "test").otherwise("train").alias("partition"),
    )


def matrix_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity table with duplicate and missing pairs, undetected where the line number is 7."""
    li = table(spark, sf_dir, "lineitem")
    seen = F.col("l_linenumber") != 7
    return li.select(
        F.col("l_suppkey").alias("query_genome_id"),
        F.col("l_partkey").alias("reference_genome_id"),
        F.when(seen, F.round(F.col("l_discount") * 10, 2)).alias("similarity"),
        F.when(seen, F.round(1 - 10 * F.col("l_tax"), 2)).alias("coverage"),
        F.concat(F.lit("aligner-"), F.col("l_linenumber")).alias("method"),
        F.col("l_orderkey").alias("row_key"),
        F.col("l_linenumber").alias("row_line"),
    )


def distinct_matrix(matrix: DataFrame) -> DataFrame:
    """One row per pair: that of the smallest key, then the most similar."""
    row = F.struct("row_key", "row_line", F.coalesce("similarity", F.lit(-1.0)).alias("s"), F.coalesce("coverage", F.lit(-1.0)).alias("c"))
    best = matrix.groupBy("query_genome_id", "reference_genome_id").agg(F.min_by(F.struct("similarity", "coverage", "method"), row).alias("b"))
    return best.select("query_genome_id", "reference_genome_id", "b.*")
