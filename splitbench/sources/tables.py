"""Metadata and similarity tables in TSV or CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, require_empty
from ..functions import text
from ..operators.catalog import RANKS, duplicate_keys
from ..session import materialize

KNOWN = ("sequence_id", "genome_id", "label", "accession_version", "release_date", "topology")
REJECTED = ("deposited_at", "create_date")
SIMILARITY_COLUMNS = ("query_genome_id", "reference_genome_id", "similarity", "coverage", "coverage_definition", "method")


def normalize_header(names: list[str]) -> list[str]:
    """Strip, lower-case, hyphens and spaces to underscores; repeats are an error."""
    out = [n.lstrip("﻿").strip().lower().replace("-", "_").replace(" ", "_") for n in names]
    if len(set(out)) != len(out) or not all(out):
        raise InputError(f"column names repeat or are blank: {', '.join(out)}")
    return out


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; a file is CSV by its suffix, else TSV."""
    sep = "," if path.lower().endswith(".csv") else "\t"
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, encoding="UTF-8", mode="FAILFAST", enforceSchema=False)
    return df.toDF(*normalize_header(df.columns))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Typed metadata: the known columns, taxonomy and metadata_extra maps."""
    cells = read_cells(spark, path)
    have = cells.columns
    if "sequence_id" not in have:
        raise InputError(f"{path}: no sequence_id column")
    if old := [c for c in REJECTED if c in have]:
        raise InputError(f"{path}: use release_date instead of {', '.join(old)}")
    if cells.isEmpty():
        raise InputError(f"{path}: no data rows")
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    filled = {c: text.blank_to_null(col(c)) for c in KNOWN}
    ranks = {r: text.first_filled(col(r), col(f"tax_{r}")) for r in RANKS}
    rest = [c for c in have if c not in KNOWN and c not in RANKS and c.removeprefix("tax_") not in RANKS]
    pairs = lambda d: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), v) for k, v in d.items()]), lambda e: e["col2"].isNotNull())) if d else F.create_map().cast("map<string,string>")
    out = cells.select(
        filled["sequence_id"].alias("sequence_id"),
        filled["genome_id"].alias("genome_id"),
        F.lower(filled["label"]).alias("label"),
        filled["accession_version"].alias("accession_version"),
        filled["release_date"].alias("date_text"),
        text.iso_date(col("release_date")).alias("release_date"),
        F.lower(F.coalesce(filled["topology"], F.lit("linear"))).alias("topology"),
        pairs(ranks).alias("taxonomy"),
        pairs({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in rest}).alias("metadata_extra"),
    )
    out = materialize(out, "metadata")
    checks = {
        "blank or malformed sequence_id": ~text.is_stable_id(F.col("sequence_id")),
        "malformed genome_id": F.col("genome_id").isNotNull() & ~text.is_stable_id(F.col("genome_id")),
        "label must be virus or host": ~F.coalesce(F.col("label").isin("virus", "host"), F.lit(True)),
        "release_date must be YYYY-MM-DD": F.col("date_text").isNotNull() & F.col("release_date").isNull(),
        "topology must be linear or circular": ~F.col("topology").isin("linear", "circular"),
    }
    for what, bad in checks.items():
        require_empty(out.where(bad).select("sequence_id"), f"{path}: {what}")
    require_empty(duplicate_keys(out, "sequence_id"), f"{path}: sequence_id repeats")
    return out.drop("date_text")


def similarity_violations(table: DataFrame, queries: DataFrame, references: DataFrame) -> DataFrame:
    """(check, query_genome_id, reference_genome_id) for everything wrong with a similarity table.

    table has the six columns as text; queries and references have genome_id.
    """
    sim, cov = text.fraction(F.col("similarity")), text.fraction(F.col("coverage"))
    blank = lambda c: text.blank_to_null(F.col(c)).isNull()
    row = (
        F.when(blank("similarity") != blank("coverage"), "similarity_and_coverage_must_both_be_blank_or_filled")
        .when(~blank("similarity") & (sim.isNull() | cov.isNull()), "not_a_fraction")
        .when(F.col("coverage_definition") != "aligned_fraction_shorter", "coverage_definition")
        .when(blank("method") | ~F.col("method").rlike("[0-9]"), "method_without_version")
    )
    key = ["query_genome_id", "reference_genome_id"]
    rows = table.withColumn("check", row).where("check is not null").select("check", *key)
    twice = duplicate_keys(table, *key).select(F.lit("repeated_pair").alias("check"), *key)
    ids = lambda d, c: d.select(F.col("genome_id").alias(c)).distinct()
    q, r = ids(queries, key[0]), ids(references, key[1])
    strange = [table.join(d, c, "left_anti").select(F.lit("unknown_id").alias("check"), *key) for d, c in ((q, key[0]), (r, key[1]))]
    n = references.select("genome_id").distinct().count()
    per = q.join(table.groupBy(key[0]).agg(F.count_distinct(key[1]).alias("n")), key[0], "left").where(F.coalesce("n", F.lit(0)) < n)
    missing = per.select(F.lit("missing_pairs").alias("check"), key[0], F.lit(None).cast("string").alias(key[1]))
    return reduce(DataFrame.unionByName, [rows, twice, *strange, missing])


def read_similarity(spark: SparkSession, path: str, queries: DataFrame, references: DataFrame) -> DataFrame:
    """A checked similarity table for these candidates and training genomes; other rows of known genomes are left out."""
    cells = read_cells(spark, path)
    if lack := [c for c in SIMILARITY_COLUMNS if c not in cells.columns]:
        raise InputError(f"{path}: missing columns {', '.join(lack)}")
    q, r = (d.select(F.col("genome_id").alias(c)) for d, c in ((queries, "query_genome_id"), (references, "reference_genome_id")))
    mine = materialize(cells.join(q, "query_genome_id", "left_semi").join(r, "reference_genome_id", "left_semi"), "similarity")
    require_empty(similarity_violations(mine, queries, references), f"{path}: unusable similarity table")
    return mine.select(
        "query_genome_id",
        "reference_genome_id",
        text.fraction(F.col("similarity")).alias("similarity"),
        text.fraction(F.col("coverage")).alias("coverage"),
        "method",
    )
