"""The registry's decorator, and what several queries and their SQL share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, hashing
from ..sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 42


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def genomes_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs from documents with digest and group_id, every contig hashed as linear."""
    c = adapters.contigs_from_documents(spark, sf_dir)
    digest = hashing.sequence_digest(dna.canonical(F.col("sequence")), False)
    return c.withColumn("digest", digest).withColumn("group_id", hashing.group_id(F.col("digest")))


SQL_CONTIGS = """contigs AS (
  SELECT 'doc-' || doc_id AS sequence_id, 'doc-' || doc_id AS genome_id, doc_id,
    CASE WHEN doc_id % 3 = 0 THEN 'host' ELSE 'virus' END AS label,
    translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence,
    CASE WHEN doc_id % 5 = 0 THEN 'circular' ELSE 'linear' END AS topology, lang AS family, source AS genus,
    DATE '2018-01-01' + CAST(doc_id % 1500 AS INTEGER) AS release_date
  FROM documents)"""


def sql_rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')"


def sql_digest(canonical: str, topology: str = "linear") -> str:
    return (
        f"sha256(encode('SPLITBENCH-CONTIG-SHA256-v2') || '\\x00'::BLOB || encode('{topology}') || '\\x00'::BLOB "
        f"|| unhex(printf('%016x', length({canonical}))) || encode({canonical}))"
    )


SQL_GENOMES = f"""{SQL_CONTIGS}, genomes AS (
  SELECT *, 'sha256:' || digest AS group_id FROM (SELECT *, {sql_digest(f"least(sequence, {sql_rc('sequence')})")} AS digest FROM contigs))"""


def sql_draw(h: str) -> str:
    return f"('0x' || substr({h}, 1, 15))::BIGINT"


def sql_ranked(groups: str, namespace: str, weight: str = "n_genomes") -> str:
    """The SQL twin of protocols.ranked() and its cut, over a CTE of (label, group_id, n_genomes)."""
    return f"""
  placed AS (
    SELECT *, row_number() OVER w AS idx, sum({weight}) OVER (PARTITION BY label ORDER BY rank, group_id ROWS UNBOUNDED PRECEDING) AS cum,
      sum({weight}) OVER (PARTITION BY label) AS total, count(*) OVER (PARTITION BY label) AS n_groups
    FROM (SELECT *, sha256('{SEED}|{namespace}:' || label || '|' || group_id) AS rank FROM {groups})
    WINDOW w AS (PARTITION BY label ORDER BY rank, group_id)),
  candidates AS (
    SELECT label, idx, cum, abs(cum - total * CAST(0.2 AS DOUBLE)) AS distance, sha256('{SEED}|{namespace}:' || label || ':cut|' || idx) AS tie FROM placed WHERE idx < n_groups),
  cuts AS (SELECT label, min_by(idx, (distance, tie, idx)) AS cut FROM candidates GROUP BY label),
  sides AS (SELECT label, group_id, CASE WHEN idx <= cut THEN 'test' ELSE 'train' END AS side FROM placed JOIN cuts USING (label))"""
