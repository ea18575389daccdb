"""Every registered query with SQL gives the SQL's rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from splitbench.config import BenchmarkConfig
from splitbench.plans import protocols
from splitbench.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_casefold_of_whole_texts(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.folded for r in QUERIES["taxon_casefold"](spark, sf_dir).collect()} == {i: t and t.upper().casefold() for i, t in texts.items()}


def test_metadata_audit_reports_documents_of_all_languages(spark, sf_dir):
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {(r.sequence_id, r.problem) for r in QUERIES["metadata_join_audit"](spark, sf_dir).collect()}
    assert rows == {(i, "missing_metadata") for i in docs - labels} | {(i, "unused_metadata") for i in {*labels, -1} - docs}


def test_fasta_scan_of_odd_documents(spark, tmp_path):
    """Contigs without a letter, without text, and of odd or no sources."""
    texts = ["An odd text", "12 %!", "", None, "a", "ab", "日本", "x"]
    sources = ["src1", "src2", None, "src4", None, "", " a  b\n>c%20+ ", "src8"]
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(zip(texts, sources))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["fasta_scan"](spark, str(tmp_path)).select("sequence_id", "description", "sha256").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(f"SELECT sequence_id, description, sha256 FROM ({ORACLES['fasta_scan']})").fetchall()) and len(got) == 8


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_similarity_recheck_keeps_no_sketches_and_lists_no_pairs(spark, sf_dir):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in root.iterdir()}
    plan = QUERIES["similarity_recheck"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not [p.name for p in root.iterdir() if p.name.startswith("sketches-") and p.name not in before]
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan


def test_similarity_recheck_uses_sketches_of_the_default_size(spark, sf_dir, monkeypatch):
    given, hits = [], protocols.sketch_hits
    monkeypatch.setattr(protocols, "sketch_hits", lambda *a: given.append(a[2:4]) or hits(*a))
    QUERIES["similarity_recheck"](spark, sf_dir)
    assert given == [(BenchmarkConfig.similarity_k, BenchmarkConfig.sketch_size)] == [(21, 2_000)]
    assert "[1:2000]" in ORACLES["similarity_recheck"] and "[1:100]" not in ORACLES["similarity_recheck"]
