"""Seeded ranks and the genome, temporal and taxonomic holdouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import audit, catalog
from ..plans import protocols
from ..session import materialize
from ..sources import adapters
from .common import SEED, SQL_GENOMES, genomes_from_documents, query, sql_draw, sql_ranked

_ONE = f"""WITH {SQL_GENOMES}, clean AS (SELECT * FROM genomes WHERE group_id NOT IN (SELECT group_id FROM genomes GROUP BY group_id HAVING min(label) <> max(label))),
  groups AS (SELECT label, group_id, count(*) AS n_genomes FROM clean GROUP BY label, group_id)"""


def clean_genomes(spark, sf_dir):
    """Genomes of groups that have one label: what is left after the conflict check.

    Digests are computed once; what follows works on ids and digests, not sequences.
    """
    g = genomes_from_documents(spark, sf_dir).select("genome_id", "doc_id", "label", "group_id", "digest", "family", "genus", "release_date")
    g = materialize(g, "genomes")
    return g.join(catalog.cross_label_conflicts(g, "digest").select("digest"), "digest", "left_anti")


@query(f"SELECT p_partkey, sha256('{SEED}|demo|' || p_partkey) AS rank, {sql_draw(f'''sha256('{SEED}|demo|' || p_partkey)''')} AS draw FROM part")
def semantic_rank(spark, sf_dir):
    rank = hashing.semantic_rank(SEED, "demo", F.col("p_partkey"))
    return adapters.table(spark, sf_dir, "part").select("p_partkey", rank.alias("rank"), hashing.draw(rank).alias("draw"))


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY sha256('{SEED}|output-order:part|' || p_partkey), p_partkey) AS place FROM part")
def semantic_output_order(spark, sf_dir):
    """The seeded output order as places, ranked in buckets of the hash's first digits."""
    p = adapters.table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("one"), F.lit("all").alias("label"))
    placed = protocols.ranked(p, ["label"], hashing.semantic_rank(SEED, "output-order:part", F.col("p_partkey")), "p_partkey", "one")
    return placed.select("p_partkey", F.col("idx").alias("place"))


@query()
def semantic_rank_blake2(spark, sf_dir):
    return adapters.table(spark, sf_dir, "part").select("p_partkey", hashing.semantic_rank_blake2(SEED, "demo", F.col("p_partkey")).alias("rank"))


_HOLD = f"{_ONE}, {sql_ranked('groups', 'genome-holdout')}"


@query(f"{_HOLD} SELECT genome_id, label, group_id, side AS partition, 'label_stratified_genome_holdout' AS reason FROM clean JOIN sides USING (label, group_id)")
def genome_holdout(spark, sf_dir):
    return protocols.genome_holdout(clean_genomes(spark, sf_dir), 0.2, SEED)


@query(f"{_HOLD} SELECT label, idx, CAST(cum AS BIGINT) AS cum, round(distance, 6) AS distance, tie FROM candidates")
def genome_holdout_cut_candidates(spark, sf_dir):
    g = clean_genomes(spark, sf_dir).groupBy("label", "group_id").agg(F.count("*").alias("n_genomes"))
    rank = hashing.semantic_rank(SEED, F.concat(F.lit("genome-holdout:"), "label"), F.col("group_id"))
    placed = protocols.ranked(g, ["label"], rank, "group_id", "n_genomes")
    return protocols.cut_candidates(placed, 0.2, SEED, "genome-holdout").withColumn("distance", F.round("distance", 6))


_TEMP = """WITH g AS (SELECT o_custkey AS genome_id, CASE WHEN any_value(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN 'host' ELSE 'virus' END AS label,
    (CASE WHEN any_value(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN 'host' ELSE 'virus' END) || '-' || (o_custkey // 2) AS group_id,
    CASE WHEN o_custkey % 11 <> 0 THEN CAST(max(o_orderdate) AS DATE) END AS release_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey),
  e AS (SELECT *, min(release_date) OVER (PARTITION BY group_id) AS effective_date FROM g)"""


def _temporal(spark, sf_dir):
    """Customers as dated genomes, in groups of two ids of one label."""
    s = adapters.segments_from_orders(spark, sf_dir)
    o = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("genome_id")).agg(F.to_date(F.max("o_orderdate")).alias("d"))
    g = s.select("genome_id", "label").distinct().join(o, "genome_id")
    group = F.concat_ws("-", "label", F.expr("genome_id div 2"))
    return g.select("genome_id", "label", group.alias("group_id"), F.when(F.col("genome_id") % 11 != 0, F.col("d")).alias("release_date"))


def _sides(cutoff: str) -> str:
    return f"""SELECT genome_id, label, group_id, CASE WHEN release_date IS NULL THEN 'excluded' WHEN effective_date <= {cutoff} THEN 'train' ELSE 'test' END AS partition,
  CASE WHEN release_date IS NULL THEN 'missing_release_date' WHEN release_date <= {cutoff} THEN 'release_date_on_or_before_cutoff'
    WHEN effective_date <= {cutoff} THEN 'sequence_group_available_on_or_before_cutoff' ELSE 'release_date_after_cutoff' END AS reason, release_date FROM e"""


@query(f"{_TEMP} {_sides('''DATE '2001-01-01' ''')}")
def temporal_explicit(spark, sf_dir):
    return protocols.temporal_holdout(_temporal(spark, sf_dir), "2001-01-01")


_CUTS = f"""{_TEMP}, d AS (SELECT effective_date AS cutoff, count(*) FILTER (label = 'virus') AS v, count(*) FILTER (label = 'host') AS h FROM e WHERE release_date IS NOT NULL GROUP BY effective_date),
  c AS (SELECT cutoff, sum(v) OVER w AS vt, sum(h) OVER w AS ht, sum(v) OVER () AS va, sum(h) OVER () AS ha FROM d WINDOW w AS (ORDER BY cutoff)),
  cuts AS (SELECT cutoff, round(abs((va - vt) / va - 0.2::DOUBLE) + abs((ha - ht) / ha - 0.2::DOUBLE), 12) AS label_error, round(abs((va - vt + ha - ht) / (va + ha) - 0.2::DOUBLE), 12) AS overall_error,
    sha256('{SEED}|temporal-cutoff|' || CAST(cutoff AS VARCHAR)) AS tie FROM c WHERE vt > 0 AND ht > 0 AND va > vt AND ha > ht)"""


@query(f"{_CUTS} SELECT cutoff, round(label_error, 9) AS label_error, round(overall_error, 9) AS overall_error, tie FROM cuts")
def temporal_cutoff_candidates(spark, sf_dir):
    c = protocols.cutoff_candidates(_temporal(spark, sf_dir), 0.2, SEED)
    return c.withColumns({"label_error": F.round("label_error", 9), "overall_error": F.round("overall_error", 9)})


@query(f"{_CUTS}, best AS (SELECT min_by(cutoff, (label_error, overall_error, tie, cutoff)) AS b FROM cuts) {_sides('(SELECT b FROM best)')}")
def temporal_auto_cutoff(spark, sf_dir):
    g = _temporal(spark, sf_dir)
    return protocols.temporal_holdout(g, protocols.choose_cutoff(g, 0.2, SEED))


@query(f"{_TEMP} SELECT genome_id, 'missing_release_date' AS reason FROM e WHERE release_date IS NULL")
def temporal_missing_excluded(spark, sf_dir):
    return protocols.temporal_holdout(_temporal(spark, sf_dir), "2001-01-01").where("partition = 'excluded'").select("genome_id", "reason")


@query(f"{_TEMP} SELECT genome_id, group_id, effective_date FROM e")
def temporal_group_effective(spark, sf_dir):
    return catalog.effective_dates(_temporal(spark, sf_dir)).select("genome_id", "group_id", "effective_date")


_TAXA = """WITH g AS (SELECT p_partkey AS genome_id, CASE WHEN p_size % 3 = 0 THEN 'host' ELSE 'virus' END AS label, 'g-' || p_partkey AS group_id,
  CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS taxon FROM part)"""


def _parts(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("genome_id"),
        F.when(F.col("p_size") % 3 == 0, "host").otherwise("virus").alias("label"),
        F.concat(F.lit("g-"), "p_partkey").alias("group_id"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("taxon"),
    )


def _taxonomic_sql(held: str) -> str:
    hosts = sql_ranked("hosts", "taxonomy:host")
    return f"""{_TAXA}, hosts AS (SELECT label, group_id, count(*) AS n_genomes FROM g WHERE label = 'host' GROUP BY label, group_id), {hosts}, held AS ({held})
SELECT genome_id, label, group_id, CASE WHEN taxon IS NULL THEN 'excluded' WHEN lower(taxon) IN (SELECT t FROM held) THEN 'test' ELSE 'train' END AS partition,
  CASE WHEN taxon IS NULL THEN 'missing_taxonomy_family' WHEN lower(taxon) IN (SELECT t FROM held) THEN 'selected_taxon_holdout' ELSE 'non_holdout_taxon' END AS reason, taxon FROM g WHERE label = 'virus'
UNION ALL SELECT genome_id, label, group_id, side, 'host_label_stratified_genome_holdout', NULL FROM g JOIN sides USING (label, group_id) WHERE label = 'host'"""


@query(_taxonomic_sql("SELECT unnest(['brand#1', 'brand#2']) AS t"))
def taxonomic_explicit(spark, sf_dir):
    return protocols.taxonomic_holdout(_parts(spark, sf_dir), ["brand#1", "Brand#2"])


_AUTO = f"SELECT t FROM (SELECT DISTINCT lower(taxon) AS t FROM g WHERE label = 'virus' AND taxon IS NOT NULL) ORDER BY sha256('{SEED}|taxonomy:family|' || t), t LIMIT 2"


@query(_taxonomic_sql(_AUTO))
def taxonomic_auto(spark, sf_dir):
    g = _parts(spark, sf_dir)
    held = [r["taxon"] for r in protocols.choose_taxa(g.where("label = 'virus'"), "family", 2, SEED).collect()]
    return protocols.taxonomic_holdout(g, held)


@query(f"{_TAXA}, hosts AS (SELECT label, group_id, count(*) AS n_genomes FROM g WHERE label = 'host' GROUP BY label, group_id), {sql_ranked('hosts', 'taxonomy:host')} SELECT side AS partition, count(*) AS n FROM g JOIN sides USING (label, group_id) GROUP BY side")
def taxonomic_host_partition(spark, sf_dir):
    t = protocols.taxonomic_holdout(_parts(spark, sf_dir), ["brand#1"]).where("label = 'host'")
    return t.groupBy("partition").agg(F.count("*").alias("n"))


_BROKEN = f"{_HOLD}, a AS (SELECT genome_id, label, group_id, CASE WHEN genome_id LIKE '%7' THEN 'train' ELSE side END AS partition FROM clean JOIN sides USING (label, group_id))"


@query(f"""{_BROKEN} SELECT 'group_on_both_sides' AS "check", group_id AS key FROM a GROUP BY group_id HAVING count(DISTINCT partition) > 1""")
def plan_invariants(spark, sf_dir):
    """A plan with planted moves: every group that they tear apart is reported."""
    plan = protocols.genome_holdout(clean_genomes(spark, sf_dir), 0.2, SEED)
    moved = plan.withColumn("partition", F.when(F.col("genome_id").like("%7"), "train").otherwise(F.col("partition")))
    return audit.plan_violations(moved)


@query(f"{_CUTS}, moved AS (SELECT *, CASE WHEN genome_id % 50 = 3 THEN 'test' WHEN release_date IS NULL THEN 'excluded' WHEN effective_date <= DATE '2001-01-01' THEN 'train' ELSE 'test' END AS partition FROM e) SELECT genome_id, partition FROM moved WHERE genome_id % 50 = 3 AND partition <> CASE WHEN release_date IS NULL THEN 'excluded' WHEN effective_date <= DATE '2001-01-01' THEN 'train' ELSE 'test' END")
def temporal_recheck(spark, sf_dir):
    plan = protocols.temporal_holdout(_temporal(spark, sf_dir), "2001-01-01")
    moved = plan.withColumn("partition", F.when(F.col("genome_id") % 50 == 3, "test").otherwise(F.col("partition")))
    return audit.temporal_violations(moved, "2001-01-01")


@query(f"{_TAXA} SELECT genome_id, 'train' AS partition FROM g WHERE label = 'virus' AND genome_id % 40 = 1 AND (taxon IS NULL OR lower(taxon) = 'brand#1')")
def taxonomy_recheck(spark, sf_dir):
    plan = protocols.taxonomic_holdout(_parts(spark, sf_dir), ["Brand#1"])
    moved = plan.withColumn("partition", F.when(F.col("genome_id") % 40 == 1, "train").otherwise(F.col("partition")))
    return audit.taxonomy_violations(moved, ["Brand#1"])


@query(f"{_TEMP} SELECT genome_id, label, 'temporal' AS split, 'missing_release_date' AS reason FROM e WHERE release_date IS NULL")
def exclusion_rows(spark, sf_dir):
    return protocols.exclusion_rows(protocols.temporal_holdout(_temporal(spark, sf_dir), "2001-01-01"), "temporal")
