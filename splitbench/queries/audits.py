"""Intervals and leakage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, intervals, stats
from ..session import materialize
from ..sources import adapters
from .common import SQL_GENOMES, genomes_from_documents, query, sql_rc
from .fragments import _LIB, _SPLIT, _TRUTH, _plan, _split, library, source_contigs

_EVENTS = """ev AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 60 * (event_id % 10 + 1) AS "end", CASE WHEN event_id % 3 = 0 THEN 'test' ELSE 'train' END AS partition FROM events)"""


@query(f"""WITH {_EVENTS}, m AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM i GROUP BY user_id, island""")
def interval_islands(spark, sf_dir):
    return intervals.islands(adapters.intervals_from_events(spark, sf_dir), ["user_id"])


@query(f"""WITH {_EVENTS} SELECT DISTINCT event_id FROM ev a WHERE partition = 'test' AND EXISTS (SELECT 1 FROM ev b WHERE b.partition = 'train' AND b.user_id = a.user_id AND a.start < b."end" AND b.start < a."end")""")
def interval_overlap_test(spark, sf_dir):
    e = adapters.intervals_from_events(spark, sf_dir)
    return intervals.overlapping(e.where("partition = 'test'"), e.where("partition = 'train'"), ["user_id"], "event_id", 600)


@query(f"""{_LIB} SELECT fragment_id, start AS segment_start, least("end", source_length) AS segment_end FROM library UNION ALL SELECT fragment_id, 0, "end" - source_length FROM library WHERE "end" > source_length""")
def circular_segments(spark, sf_dir):
    """Fragments as one segment, or two where they run past an origin."""
    lib = library(spark, sf_dir).select("fragment_id", "start", "end", "source_length")
    return intervals.segments(lib).select("fragment_id", "segment_start", "segment_end")


@query(f"WITH {SQL_GENOMES} SELECT genus FROM genomes WHERE label = 'virus' INTERSECT SELECT genus FROM genomes WHERE label = 'host'")
def overlap_ids(spark, sf_dir):
    g = genomes_from_documents(spark, sf_dir)
    return audit.shared_values(g.where("label = 'virus'"), g.where("label = 'host'"), "genus")


@query(f"WITH {SQL_GENOMES} SELECT group_id FROM genomes WHERE doc_id % 2 = 0 INTERSECT SELECT group_id FROM genomes WHERE doc_id % 2 = 1")
def overlap_content_groups(spark, sf_dir):
    """Content groups on both sides of a split that ignores content."""
    g = genomes_from_documents(spark, sf_dir)
    return audit.shared_values(g.where("doc_id % 2 = 0"), g.where("doc_id % 2 = 1"), "group_id")


@query(f"{_SPLIT}, c AS (SELECT partition, least(sequence, {sql_rc('sequence')}) AS x FROM split) SELECT count(*) AS n FROM (SELECT x FROM c WHERE partition = 'train' INTERSECT SELECT x FROM c WHERE partition = 'test')")
def overlap_fragment_content(spark, sf_dir):
    s = _split(spark, sf_dir)
    return audit.shared_content(s.where("partition = 'train'"), s.where("partition = 'test'")).agg(F.count("*").alias("n"))


_SEGS = f"""{_SPLIT}, segs AS (SELECT fragment_id, partition, genome_id, sequence_id, start AS s, least("end", source_length) AS e FROM split UNION ALL SELECT fragment_id, partition, genome_id, sequence_id, 0, "end" - source_length FROM split WHERE "end" > source_length),
  hit AS (SELECT DISTINCT a.fragment_id FROM segs a JOIN segs b ON a.partition = 'test' AND b.partition = 'train' AND a.genome_id = b.genome_id AND a.sequence_id = b.sequence_id AND a.s < b.e AND b.s < a.e), c AS (SELECT partition, least(sequence, {sql_rc('sequence')}) AS x FROM split)"""


@query(f"""{_SEGS} SELECT 'fragment_id_overlap' AS "check", (SELECT count(*) FROM (SELECT fragment_id FROM split WHERE partition = 'train' INTERSECT SELECT fragment_id FROM split WHERE partition = 'test')) AS n
UNION ALL SELECT 'exact_fragment_content_overlap', (SELECT count(*) FROM (SELECT x FROM c WHERE partition = 'train' INTERSECT SELECT x FROM c WHERE partition = 'test'))
UNION ALL SELECT 'test_fragments_with_coordinate_overlap', (SELECT count(*) FROM hit)
UNION ALL SELECT 'source_genome_overlap', (SELECT count(*) FROM (SELECT genome_id FROM split WHERE partition = 'train' INTERSECT SELECT genome_id FROM split WHERE partition = 'test'))
UNION ALL SELECT 'source_content_hash_overlap', (SELECT count(*) FROM (SELECT genome_id FROM split WHERE partition = 'train' INTERSECT SELECT genome_id FROM split WHERE partition = 'test'))
UNION ALL SELECT 'train_source_genomes', (SELECT count(DISTINCT genome_id) FROM split WHERE partition = 'train')
UNION ALL SELECT 'test_source_genomes', (SELECT count(DISTINCT genome_id) FROM split WHERE partition = 'test')""")
def split_audit(spark, sf_dir):
    """All numbers of the leakage audit for the random-fragment split."""
    s = materialize(_split(spark, sf_dir), "split")
    return audit.split_audit(s, s.select("genome_id", F.col("genome_id").alias("group_id")).distinct())


@query(f"""{_TRUTH}, marked AS (SELECT *, CAST(substr(source_genome_id, 5) AS BIGINT) % 11 AS k FROM truth WHERE partition = 'test')
SELECT sequence_id AS key, CASE k WHEN 0 THEN 'row' WHEN 1 THEN 'strand' WHEN 2 THEN 'release_date' WHEN 3 THEN 'row' END AS field FROM marked WHERE k < 4""")
def strict_subset_of_candidate(spark, sf_dir):
    """A strict test with rows left out, altered and added, against the candidate test's rows of the genomes that stayed."""
    truth = materialize(stats.truth_view(library(spark, sf_dir), _plan(spark, sf_dir), source_contigs(spark, sf_dir), "candidate_test").where("partition = 'test'"), "candidates")
    k = F.expr("cast(substr(source_genome_id, 5) as bigint)") % 11
    stayed = truth.select(F.col("source_genome_id").alias("genome_id"), F.when(k == 3, "excluded").otherwise("test").alias("partition")).distinct()
    strict = truth.where(k != 0).withColumns(
        {
            "view": F.lit("test"),
            "strand": F.when(k == 1, F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand")),
            "release_date": F.when(k == 2, F.date_add("release_date", 1)).otherwise(F.col("release_date")),
        }
    )
    return audit.strict_subset_violations(truth, strict, stayed)
