"""Fragment sampling, the random split, truth and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna
from ..operators import sampling, stats
from ..plans import protocols
from ..session import materialize
from ..sources import adapters
from .common import SEED, SQL_CONTIGS, query, sql_draw, sql_ranked, sql_rc

#: Fragments of a genome; genomes are documents, so that a library grows with their table.
LENGTHS, PER_GENOME = [31, 61], 5
#: Fragments of a genome in which all documents of a source and label are contigs.
PER_SOURCE = 61


def source_contigs(spark, sf_dir, iupac=False):
    """Documents as genomes of one contig, those that are long enough for every fragment length."""
    return adapters.contigs_from_documents(spark, sf_dir, iupac).where(F.length("sequence") >= max(LENGTHS))


def grouped_contigs(spark, sf_dir, iupac=False):
    """Documents as contigs of genomes by source and label."""
    return adapters.contigs_from_documents(spark, sf_dir, iupac).withColumn("genome_id", F.concat_ws("-", "genus", "label"))


def library(spark, sf_dir):
    return sampling.sample_fragments(source_contigs(spark, sf_dir), LENGTHS, PER_GENOME, SEED, max_ambiguous=1.0)


_SOURCES = f"{SQL_CONTIGS}, sources AS (SELECT * FROM contigs WHERE length(sequence) >= {max(LENGTHS)})"
_GROUPED = f"{SQL_CONTIGS}, sources AS (SELECT * REPLACE (genus || '-' || label AS genome_id) FROM contigs)"
_IUPAC_SOURCES = """sources AS (SELECT 'doc-' || doc_id AS sequence_id, source || '-' || (CASE WHEN doc_id % 3 = 0 THEN 'host' ELSE 'virus' END) AS genome_id,
  CASE WHEN doc_id % 3 = 0 THEN 'host' ELSE 'virus' END AS label, CASE WHEN doc_id % 5 = 0 THEN 'circular' ELSE 'linear' END AS topology,
  upper(regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]', '', 'g')) AS sequence FROM documents)"""


def _library_sql(sources: str, per: int, attempts: int = 1, limit: float = 1.0) -> str:
    share, more = divmod(per, len(LENGTHS))
    return f"""WITH {sources},
  lengths AS (SELECT unnest({LENGTHS}) AS fragment_length),
  counts AS (SELECT genome_id, label, fragment_length, {share} + CASE WHEN row_number() OVER (PARTITION BY genome_id ORDER BY sha256('{SEED}|length-balance|' || genome_id || '|' || fragment_length), fragment_length) <= {more} THEN 1 ELSE 0 END AS n
    FROM (SELECT genome_id, max(label) AS label FROM sources GROUP BY genome_id), lengths),
  space AS (SELECT *, hi - starts AS lo, max(hi) OVER (PARTITION BY genome_id, fragment_length) AS total FROM (
    SELECT *, sum(starts) OVER (PARTITION BY genome_id, fragment_length ORDER BY sequence_id ROWS UNBOUNDED PRECEDING) AS hi FROM (
      SELECT genome_id, sequence_id, sequence, fragment_length, length(sequence) AS source_length, CASE WHEN topology = 'circular' THEN length(sequence) ELSE length(sequence) - fragment_length + 1 END AS starts
      FROM sources, lengths WHERE length(sequence) >= fragment_length))),
  wanted AS (SELECT genome_id, label, fragment_length, local_index, unnest(range({attempts})) AS attempt FROM (SELECT *, unnest(range(n)) AS local_index FROM counts)),
  totals AS (SELECT DISTINCT genome_id, fragment_length, total FROM space),
  tickets AS (SELECT *, {sql_draw(f"sha256('{SEED}|coordinates|' || genome_id || '|' || fragment_length || '|' || local_index || '|' || attempt)")} % total AS ticket FROM wanted JOIN totals USING (genome_id, fragment_length)),
  located AS (SELECT t.*, s.sequence_id, s.source_length, CAST(ticket - lo AS BIGINT) AS start, substr(sequence || sequence, CAST(ticket - lo + 1 AS BIGINT), t.fragment_length) AS forward,
    {sql_draw(f"sha256('{SEED}|strands|' || t.genome_id || '|' || t.fragment_length || '|' || local_index)")} % 2 = 1 AS minus
    FROM tickets t JOIN space s ON t.genome_id = s.genome_id AND t.fragment_length = s.fragment_length AND ticket >= lo AND ticket < hi),
  fine AS (SELECT *, min(attempt) OVER (PARTITION BY genome_id, fragment_length, local_index) AS first FROM located WHERE length(regexp_replace(forward, '[ACGT]', '', 'g')) / fragment_length <= {limit}),
  library AS (SELECT genome_id, label, sequence_id, CAST(fragment_length AS BIGINT) AS fragment_length, CAST(local_index AS BIGINT) AS local_index, start, start + fragment_length AS "end", source_length,
    CASE WHEN minus THEN '-' ELSE '+' END AS strand, CASE WHEN minus THEN {sql_rc('forward')} ELSE forward END AS sequence,
    'frag-' || substr(sha256('{SEED}|fragment-id|' || genome_id || '|' || sequence_id || '|' || fragment_length || '|' || local_index || '|' || start || '|' || (CASE WHEN minus THEN '-' ELSE '+' END)), 1, 32) AS fragment_id
    FROM fine WHERE attempt = first)"""


_LIB = _library_sql(_SOURCES, PER_GENOME)
_MANY = _library_sql(_GROUPED, PER_SOURCE)
_SHOWN = 'fragment_id, label, genome_id, sequence_id, start, "end", strand, fragment_length, sequence'
_COLS = ["fragment_id", "label", "genome_id", "sequence_id", "start", "end", "strand", "fragment_length", "sequence"]


@query(f"{_LIB} SELECT genome_id, CAST(fragment_length AS BIGINT) AS fragment_length, CAST(n AS BIGINT) AS n FROM counts")
def length_balance(spark, sf_dir):
    return sampling.length_counts(source_contigs(spark, sf_dir).select("genome_id").distinct(), LENGTHS, PER_GENOME, SEED)


@query(f"{_LIB} SELECT genome_id, sequence_id, CAST(fragment_length AS BIGINT) AS fragment_length, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM space")
def coordinate_space(spark, sf_dir):
    return sampling.coordinate_space(source_contigs(spark, sf_dir), LENGTHS).select("genome_id", "sequence_id", "fragment_length", "lo", "hi")


@query(f"WITH {SQL_CONTIGS} SELECT genome_id, CAST(l AS BIGINT) AS fragment_length, CAST(length(sequence) AS BIGINT) AS longest FROM contigs, (SELECT unnest([50, 500]) AS l) WHERE length(sequence) < l")
def length_preflight(spark, sf_dir):
    return sampling.length_preflight(adapters.contigs_from_documents(spark, sf_dir), [50, 500])


@query(f"{_LIB} SELECT {_SHOWN} FROM library")
def fragment_sample(spark, sf_dir):
    return library(spark, sf_dir).select(*_COLS)


@query(f"{_MANY} SELECT {_SHOWN} FROM library")
def fragment_sample_many_contigs(spark, sf_dir):
    """Genomes of very many contigs: tickets fall on contigs by their place on the genome's axis."""
    return sampling.sample_fragments(grouped_contigs(spark, sf_dir), LENGTHS, PER_SOURCE, SEED, max_ambiguous=1.0).select(*_COLS)


@query(f"{_MANY} SELECT genome_id, sequence_id, CAST(fragment_length AS BIGINT) AS fragment_length, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM space")
def coordinate_space_many_contigs(spark, sf_dir):
    return sampling.coordinate_space(grouped_contigs(spark, sf_dir), LENGTHS).select("genome_id", "sequence_id", "fragment_length", "lo", "hi")


@query(f'{_LIB} SELECT {_SHOWN} FROM library WHERE "end" > source_length')
def fragment_sample_circular(spark, sf_dir):
    """Fragments that run past a circular origin."""
    return library(spark, sf_dir).where("end > source_length").select(*_COLS)


@query(f"{_library_sql(_IUPAC_SOURCES, 21, 200, 0.6)} SELECT {_SHOWN} FROM library")
def fragment_sample_ambiguity(spark, sf_dir):
    """Sampling from ambiguous sequences: draws are rejected until a window is clear enough."""
    return sampling.sample_fragments(grouped_contigs(spark, sf_dir, iupac=True), LENGTHS, 21, SEED, max_ambiguous=0.6).select(*_COLS)


@query(f"{_LIB} SELECT fragment_id, CAST(row_number() OVER (ORDER BY genome_id, fragment_length, local_index) - 1 AS BIGINT) AS ordinal FROM library")
def fragment_ordinals(spark, sf_dir):
    return sampling.with_ordinals(library(spark, sf_dir)).select("fragment_id", "ordinal")


@query(f"{_LIB} SELECT fragment_id, genome_id, sequence_id FROM library WHERE local_index % 9 = 0")
def fragment_reconstruct_violations(spark, sf_dir):
    """Every ninth fragment is shifted by one; exactly those fail to reconstruct."""
    lib = materialize(library(spark, sf_dir), "library")
    moved = lib.withColumn("start", F.when(F.col("local_index") % 9 == 0, F.col("start") + 1).otherwise(F.col("start")))
    return sampling.reconstruction_violations(moved, source_contigs(spark, sf_dir))


@query(f"{_LIB}, d AS (SELECT label, least(sequence, {sql_rc('sequence')}) AS c FROM library UNION ALL SELECT CASE WHEN label = 'virus' THEN 'host' ELSE 'virus' END, least(sequence, {sql_rc('sequence')}) FROM library WHERE local_index < 2) SELECT count(*) AS n FROM (SELECT c FROM d GROUP BY c HAVING min(label) <> max(label))")
def fragment_label_conflicts(spark, sf_dir):
    """Two fragments of each stratum occur under the other label too."""
    lib = library(spark, sf_dir).select("sequence", "label", "local_index")
    other = lib.where("local_index < 2").withColumn("label", F.when(F.col("label") == "virus", "host").otherwise("virus"))
    return sampling.label_conflicts(lib.unionByName(other)).agg(F.count("*").alias("n"))


_SPLIT = f"""{_LIB}, split AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY genome_id, fragment_length ORDER BY sha256('{SEED}|random-membership|' || genome_id || '|' || fragment_length || '|' || fragment_id), fragment_id)
  <= least(n - 1, greatest(1, floor(n * 0.3::DOUBLE + 0.5))) THEN 'test' ELSE 'train' END AS partition FROM (SELECT *, count(*) OVER (PARTITION BY genome_id, fragment_length) AS n FROM library))"""


def _split(spark, sf_dir):
    return sampling.random_split(library(spark, sf_dir), 0.3, SEED)


@query(f"{_SPLIT} SELECT fragment_id, genome_id, fragment_length, partition FROM split")
def random_fragment_split(spark, sf_dir):
    return _split(spark, sf_dir).select("fragment_id", "genome_id", "fragment_length", "partition")


@query(f"{_SPLIT} SELECT genome_id, fragment_length, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'test') AS n_test FROM split GROUP BY genome_id, fragment_length")
def random_split_strata_check(spark, sf_dir):
    side = lambda p: F.count_if(F.col("partition") == p)
    return _split(spark, sf_dir).groupBy("genome_id", "fragment_length").agg(side("train").alias("n_train"), side("test").alias("n_test"))


@query(f"""{_SPLIT} SELECT partition, count(*) AS records, CAST(sum(length(sequence)) AS BIGINT) AS bases, round(sum(length(regexp_replace(sequence, '[^GC]', '', 'g'))) / sum(length(sequence)), 9) AS gc_fraction,
  round(sum(length(regexp_replace(sequence, '[ACGT]', '', 'g'))) / sum(length(sequence)), 9) AS ambiguous_fraction, count(DISTINCT genome_id) AS source_genomes FROM split GROUP BY partition""")
def partition_stats(spark, sf_dir):
    s = stats.partition_stats(_split(spark, sf_dir), "partition")
    return s.withColumns({c: F.round(c, 9) for c in ("gc_fraction", "ambiguous_fraction")})


@query(f"""{_SPLIT} SELECT partition, 'label' AS counted_by, label AS key, count(*) AS n FROM split GROUP BY ALL
UNION ALL SELECT partition, 'label_and_length', label || ':' || fragment_length, count(*) FROM split GROUP BY ALL
UNION ALL SELECT partition, 'length', CAST(fragment_length AS VARCHAR), count(*) FROM split GROUP BY ALL
UNION ALL SELECT partition, 'genome', genome_id, count(*) FROM split GROUP BY ALL""")
def stats_by_label_length(spark, sf_dir):
    return stats.record_counts(_split(spark, sf_dir), "partition")


@query(f"{_SPLIT} SELECT partition, label, count(*) AS n FROM split GROUP BY partition, label")
def truth_summary(spark, sf_dir):
    return stats.truth_summary(_split(spark, sf_dir))


_PLAN = f"{_LIB}, groups AS (SELECT DISTINCT label, 'g-' || genome_id AS group_id, 1 AS n_genomes FROM sources), {sql_ranked('groups', 'genome-holdout')}"
_TRUTH = f"""{_PLAN}, truth AS (SELECT l.fragment_id AS sequence_id, l.label, CAST(NULL AS VARCHAR) AS source_accession_version, l.genome_id AS source_genome_id, 'g-' || l.genome_id AS source_content_group_id,
  l.sequence_id AS source_sequence_id, l.start AS source_start, l."end" AS source_end, CASE WHEN s.topology = 'circular' THEN 'zero_based_half_open_unwrapped' ELSE 'zero_based_half_open' END AS coordinate_system,
  l.strand, l.fragment_length, d.side AS partition, d.side AS view, CAST(NULL AS VARCHAR) AS similarity_bin, CAST(NULL AS DOUBLE) AS max_train_similarity, CAST(NULL AS VARCHAR) AS nearest_train_genome_id,
  s.release_date, true AS synthetic FROM library l JOIN sources s USING (genome_id, sequence_id) JOIN sides d ON d.group_id = 'g-' || l.genome_id AND d.label = l.label)"""


def _plan(spark, sf_dir):
    g = source_contigs(spark, sf_dir).select("genome_id", "label").distinct().withColumn("group_id", F.concat(F.lit("g-"), "genome_id"))
    return protocols.genome_holdout(g, 0.2, SEED)


@query(f"{_TRUTH} SELECT * FROM truth")
def truth_view(spark, sf_dir):
    """All 18 truth columns of a genome holdout's fragments."""
    return stats.truth_view(library(spark, sf_dir), _plan(spark, sf_dir), source_contigs(spark, sf_dir))


@query(f"{_TRUTH} SELECT * REPLACE ('candidate_test' AS view) FROM truth WHERE partition = 'test'")
def candidate_view(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return stats.truth_view(library(spark, sf_dir), plan, source_contigs(spark, sf_dir), "candidate_test").where("partition = 'test'")


@query(f"{_TRUTH}, bands AS (SELECT unnest(['no_detectable_match', 'distant_detectable', 'low_similarity', 'moderate_similarity', 'high_similarity']) AS similarity_bin) SELECT similarity_bin, (SELECT count(*) FROM truth t WHERE coalesce(CASE WHEN t.fragment_length = 31 THEN 'low_similarity' END, 'no_detectable_match') = b.similarity_bin) AS n FROM bands b")
def strata_views(spark, sf_dir):
    """A row for each band, also those without records."""
    t = stats.truth_view(library(spark, sf_dir), _plan(spark, sf_dir), source_contigs(spark, sf_dir))
    banded = t.withColumn("similarity_bin", F.when(F.col("fragment_length") == 31, "low_similarity").otherwise("no_detectable_match"))
    return stats.strata_views(banded)


@query(f"{_LIB} SELECT fragment_id, sha256(least(sequence, {sql_rc('sequence')})) AS content FROM library")
def fragment_contents(spark, sf_dir):
    lib = library(spark, sf_dir)
    return lib.select("fragment_id", F.sha2(dna.canonical(F.col("sequence")), 256).alias("content"))
