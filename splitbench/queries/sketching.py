"""k-mers, sketches, nearest references, and the external similarity table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BenchmarkConfig
from ..functions import dna
from ..operators import audit, similarity, stats
from ..plans import protocols
from ..session import materialize
from ..sources import adapters
from .common import SEED, SQL_CONTIGS, query, sql_ranked, sql_rc

K, SIZE = 15, 100
#: The engine's defaults.
FULL_K, FULL_SIZE = BenchmarkConfig.similarity_k, BenchmarkConfig.sketch_size


def _sql_kmers(source: str, k: int) -> str:
    return f"""pieces AS (SELECT genome_id, substr(sequence, c * 256 + 1, {256 + k - 1}) AS piece FROM (SELECT genome_id, sequence, unnest(range(0, (length(sequence) - {k}) // 256 + 1)) AS c FROM {source} WHERE length(sequence) >= {k})),
  kmers AS (SELECT genome_id, kmer, least(kmer, {sql_rc('kmer')}) AS canon FROM (SELECT genome_id, substr(piece, i, {k}) AS kmer FROM (SELECT genome_id, piece, unnest(range(1, length(piece) - {k} + 2)) AS i FROM pieces)) WHERE regexp_full_match(kmer, '[ACGT]+'))"""


def _sql_sketches(source: str, k: int, size: int) -> str:
    return f"""{_sql_kmers(source, k)}, hashed AS (SELECT DISTINCT genome_id, substr(sha256(canon), 1, 16) AS h FROM (SELECT DISTINCT genome_id, canon FROM kmers)),
  heads AS (SELECT genome_id, h FROM hashed QUALIFY row_number() OVER (PARTITION BY genome_id ORDER BY h) <= {size + 1}),
  sketches AS (SELECT genome_id, list(h ORDER BY h)[1:{size}] AS hashes, count(*) AS unique_kmers, count(*) <= {size} AS is_exact FROM heads GROUP BY genome_id)"""


_IUPAC = "iupac AS (SELECT 'doc-' || doc_id AS genome_id, upper(regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]', '', 'g')) AS sequence FROM documents)"


@query(f"WITH {_IUPAC}, {_sql_kmers('iupac', 7)} SELECT genome_id, count(*) AS n, count(DISTINCT kmer) AS n_distinct, min(kmer) AS first FROM kmers GROUP BY genome_id")
def kmers(spark, sf_dir):
    """Unambiguous 7-mers of IUPAC sequences."""
    c = adapters.contigs_from_documents(spark, sf_dir, iupac=True).select("genome_id", "sequence")
    return similarity.kmers(c, 7).groupBy("genome_id").agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("n_distinct"), F.min("kmer").alias("first"))


@query(f"WITH {SQL_CONTIGS}, {_sql_kmers('contigs', 21)} SELECT genome_id, count(*) AS n, count(DISTINCT canon) AS n_distinct, min(canon) AS first FROM kmers GROUP BY genome_id")
def canonical_kmers(spark, sf_dir):
    c = adapters.contigs_from_documents(spark, sf_dir).select("genome_id", "sequence")
    return similarity.kmer_counts(c, 21)


@query(f"WITH {SQL_CONTIGS}, {_sql_sketches('contigs', 21, 200)} SELECT genome_id, sha256(array_to_string(hashes, '')) AS sketch, unique_kmers, is_exact FROM sketches")
def minhash_sketch(spark, sf_dir):
    s = similarity.sketches(adapters.contigs_from_documents(spark, sf_dir), 21, 200)
    return s.select("genome_id", F.sha2(F.array_join(similarity.hex_hashes(F.col("hashes")), ""), 256).alias("sketch"), "unique_kmers", "is_exact")


@query()
def minhash_sketch_blake2(spark, sf_dir):
    s = similarity.sketches(adapters.contigs_from_documents(spark, sf_dir), 21, 200, blake2=True)
    return s.select("genome_id", F.sha2(F.array_join(similarity.hex_hashes(F.col("hashes")), ""), 256).alias("sketch"), "unique_kmers", "is_exact")


@query(f"WITH {SQL_CONTIGS}, {_sql_sketches('contigs', 21, 2000)} SELECT genome_id, sha256(array_to_string(hashes, '')) AS sketch, unique_kmers, is_exact FROM sketches")
def minhash_sketch_default(spark, sf_dir):
    """Sketches at the default size of 2,000 hashes."""
    s = similarity.sketches(adapters.contigs_from_documents(spark, sf_dir), 21, 2_000)
    return s.select("genome_id", F.sha2(F.array_join(similarity.hex_hashes(F.col("hashes")), ""), 256).alias("sketch"), "unique_kmers", "is_exact")


@query(f"WITH {SQL_CONTIGS}, {_sql_sketches('contigs', K, SIZE)} SELECT is_exact, count(*) AS n, min(unique_kmers) AS least, max(unique_kmers) AS most FROM sketches GROUP BY is_exact")
def sketch_exactness(spark, sf_dir):
    s = similarity.sketches(adapters.contigs_from_documents(spark, sf_dir), K, SIZE)
    return s.groupBy("is_exact").agg(F.count("*").alias("n"), F.min("unique_kmers").alias("least"), F.max("unique_kmers").alias("most"))


def _sides(spark, sf_dir):
    """Sketches of documents as queries and of benchmark items as references."""
    docs = adapters.contigs_from_documents(spark, sf_dir).select("genome_id", "sequence")
    items = adapters.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), "item_id").alias("genome_id"), adapters.nucleotides(F.col("text")).alias("sequence"))
    q = materialize(similarity.sketches(docs, K, SIZE), "sketches").withColumnRenamed("genome_id", "query_id")
    r = similarity.sketches(items, K, SIZE).withColumnRenamed("genome_id", "reference_id")
    return q, r


_ALL = "everything AS (SELECT genome_id, sequence FROM contigs UNION ALL SELECT 'item-' || item_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') FROM benchmark)"


def _sql_pairs(q: str, r: str, k: int = K, size: int = SIZE) -> str:
    return f"""pairs AS (SELECT DISTINCT a.genome_id AS query_id, b.genome_id AS reference_id FROM (SELECT genome_id, unnest(hashes) AS h FROM {q}) a JOIN (SELECT genome_id, unnest(hashes) AS h FROM {r}) b USING (h)),
  heads2 AS (SELECT query_id, reference_id, a.hashes AS x, b.hashes AS y, CASE WHEN a.is_exact AND b.is_exact THEN list_sort(list_distinct(a.hashes || b.hashes)) ELSE list_sort(list_distinct(a.hashes || b.hashes))[1:{size}] END AS head
    FROM pairs JOIN {q} a ON a.genome_id = query_id JOIN {r} b ON b.genome_id = reference_id),
  jac AS (SELECT query_id, reference_id, len(list_intersect(list_intersect(head, x), y)) / len(head) AS j FROM heads2),
  scored AS (SELECT *, CASE WHEN j = 1 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 + ln(2 * j / (1 + j)) / {k})) END AS identity FROM jac WHERE j > 0)"""


_PAIRS = f"WITH {SQL_CONTIGS}, {_ALL}, {_sql_sketches('everything', K, SIZE)}, q AS (SELECT * FROM sketches WHERE genome_id LIKE 'doc-%'), r AS (SELECT * FROM sketches WHERE genome_id LIKE 'item-%'), {_sql_pairs('q', 'r')}"


@query(f"{_PAIRS} SELECT query_id, reference_id, round(j, 9) AS jaccard FROM scored")
def pairwise_jaccard(spark, sf_dir):
    """Every document against every benchmark item; pairs come from an inverted index."""
    p = similarity.pairwise(*_sides(spark, sf_dir), K, SIZE)
    return p.select("query_id", "reference_id", F.round("jaccard", 9).alias("jaccard"))


@query(f"{_PAIRS} SELECT query_id, reference_id, round(identity, 9) AS identity FROM scored")
def mash_identity(spark, sf_dir):
    p = similarity.pairwise(*_sides(spark, sf_dir), K, SIZE)
    return p.select("query_id", "reference_id", F.round("identity", 9).alias("identity"))


_NEAR = f"{_PAIRS}, best AS (SELECT query_id, round(max(identity), 9) AS max_similarity, min_by(reference_id, (-round(identity, 12), reference_id)) AS nearest_id FROM scored GROUP BY query_id)"


def _near(spark, sf_dir):
    q, r = _sides(spark, sf_dir)
    hits = similarity.pairwise(q, r, K, SIZE).withColumn("identity", F.round("identity", 12))
    near = similarity.nearest(hits, q)
    return near.withColumn("max_similarity", F.round("max_similarity", 9))


@query(f"{_NEAR} SELECT genome_id AS query_id, max_similarity, nearest_id FROM q LEFT JOIN best ON query_id = genome_id")
def nearest_train(spark, sf_dir):
    return _near(spark, sf_dir).select("query_id", "max_similarity", "nearest_id")


def _sql_band(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'no_detectable_match' WHEN {x} < 0.3 THEN 'distant_detectable' WHEN {x} < 0.7 THEN 'low_similarity' WHEN {x} < 0.9 THEN 'moderate_similarity' ELSE 'high_similarity' END"


@query(f"{_NEAR}, banded AS (SELECT {_sql_band('max_similarity')} AS similarity_bin FROM q LEFT JOIN best ON query_id = genome_id) SELECT b AS similarity_bin, count(similarity_bin) AS n FROM (SELECT unnest(['no_detectable_match', 'distant_detectable', 'low_similarity', 'moderate_similarity', 'high_similarity']) AS b) LEFT JOIN banded ON similarity_bin = b GROUP BY b")
def similarity_strata(spark, sf_dir):
    return stats.strata_views(_near(spark, sf_dir).select(similarity.classify(F.col("max_similarity")).alias("similarity_bin")))


def _sql_hold(k: int, size: int) -> str:
    return f"""WITH {SQL_CONTIGS}, g AS (SELECT genome_id, label, genome_id AS group_id FROM contigs), groups AS (SELECT label, group_id, 1 AS n_genomes FROM g), {sql_ranked('groups', 'similarity-proposal')},
  {_sql_sketches('contigs', k, size)}, q AS (SELECT s.* FROM sketches s JOIN sides ON group_id = genome_id WHERE side = 'test'), r AS (SELECT s.* FROM sketches s JOIN sides ON group_id = genome_id WHERE side = 'train'), {_sql_pairs('q', 'r', k, size)},
  best AS (SELECT query_id, max(round(identity, 12)) AS top FROM scored GROUP BY query_id)"""


@query(f"""{_sql_hold(K, SIZE)} SELECT g.genome_id, label, CASE WHEN side = 'train' THEN 'train' WHEN top > 0.95 THEN 'excluded' ELSE 'test' END AS partition, side AS candidate_partition,
  CASE WHEN side = 'train' THEN 'label_stratified_training_proposal' WHEN top > 0.95 THEN 'similarity_above_strict_identity_and_coverage_gate' ELSE 'similarity_within_strict_identity_threshold' END AS reason,
  CASE WHEN side = 'test' THEN {_sql_band('top')} END AS similarity_bin, round(top, 9) AS max_train_similarity FROM g JOIN sides USING (label, group_id) LEFT JOIN best ON query_id = g.genome_id""")
def strict_gate(spark, sf_dir):
    """The similarity-filtered holdout of all documents: proposal, nearest training genome, gate, band."""
    c = adapters.contigs_from_documents(spark, sf_dir).withColumn("group_id", F.col("genome_id"))
    proposal = materialize(protocols.similarity_proposal(c.select("genome_id", "label", "group_id"), 0.2, SEED), "proposal")
    hits = protocols.sketch_hits(proposal, similarity.sketches(c, K, SIZE), K, SIZE, 0.95)
    final = protocols.apply_gate(proposal, hits, 0.95)
    return final.select("genome_id", "label", "partition", "candidate_partition", "reason", "similarity_bin", F.round("max_train_similarity", 9).alias("max_train_similarity"))


@query(f"""{_sql_hold(FULL_K, FULL_SIZE)} SELECT 'gate_and_side_differ' AS "check", query_id AS key FROM best WHERE top > 0.95""")
def similarity_recheck(spark, sf_dir):
    """Evidence that contradicts its plan after planted edits, from sketches of the default size."""
    c = adapters.contigs_from_documents(spark, sf_dir).withColumn("group_id", F.col("genome_id"))
    proposal = materialize(protocols.similarity_proposal(c.select("genome_id", "label", "group_id"), 0.2, SEED), "proposal")
    final = protocols.apply_gate(proposal, protocols.sketch_hits(proposal, similarity.sketches(c, FULL_K, FULL_SIZE), FULL_K, FULL_SIZE, 0.95), 0.95)
    edited = final.withColumn("partition", F.when(F.col("partition") == "excluded", "test").otherwise(F.col("partition")))
    return audit.similarity_violations(edited, 0.95)


_MATRIX = """WITH m AS (SELECT l_suppkey AS query_genome_id, l_partkey AS reference_genome_id, CASE WHEN l_linenumber <> 7 THEN round(l_discount * 10, 2) END AS similarity,
    CASE WHEN l_linenumber <> 7 THEN round(1 - 10 * l_tax, 2) END AS coverage, 'aligner-' || l_linenumber AS method, l_orderkey AS row_key, l_linenumber AS row_line FROM lineitem),
  d AS (SELECT query_genome_id, reference_genome_id, min_by({'similarity': similarity, 'coverage': coverage, 'method': method}, (row_key, row_line, coalesce(similarity, -1), coalesce(coverage, -1))) AS b FROM m GROUP BY ALL),
  t AS (SELECT query_genome_id, reference_genome_id, b.similarity AS similarity, b.coverage AS coverage, b.method AS method FROM d)"""


@query(f"{_MATRIX} SELECT query_genome_id, count(DISTINCT reference_genome_id) AS n_pairs, count(*) AS n_rows FROM m GROUP BY query_genome_id HAVING count(DISTINCT reference_genome_id) <> (SELECT count(*) FROM part) OR count(*) <> (SELECT count(*) FROM part)")
def external_matrix_complete(spark, sf_dir):
    """Queries whose rows are not exactly one for each part."""
    return similarity.incomplete_queries(adapters.matrix_from_lineitem(spark, sf_dir), adapters.table(spark, sf_dir, "part").count())


_COLLAPSED = f"""{_MATRIX}, best AS (SELECT query_genome_id, min_by({{'id': reference_genome_id, 'similarity': similarity, 'coverage': coverage, 'method': method}}, (-coalesce(similarity, -1), reference_genome_id)) AS b,
  min_by({{'id': reference_genome_id, 'similarity': similarity, 'coverage': coverage, 'method': method}}, (-coalesce(similarity, -1), reference_genome_id)) FILTER (similarity > 0.5 AND (coverage IS NULL OR coverage >= 0.85)) AS g FROM t GROUP BY query_genome_id)"""


def _collapsed(spark, sf_dir):
    return similarity.collapse_table(adapters.distinct_matrix(adapters.matrix_from_lineitem(spark, sf_dir)), 0.5, 0.85)


@query(f"{_COLLAPSED} SELECT query_genome_id, CASE WHEN b.similarity IS NOT NULL THEN b.id END AS nearest_train_genome_id, b.similarity AS max_train_similarity, b.coverage AS similarity_coverage, b.method AS similarity_method FROM best")
def external_best_hit(spark, sf_dir):
    return _collapsed(spark, sf_dir).select("query_genome_id", "nearest_train_genome_id", "max_train_similarity", "similarity_coverage", "similarity_method")


@query(f"{_COLLAPSED} SELECT query_genome_id, g.id AS strict_gate_train_genome_id, g.similarity AS strict_gate_similarity, g.coverage AS strict_gate_coverage, g.method AS strict_gate_method FROM best")
def external_gate_hit(spark, sf_dir):
    """The best hit that qualifies for the gate, which need not be the best hit."""
    return _collapsed(spark, sf_dir).select("query_genome_id", "strict_gate_train_genome_id", "strict_gate_similarity", "strict_gate_coverage", "strict_gate_method")


@query(f"WITH {SQL_CONTIGS} SELECT genome_id, sha256({sql_rc('sequence')}) AS rc FROM contigs WHERE length(sequence) >= {K}")
def sketchable(spark, sf_dir):
    """Sequences long enough for a k-mer."""
    c = adapters.contigs_from_documents(spark, sf_dir).where(F.length("sequence") >= K)
    return c.select("genome_id", F.sha2(dna.reverse_complement(F.col("sequence")), 256).alias("rc"))
