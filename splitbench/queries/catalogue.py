"""Normalisation, digests, metadata and the deduplicated catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import dna, hashing, text
from ..operators import audit, catalog, similarity
from ..session import materialize
from ..sources import adapters
from .common import SQL_CONTIGS, SQL_GENOMES, genomes_from_documents, query, sql_digest, sql_rc

_IUPAC = "iupac AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]', '', 'g')) AS s FROM documents)"


@query(f"""WITH {SQL_GENOMES}, labelled AS (SELECT g.*, q.label AS known FROM genomes g LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'virus' ELSE 'host' END) AS label FROM labels GROUP BY doc_id) q USING (doc_id))
SELECT group_id, min(genome_id) AS genome_id, max(known) AS label, count(*) AS n_genomes, count(DISTINCT known) AS n_labels,
  CAST(max(length(sequence)) AS BIGINT) AS length_nt, min(sha256(sequence)) AS sha256, min(release_date) AS release_date FROM labelled GROUP BY group_id""")
def inspect_inventory(spark, sf_dir):
    """Content groups of all documents with their representative, label, copies, length and digests."""
    g = genomes_from_documents(spark, sf_dir).drop("label")
    known = adapters.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "virus").otherwise("host")).alias("label"))
    return g.join(known, "doc_id", "left").groupBy("group_id").agg(
        F.min("genome_id").alias("genome_id"),
        F.max("label").alias("label"),
        F.count("*").alias("n_genomes"),
        F.count_distinct("label").alias("n_labels"),
        F.max(F.length("sequence")).cast("long").alias("length_nt"),
        F.min(F.sha2("sequence", 256)).alias("sha256"),
        F.min("release_date").alias("release_date"),
    )


@query(f"WITH {_IUPAC} SELECT doc_id, CAST(length(s) AS BIGINT) AS length_nt, sha256(s) AS sha256, CAST(length(regexp_extract(text, '^[ACGTRYSWKMBDHVNacgtryswkmbdhvn\\s]*')) + 1 AS BIGINT) % (length(text) + 1) AS first_invalid FROM iupac JOIN documents USING (doc_id)")
def normalize_sequence(spark, sf_dir):
    """Normalised sequences and where the raw text first fails to be one."""
    d = adapters.contigs_from_documents(spark, sf_dir, iupac=True).select("doc_id", "sequence")
    raw = adapters.table(spark, sf_dir, "documents").select("doc_id", dna.invalid_position(F.col("text")).cast("long").alias("first_invalid"))
    s = dna.normalize(F.col("sequence"))
    return d.join(raw, "doc_id").select("doc_id", F.length(s).cast("long").alias("length_nt"), F.sha2(s, 256).alias("sha256"), "first_invalid")


@query(f"WITH {_IUPAC} SELECT doc_id, sha256({sql_rc('s')}) AS rc_sha256, {sql_rc(sql_rc('s'))} = s AS involution FROM iupac")
def reverse_complement(spark, sf_dir):
    d = adapters.contigs_from_documents(spark, sf_dir, iupac=True)
    rc = dna.reverse_complement(F.col("sequence"))
    return d.select("doc_id", F.sha2(rc, 256).alias("rc_sha256"), (dna.reverse_complement(rc) == F.col("sequence")).alias("involution"))


@query(f"""WITH {_IUPAC}, c AS (SELECT doc_id, s, CAST(length(regexp_replace(s, '[^GC]', '', 'g')) AS BIGINT) AS gc, CAST(length(regexp_replace(s, '[ACGT]', '', 'g')) AS BIGINT) AS ambiguous FROM iupac)
SELECT doc_id, gc, ambiguous, round(ambiguous / nullif(length(s), 0), 9) AS ambiguous_fraction FROM c""")
def ambiguity_gc(spark, sf_dir):
    s = F.col("sequence")
    return adapters.contigs_from_documents(spark, sf_dir, iupac=True).select(
        "doc_id",
        dna.count_of(s, "GC").alias("gc"),
        dna.ambiguous_count(s).alias("ambiguous"),
        F.when(F.length(s) > 0, F.round(dna.ambiguous_fraction(s), 9)).alias("ambiguous_fraction"),
    )


@query(f"WITH {SQL_GENOMES} SELECT doc_id, digest FROM genomes")
def canonical_digest_linear(spark, sf_dir):
    return genomes_from_documents(spark, sf_dir).select("doc_id", "digest")


_ROT = "list_min(list_transform(range(1, greatest(length({0}), 1) + 1), lambda i: substr({0}, i) || substr({0}, 1, i - 1)))"
_PARTS = """parts AS (SELECT p_partkey, translate(lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM part)"""


def _parts(spark, sf_dir):
    p = adapters.table(spark, sf_dir, "part")
    return p.select("p_partkey", adapters.nucleotides(F.col("p_name")).alias("s"))


@query(f"WITH {_PARTS} SELECT p_partkey, {_ROT.format('s')} AS rotation FROM parts")
def least_rotation(spark, sf_dir):
    """Least rotations by built-in functions, for short sequences."""
    return _parts(spark, sf_dir).select("p_partkey", dna.least_rotation_native(F.col("s")).alias("rotation"))


@query(f"WITH {_PARTS}, r AS (SELECT p_partkey, least({_ROT.format('s')}, {_ROT.format('t')}) AS c FROM (SELECT *, {sql_rc('s')} AS t FROM parts)) SELECT p_partkey, {sql_digest('c', 'circular')} AS digest FROM r")
def canonical_digest_circular(spark, sf_dir):
    c = dna.canonical_circular(F.col("s"), native=True)
    return _parts(spark, sf_dir).select("p_partkey", hashing.sequence_digest(c, True).alias("digest"))


@query()
def canonical_digest_circular_documents(spark, sf_dir):
    """Digests with each contig's own topology; long circles by the linear-time rotation."""
    return catalog.with_digests(adapters.contigs_from_documents(spark, sf_dir)).select("doc_id", "topology", "canonical_sha256", "linear_sha256")


def _multiset_sql(kind: str) -> str:
    return f"""WITH {SQL_GENOMES} SELECT genus AS genome_id, count(*) AS contig_count,
  sha256(encode('SPLITBENCH-{kind}') || '\\x00'::BLOB || unhex(printf('%016x', count(*))) || unhex(string_agg(digest, '' ORDER BY digest))) AS digest FROM genomes GROUP BY genus"""


@query(_multiset_sql("GENOME-SHA256-v2"))
def genome_digest(spark, sf_dir):
    """Genomes are sources, contigs their documents."""
    return genomes_from_documents(spark, sf_dir).groupBy(F.col("genus").alias("genome_id")).agg(F.count("*").alias("contig_count"), hashing.genome_digest(F.col("digest")).alias("digest"))


@query(_multiset_sql("TOPOLOGY-AGNOSTIC-GENOME-SHA256-v1"))
def topology_agnostic_digest(spark, sf_dir):
    g = genomes_from_documents(spark, sf_dir).groupBy(F.col("genus").alias("genome_id"))
    return g.agg(F.count("*").alias("contig_count"), hashing.topology_agnostic_digest(F.col("digest")).alias("digest"))


@query(f"WITH {SQL_GENOMES} SELECT digest, min(genome_id) AS first_genome_id, count(*) AS n_genomes, count(DISTINCT label) AS n_labels FROM genomes GROUP BY digest")
def content_groups(spark, sf_dir):
    return catalog.content_groups(genomes_from_documents(spark, sf_dir))


@query(f"WITH {SQL_GENOMES} SELECT digest, count(*) AS n_genomes FROM genomes GROUP BY digest HAVING min(label) <> max(label)")
def cross_label_conflicts(spark, sf_dir):
    return catalog.cross_label_conflicts(genomes_from_documents(spark, sf_dir), "digest")


_DUP = f"""WITH {SQL_GENOMES}, d AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN release_date END AS rd FROM genomes), r AS (
  SELECT *, first_value(genome_id) OVER (PARTITION BY digest, label ORDER BY rd IS NULL, rd, genome_id) AS rep FROM d)"""


def _dated(spark, sf_dir):
    g = genomes_from_documents(spark, sf_dir).drop("sequence")
    return materialize(g.withColumn("release_date", F.when(F.col("doc_id") % 7 != 0, F.col("release_date"))), "genomes")


@query(f"{_DUP} SELECT genome_id, label, CASE WHEN rep <> genome_id THEN rep END AS duplicate_of, CASE WHEN rep <> genome_id THEN 'same_class_content_duplicate' END AS reason FROM r")
def duplicate_drop(spark, sf_dir):
    r = catalog.rank_duplicates(_dated(spark, sf_dir))
    return r.select("genome_id", "label", "duplicate_of", F.when(F.col("duplicate_of").isNotNull(), "same_class_content_duplicate").alias("reason"))


@query(f"{_DUP} SELECT rep AS genome_id, count(*) AS n_copies, min(rd) AS earliest_release_date, string_agg(genome_id, ',' ORDER BY genome_id) FILTER (genome_id <> rep) AS dropped_ids FROM r GROUP BY rep HAVING count(*) > 1")
def duplicate_audit_extras(spark, sf_dir):
    return catalog.duplicate_audit(_dated(spark, sf_dir))


@query("""SELECT coalesce(d.doc_id, q.doc_id) AS sequence_id, CASE WHEN q.doc_id IS NULL THEN 'missing_metadata' ELSE 'unused_metadata' END AS problem
FROM documents d FULL JOIN (SELECT doc_id FROM labels UNION SELECT -1) q ON d.doc_id = q.doc_id WHERE d.doc_id IS NULL OR q.doc_id IS NULL""")
def metadata_join_audit(spark, sf_dir):
    """All documents against all labels; one label without a document is added, so that both kinds of problem occur."""
    c = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence_id"))
    m = adapters.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sequence_id"))
    return catalog.metadata_join_audit(c, m.union(spark.range(-1, 0).toDF("sequence_id")).distinct())


_MERGED = f"""{_DUP}, m AS (SELECT rep AS genome_id, label, string_agg(genome_id, ',' ORDER BY genome_id) AS ids, string_agg(genome_id || ':' || coalesce(CAST(rd AS VARCHAR), 'unknown'), ',' ORDER BY genome_id) AS dates,
  array_to_string(list_sort(list_distinct(list('A' || doc_id % 4))), ',') AS accessions, array_to_string(list_sort(list_distinct(list(sha256(sequence)))), ',') AS digests, any_value(digest) AS digest FROM r GROUP BY rep, label HAVING count(*) > 1)"""


def _marked(spark, sf_dir):
    """All documents as genomes, copies marked, and their contigs."""
    marked = materialize(catalog.rank_duplicates(_dated(spark, sf_dir)), "marked")
    c = adapters.contigs_from_documents(spark, sf_dir)
    contigs = c.select("genome_id", F.concat(F.lit("A"), F.col("doc_id") % 4).alias("accession_version"), F.sha2("sequence", 256).alias("sha256"))
    return marked, contigs


@query(f"{_MERGED} SELECT genome_id, ids, dates, accessions, digests, 'earliest_known_public_release' AS policy FROM m")
def duplicate_merge_extras(spark, sf_dir):
    """What a kept genome records of its copies."""
    f = catalog.merge_facts(*_marked(spark, sf_dir))
    names = {"ids": "duplicate_genome_ids", "dates": "duplicate_release_dates", "accessions": "duplicate_accession_versions", "digests": "duplicate_source_sequence_digests", "policy": "duplicate_merge_policy"}
    return f.select("genome_id", *[F.col("facts")[v].alias(k) for k, v in names.items()])


@query(f"""WITH {SQL_GENOMES}, t AS (SELECT digest, label, CASE WHEN genus IS NULL THEN '{{}}' ELSE '{{"genus":"' || genus || '"}}' END AS taxonomy FROM genomes)
SELECT digest, label, count(DISTINCT taxonomy) AS n_taxonomies FROM t GROUP BY digest, label HAVING count(DISTINCT taxonomy) > 1""")
def copy_taxonomy_conflicts(spark, sf_dir):
    """Copies of one class from different sources, taken as their genera."""
    g = genomes_from_documents(spark, sf_dir).withColumn("taxonomy", F.when(F.col("genus").isNotNull(), F.create_map(F.lit("genus"), F.col("genus"))))
    return catalog.copy_taxonomy_conflicts(g)


@query(f"""{_MERGED}, gone AS (SELECT genome_id, rep, label, digest, rd, doc_id % 13 AS k FROM r WHERE rep <> genome_id)
SELECT CASE k WHEN 0 THEN 'copy_without_exclusion' WHEN 1 THEN 'other_representative' WHEN 2 THEN 'other_label' WHEN 3 THEN 'other_digest' WHEN 4 THEN 'other_reason' WHEN 5 THEN 'other_date' END AS "check", genome_id AS key FROM gone WHERE k < 6
UNION ALL SELECT 'exclusion_without_copy', 'stray'""")
def exclusion_provenance(spark, sf_dir):
    """Exclusions of all copies, with a fault of each kind planted, against what the kept genomes record."""
    marked, contigs = _marked(spark, sf_dir)
    kept = marked.where("duplicate_of is null").join(catalog.merge_facts(marked, contigs), "genome_id").withColumnRenamed("facts", "metadata_extra")
    k = F.col("doc_id") % 13
    planted = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    gone = marked.where("duplicate_of is not null").where(k != 0).select(
        "genome_id", planted(2, F.lit("other"), F.col("label")).alias("label"), F.lit("reference_preflight").alias("split"), planted(4, F.lit("other"), F.lit("same_class_content_duplicate")).alias("reason"),
        planted(1, F.lit("other"), F.col("duplicate_of")).alias("duplicate_of"), planted(3, F.lit("other"), F.col("digest")).alias("source_sha256"),
        planted(5, F.lit("1999-01-01"), F.col("release_date").cast("string")).alias("release_date"),
    )
    stray = spark.createDataFrame([("stray", "virus", "reference_preflight", "same_class_content_duplicate", "doc-0", "x", None)], gone.schema)
    return audit.exclusion_violations(gone.unionByName(stray), kept)


_CELLS = r"""WITH cells AS (SELECT 'p-' || p_partkey AS key, p_brand AS sequence_id, 'g-' || p_partkey AS genome_id, CASE p_size % 3 WHEN 0 THEN 'virus' WHEN 1 THEN 'host' ELSE 'other' END AS label,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'A.1' END AS accession_version, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '2020-02-29' WHEN 2 THEN '2021-02-29' ELSE '2020-2-1' END AS release_date,
  CASE WHEN p_size % 2 = 0 THEN 'linear' ELSE 'knot' END AS topology, CAST(p_size - 5 AS VARCHAR) AS length_nt, CASE WHEN p_partkey % 5 = 0 THEN upper(sha256(p_name)) ELSE sha256(p_name) END AS sha256,
  sha256(p_type) AS canonical_sha256, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'sha256:' || sha256(p_name) END AS source_input_id,
  CASE p_partkey % 3 WHEN 0 THEN '{"family":"' || p_type || '"}' WHEN 1 THEN '[1]' ELSE '{"a":"1","a":"2"}' END AS taxonomy, '{}' AS metadata_extra FROM part)"""


@query(_CELLS + r""" SELECT key, f[1] AS field, f[2] AS fault FROM (SELECT key, unnest([
  CASE WHEN NOT regexp_full_match(sequence_id, '[A-Za-z0-9][A-Za-z0-9._:+-]{0,254}') THEN ['sequence_id', 'id'] END, CASE WHEN label = 'other' THEN ['label', 'label'] END,
  CASE WHEN release_date NOT IN ('', '2020-02-29') THEN ['release_date', 'optional date'] END, CASE WHEN topology = 'knot' THEN ['topology', 'topology'] END,
  CASE WHEN CAST(length_nt AS INTEGER) < 1 THEN ['length_nt', 'positive'] END, CASE WHEN sha256 <> lower(sha256) THEN ['sha256', 'sha256'] END,
  CASE WHEN source_input_id = '' THEN ['source_input_id', 'group id'] END, CASE WHEN taxonomy[1] = '[' OR taxonomy = '{"a":"1","a":"2"}' THEN ['taxonomy', 'json map'] END]) AS f FROM cells) WHERE f IS NOT NULL""")
def schema_violations(spark, sf_dir):
    """Every cell of parts, dressed up as sequence rows, that the schema does not allow."""
    p = adapters.table(spark, sf_dir, "part")
    n, size = F.col("p_partkey"), F.col("p_size")
    rows = p.select(
        F.concat(F.lit("p-"), n).alias("key"), F.col("p_brand").alias("sequence_id"), F.concat(F.lit("g-"), n).alias("genome_id"),
        F.when(size % 3 == 0, "virus").when(size % 3 == 1, "host").otherwise("other").alias("label"), F.when(n % 2 == 0, "").otherwise("A.1").alias("accession_version"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "2020-02-29").when(n % 4 == 2, "2021-02-29").otherwise("2020-2-1").alias("release_date"),
        F.when(size % 2 == 0, "linear").otherwise("knot").alias("topology"), (size - 5).alias("length_nt"),
        F.when(n % 5 == 0, F.upper(F.sha2("p_name", 256))).otherwise(F.sha2("p_name", 256)).alias("sha256"), F.sha2("p_type", 256).alias("canonical_sha256"),
        F.when(n % 6 == 0, "").otherwise(F.concat(F.lit("sha256:"), F.sha2("p_name", 256))).alias("source_input_id"),
        F.when(n % 3 == 0, F.concat(F.lit('{"family":"'), "p_type", F.lit('"}'))).when(n % 3 == 1, "[1]").otherwise('{"a":"1","a":"2"}').alias("taxonomy"), F.lit("{}").alias("metadata_extra"),
    )
    return schemas.schema_violations(rows, "sequence-row", "key")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'virus' ELSE 'host' END AS metadata_label, CASE WHEN doc_id % 3 = 0 THEN 'host' ELSE 'virus' END AS channel
FROM labels WHERE (quality = 1) <> (doc_id % 3 <> 0)""")
def metadata_label_channel_conflict(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "virus").otherwise("host").alias("metadata_label"), F.when(F.col("doc_id") % 3 == 0, "host").otherwise("virus").alias("channel")
    )
    return catalog.label_channel_conflicts(rows)


@query("""WITH ids AS (SELECT p_partkey, p_brand AS id FROM part UNION ALL SELECT c_custkey, 'c-' || c_custkey FROM customer UNION ALL SELECT o_orderkey, o_orderpriority FROM orders)
SELECT p_partkey AS row_key, id FROM ids WHERE NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._:+-]{0,254}')""")
def stable_id_violations(spark, sf_dir):
    part = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_key"), F.col("p_brand").alias("id"))
    cust = adapters.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c-"), "c_custkey"))
    orders = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return catalog.stable_id_violations(part.union(cust).union(orders), "id")


_SEGMENTS = """segments AS (SELECT o_custkey AS genome_id, o_orderkey AS sequence_id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS release_date,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS accession_version, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'host' ELSE 'virus' END AS label,
  n_name AS family, r_name AS order_rank, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {_SEGMENTS} SELECT genome_id, CASE WHEN count(release_date) = count(*) THEN max(release_date) END AS release_date, count(*) - count(release_date) AS n_missing FROM segments GROUP BY genome_id")
def group_release_date(spark, sf_dir):
    """The latest segment date, but only of genomes with every segment dated."""
    s = adapters.segments_from_orders(spark, sf_dir)
    return s.groupBy("genome_id").agg(catalog.all_or_nothing_date(F.col("release_date")).alias("release_date"), (F.count("*") - F.count("release_date")).alias("n_missing"))


@query(f"WITH {_SEGMENTS} SELECT genome_id, CASE WHEN count(DISTINCT accession_version) = 1 THEN max(accession_version) END AS accession_version FROM segments GROUP BY genome_id")
def group_accession(spark, sf_dir):
    return adapters.segments_from_orders(spark, sf_dir).groupBy("genome_id").agg(catalog.only_value(F.col("accession_version")).alias("accession_version"))


@query(f"""WITH {_SEGMENTS}, ranked AS (SELECT 'n-' || family AS genome_id, unnest(['family', 'order', 'status']) AS rank, unnest([family, order_rank, status]) AS value FROM segments)
SELECT genome_id, rank, count(DISTINCT value) AS n_values FROM ranked GROUP BY genome_id, rank HAVING count(DISTINCT value) > 1""")
def group_taxonomy_conflicts(spark, sf_dir):
    """Genomes are all segments of a nation, which agree on two of three ranks."""
    s = adapters.segments_from_orders(spark, sf_dir).withColumn("genome_id", F.concat(F.lit("n-"), "family"))
    rank = lambda r, c: F.struct(F.lit(r).alias("rank"), F.col(c).alias("value"))
    return catalog.taxonomy_conflicts(s.select("genome_id", F.inline(F.array(rank("family", "family"), rank("order", "order_rank"), rank("status", "status")))))


@query(f"""WITH {_SEGMENTS}, extras AS (SELECT genome_id, unnest(['segment_status', 'nation']) AS key, unnest([status, family]) AS value FROM segments), sizes AS (SELECT genome_id, count(*) AS n FROM segments GROUP BY genome_id)
SELECT genome_id, key, min(value) AS value FROM extras JOIN sizes USING (genome_id) GROUP BY genome_id, key, n HAVING count(*) = n AND min(value) = max(value)""")
def group_common_extras(spark, sf_dir):
    s = adapters.segments_from_orders(spark, sf_dir)
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    extras = s.select("genome_id", F.inline(F.array(pair("segment_status", "status"), pair("nation", "family"))))
    return catalog.common_extras(extras, s.groupBy("genome_id").agg(F.count("*").alias("n")))


@query("""SELECT l_orderkey, l_linenumber, try_cast(CAST(l_linenumber AS VARCHAR) AS BIGINT) AS n, CASE WHEN l_tax * 20 BETWEEN 0 AND 1 THEN round(l_tax * 20, 9) END AS share,
  CAST(l_shipdate AS DATE) AS day FROM lineitem""")
def typed_cells(spark, sf_dir):
    """Text cells parsed back to integers, fractions and dates; what does not parse is null."""
    li = adapters.table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    share = text.fraction((F.col("l_tax") * 20).cast("string"))
    return li.select("l_orderkey", "l_linenumber", text.canonical_int(F.col("l_linenumber").cast("string")).alias("n"), F.round(share, 9).alias("share"), text.iso_date(day).alias("day"))


@query("""SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END), ''), nullif(trim(p_brand), '')) AS family FROM part""")
def rank_alias(spark, sf_dir):
    """A rank, or else its alias where the rank is blank."""
    p = adapters.table(spark, sf_dir, "part")
    return p.select("p_partkey", text.first_filled(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" ")), F.col("p_brand")).alias("family"))


@query("""SELECT c_custkey, '{"nation":"' || c_nationkey || '","segment":"' || c_mktsegment || '"}' AS extra FROM customer""")
def map_json(spark, sf_dir):
    """Metadata maps as compact JSON in key order."""
    c = adapters.table(spark, sf_dir, "customer")
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", text.sorted_map_json(m).alias("extra"))


@query(f"WITH {_SEGMENTS} SELECT label, count(DISTINCT genome_id) AS n FROM segments GROUP BY label")
def label_counts(spark, sf_dir):
    s = adapters.segments_from_orders(spark, sf_dir)
    return catalog.label_counts(s.select("genome_id", "label").distinct())


@query(f"WITH {_SEGMENTS} SELECT l_linenumber, l_orderkey, CASE WHEN x IS NULL THEN 'no_detectable_match' WHEN x < 0.3 THEN 'distant_detectable' WHEN x < 0.7 THEN 'low_similarity' WHEN x < 0.9 THEN 'moderate_similarity' ELSE 'high_similarity' END AS band FROM (SELECT *, CASE WHEN l_linenumber <> 7 THEN round(l_discount * 10, 2) END AS x FROM lineitem)")
def similarity_bands(spark, sf_dir):
    m = adapters.matrix_from_lineitem(spark, sf_dir)
    return m.select(F.col("row_line").alias("l_linenumber"), F.col("row_key").alias("l_orderkey"), similarity.classify(F.col("similarity")).alias("band"))


@query()
def taxon_casefold(spark, sf_dir):
    """Full case folding of whole texts as taxa, which lower() does not give."""
    w = adapters.table(spark, sf_dir, "documents").select("doc_id", F.upper("text").alias("taxon"))
    return w.select("doc_id", text.casefold(F.col("taxon")).alias("folded"))


@query()
def float_text(spark, sf_dir):
    """Similarities as the shortest text that reads back equal."""
    m = adapters.matrix_from_lineitem(spark, sf_dir)
    return m.select("row_key", "row_line", text.float_text(F.col("similarity") / 3).alias("similarity"))
