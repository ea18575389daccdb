import datetime
import random

import pytest
from pyspark.sql import functions as F

from splitbench.errors import ConfigurationError, InputError, IntegrityError
from splitbench.operators import audit, catalog, intervals, sampling, similarity, stats
from splitbench.plans import benchmark, protocols
from splitbench.sources import adapters

D = datetime.date


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


CONTIG = "sequence_id string, genome_id string, label string, sequence string, topology string, accession_version string, release_date date, taxonomy map<string,string>, metadata_extra map<string,string>, source_input_id string"


def contigs(spark, items):
    """Items of (sequence_id, genome_id, label, sequence) with more fields by name."""
    out = []
    for (s, g, label, seq), more in items:
        out.append((s, g, label, seq, more.get("topology", "linear"), more.get("acc"), more.get("date"), more.get("tax", {}), more.get("extra", {}), "sha256:x"))
    return spark.createDataFrame(out, CONTIG)


def dna(seed, n=80):
    return "".join(random.Random(seed).choices("ACGT", k=n))


BASE = [(("b1", "b1", "virus", dna(1)), {}), (("b2", "b2", "virus", dna(2)), {}), (("h1", "h1", "host", dna(3)), {}), (("h2", "h2", "host", dna(4)), {})]


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_segmented_genome(spark):
    segs = [
        (("segA", "iso", "virus", dna(8)), {"date": D(2019, 1, 1), "acc": "N_1.1", "tax": {"family": "F"}, "extra": {"host": "x", "lab": "1"}}),
        (("segB", "iso", "virus", dna(9)), {"date": D(2020, 1, 1), "acc": "N_2.1", "extra": {"host": "x", "lab": "2"}}),
    ]
    g = benchmark.build_catalog(contigs(spark, BASE + segs)).genomes.where("genome_id = 'iso'").first()
    assert g.release_date == D(2020, 1, 1) and g.accession_version is None and g.taxonomy == {"family": "F"}
    assert g.metadata_extra["host"] == "x" and "lab" not in g.metadata_extra and g.metadata_extra["grouped_sequence_count"] == "2"
    segs[1][1]["date"] = None
    g = benchmark.build_catalog(contigs(spark, BASE + segs)).genomes.where("genome_id = 'iso'").first()
    assert g.release_date is None and g.metadata_extra["missing_release_date_sequences"] == "segB"


def test_taxonomy_conflict(spark):
    segs = [(("a", "iso", "virus", dna(8)), {"tax": {"family": "A"}}), (("b", "iso", "virus", dna(9)), {"tax": {"family": "B"}})]
    with pytest.raises(InputError, match="taxonomy"):
        benchmark.build_catalog(contigs(spark, BASE + segs))


def test_content_with_both_labels(spark):
    s = "AACCGGTTACGA" * 10
    both = [(("v", "v", "virus", s), {}), (("h", "h", "host", rc(s)), {})]
    with pytest.raises(InputError, match="both labels"):
        benchmark.build_catalog(contigs(spark, BASE + both))
    both[0][1]["topology"] = "circular"
    with pytest.raises(InputError, match="both labels"):
        benchmark.build_catalog(contigs(spark, BASE + both))


def test_copies_of_one_class(spark):
    s = "ACGT" * 30
    copies = [(("v2", "v2", "virus", s), {}), (("v1", "v1", "virus", s), {})]
    with pytest.raises(InputError, match="copies"):
        benchmark.build_catalog(contigs(spark, BASE + copies))
    cat = benchmark.build_catalog(contigs(spark, BASE + copies), "drop")
    assert rows(cat.exclusions, "genome_id", "duplicate_of") == [("v2", "v1")]
    copies[0][1]["topology"] = "circular"
    assert benchmark.build_catalog(contigs(spark, BASE + copies)).genomes.count() == 6


def genomes(spark, items):
    return spark.createDataFrame(items, "genome_id string, label string, group_id string, release_date date, taxon string")


def test_holdout_is_order_free_and_has_both_sides(spark):
    g = genomes(spark, [(f"g{i}", "virus" if i % 2 else "host", f"x{i // 3}-{i % 2}", None, None) for i in range(60)])
    one = protocols.genome_holdout(g, 0.3, 7)
    two = protocols.genome_holdout(g.repartition(5, "release_date").orderBy(F.desc("genome_id")), 0.3, 7)
    assert rows(one, "genome_id", "partition") == rows(two, "genome_id", "partition")
    assert audit.plan_violations(one).isEmpty()
    assert rows(protocols.genome_holdout(g, 0.3, 8), "genome_id", "partition") != rows(one, "genome_id", "partition")


def test_ranking_equals_one_sorted_pass(spark):
    from splitbench.functions.hashing import semantic_rank

    g = spark.createDataFrame([("l", f"g{i}", 1 + i % 3) for i in range(300)], "label string, group_id string, n long")
    out = protocols.ranked(g, ["label"], semantic_rank(1, "n", F.col("group_id")), "group_id", "n").collect()
    import hashlib

    order = sorted(g.collect(), key=lambda r: hashlib.sha256(f"1|n|{r.group_id}".encode()).hexdigest())
    cum, want = 0, {}
    for i, r in enumerate(order, 1):
        cum += r.n
        want[r.group_id] = (i, cum)
    assert {r.group_id: (r.idx, r.cum) for r in out} == want


def test_temporal(spark):
    items = [(f"{k}-{i}", k, f"{k}{i}", D(2019 + i, 1, 1), None) for k in ("virus", "host") for i in (1, 2, 3, 4)]
    items += [("late", "virus", "virus1", D(2024, 1, 1), None), ("undated", "virus", "u", None, None)]
    out = {r.genome_id: (r.partition, r.reason) for r in protocols.temporal_holdout(genomes(spark, items), "2021-01-01").collect()}
    assert out["virus-2"] == ("train", "release_date_on_or_before_cutoff") and out["virus-3"][0] == "test"
    assert out["late"] == ("train", "sequence_group_available_on_or_before_cutoff") and out["undated"] == ("excluded", "missing_release_date")
    with pytest.raises(ConfigurationError):
        protocols.temporal_holdout(genomes(spark, items), "2021-01-01", "error")
    cutoff = protocols.choose_cutoff(genomes(spark, items), 0.5, 11)
    assert audit.plan_violations(protocols.temporal_holdout(genomes(spark, items), cutoff)).isEmpty()


def test_taxonomic(spark):
    items = [("v1", "virus", "1", None, "Alpha"), ("v2", "virus", "2", None, "alpha"), ("v3", "virus", "3", None, "Beta"), ("v4", "virus", "4", None, None)]
    items += [(f"h{i}", "host", f"h{i}", None, None) for i in range(4)]
    out = {r.genome_id: (r.partition, r.reason) for r in protocols.taxonomic_holdout(genomes(spark, items), ["alpha"]).collect()}
    assert out["v1"][0] == out["v2"][0] == "test" and out["v3"] == ("train", "non_holdout_taxon") and out["v4"] == ("excluded", "missing_taxonomy_family")
    assert {out[f"h{i}"][0] for i in range(4)} == {"train", "test"}


def test_gate(spark):
    t = spark.createDataFrame(
        [("a", "r", 0.99, 0.90), ("b", "r", 0.99, 0.50), ("c", "r", 0.95, 0.90), ("d", "r", 0.40, 0.90), ("e", "r", None, None), ("f", "r", 0.99, None)],
        "query_genome_id string, reference_genome_id string, similarity double, coverage double",
    ).withColumn("method", F.lit("m1"))
    hits = similarity.collapse_table(t, 0.95, 0.85).withColumnRenamed("query_genome_id", "genome_id")
    proposal = t.select(F.col("query_genome_id").alias("genome_id"), F.lit("virus").alias("label"), F.col("query_genome_id").alias("group_id"), F.lit("test").alias("candidate_partition"))
    out = {r.genome_id: r for r in protocols.apply_gate(proposal, hits).collect()}
    assert [g for g, r in out.items() if r.partition == "excluded"].sort() == ["a", "f"].sort()
    assert out["b"].reason == "similarity_above_identity_below_minimum_coverage" and out["c"].partition == "test"
    assert out["e"].similarity_bin == "no_detectable_match" and out["e"].nearest_train_genome_id is None


def test_qualifying_hit_may_hide_behind_the_best(spark):
    t = spark.createDataFrame([("q", "a", 0.99, 0.10, "m1"), ("q", "b", 0.98, 0.90, "m1")], "query_genome_id string, reference_genome_id string, similarity double, coverage double, method string")
    r = similarity.collapse_table(t, 0.95, 0.85).first()
    assert r.nearest_train_genome_id == "a" and r.strict_gate_train_genome_id == "b"


def test_sketches(spark):
    seqs = {"x": "ACGT" * 30, "y": rc("ACGT" * 30), "a": "A" * 100, "c": "C" * 100, "short": "ACG", "n": "N" * 50, "r": dna(5, 3000)}
    s = similarity.sketches(spark.createDataFrame(list(seqs.items()), "genome_id string, sequence string"), 7, 100)
    by = {r.genome_id: r for r in s.collect()}
    assert by["x"].hashes == by["y"].hashes and "short" not in by and "n" not in by and by["r"].unique_kmers == 101 and not by["r"].is_exact
    pairs = similarity.pairwise(s.withColumnRenamed("genome_id", "query_id"), s.withColumnRenamed("genome_id", "reference_id"), 7, 100)
    got = {(r.query_id, r.reference_id): r.jaccard for r in pairs.collect()}
    assert got["x", "y"] == 1.0 and ("a", "c") not in got and got["r", "r"] == 1.0


def test_sampler(spark):
    c = contigs(spark, [(("A1", "A", "virus", dna(1, 10)), {}), (("A2", "A", "virus", dna(2, 30)), {}), (("B1", "B", "host", dna(3, 12)), {"topology": "circular"})])
    f = sampling.sample_fragments(c, [5, 7], 17, 9182)
    assert rows(f, "fragment_id", "sequence", "start") == rows(sampling.sample_fragments(c.repartition(3).orderBy(F.desc("sequence_id")), [5, 7], 17, 9182), "fragment_id", "sequence", "start")
    assert sampling.reconstruction_violations(f, c).isEmpty()
    sizes = {(r.genome_id, r.fragment_length): r["count"] for r in f.groupBy("genome_id", "fragment_length").count().collect()}
    assert sizes["A", 5] + sizes["A", 7] == 17 and abs(sizes["A", 5] - sizes["A", 7]) == 1
    assert sorted(r.ordinal for r in sampling.with_ordinals(f).collect()) == list(range(34))
    assert f.where("genome_id = 'B' and end > 12").count() > 0
    assert sampling.sample_fragments(c, [5], 10, 1).where("fragment_id is null").count() == 0
    seq = sampling.sample_sequential(c, [5, 7], 17, 9182)
    assert sampling.reconstruction_violations(seq, c).isEmpty() and seq.count() == 34


def test_sampling_weights(spark):
    c = contigs(spark, [(("s", "g", "virus", dna(1, 10)), {}), (("l", "g", "virus", dna(2, 30)), {})])
    f = sampling.sample_fragments(c, [5], 6400, 3)
    assert abs(f.where("sequence_id = 's'").count() / 6400 - 6 / 32) < 0.025


def test_sampler_gives_up_on_ambiguous_genomes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_ATTEMPTS", 40)
    c = contigs(spark, [(("n", "g", "virus", "N" * 50), {})])
    with pytest.raises(InputError, match="attempts"):
        sampling.sample_fragments(c, [5], 2, 1)
    assert rows(sampling.length_preflight(c, [5, 60]), "genome_id", "fragment_length") == [("g", 60)]


def test_random_split_has_both_sides_in_each_stratum(spark):
    c = contigs(spark, [((f"s{i}", f"g{i}", "virus", dna(i, 60)), {}) for i in range(4)])
    s = sampling.random_split(sampling.sample_fragments(c, [5, 9], 10, 1), 0.05, 2)
    sides = s.groupBy("genome_id", "fragment_length").agg(F.count_distinct("partition").alias("n"))
    assert sides.where("n < 2").isEmpty()


def test_intervals(spark):
    train = spark.createDataFrame([("t", "g", 8, 12, 10), ("u", "g", 0, 3, 10)], "fragment_id string, k string, start long, end long, source_length long")
    test = spark.createDataFrame([("x", "g", 9, 12, 10), ("y", "g", 3, 8, 10)], train.schema)
    cut = lambda d: intervals.segments(d).select("fragment_id", "k", F.col("segment_start").alias("start"), F.col("segment_end").alias("end"))
    assert [r[0] for r in intervals.overlapping(cut(test), cut(train), ["k"], "fragment_id", 4).collect()] == ["x"]
    touching = spark.createDataFrame([("g", 0, 5), ("g", 5, 7), ("g", 6, 9)], "k string, start long, end long")
    assert rows(intervals.islands(touching, ["k"]), "start", "end") == [(0, 5), (5, 9)]


def test_statistics(spark):
    f = spark.createDataFrame([("g", "virus", "ACGTN"), ("h", "host", "GG")], "genome_id string, label string, sequence string")
    s = stats.stats_maps(f)
    assert s["records"] == 2 and s["bases"] == 7 and s["records_by_length"] == {"2": 1, "5": 1} and list(s["records_by_length"]) == ["2", "5"]
    empty = stats.stats_maps(f.limit(0))
    assert empty["records"] == 0 and empty["gc_fraction"] is None


def test_plan_violations(spark):
    a = spark.createDataFrame([("a", "virus", "g", "train"), ("b", "virus", "g", "test"), ("a", "virus", "g", "train"), ("h", "host", "x", "train")], "genome_id string, label string, group_id string, partition string")
    assert rows(audit.plan_violations(a), "check", "key") == [("assigned_twice", "a"), ("group_on_both_sides", "g"), ("label_missing_on_a_side", "host")]
    with pytest.raises(IntegrityError):
        benchmark._checked(benchmark.Split("genome", a))


@pytest.mark.parametrize("k", [1, 2, 7, 8, 21, 31])
def test_kmer_counts_are_those_of_the_kmers(spark, monkeypatch, k):
    """Also for genomes of several rows, without an identifier, with ambiguous letters, and longer than what is counted at once."""
    monkeypatch.setattr(similarity, "LONG", 500)
    monkeypatch.setattr(similarity, "AT_ONCE", 300)
    r = random.Random(k)
    text = lambda n: "".join(r.choices("ACGT" * 30 + "N", k=n))
    repeat = text(97)
    rows = [("a", text(400)), ("b", repeat * 3), ("b", repeat), ("b", text(40)), (None, text(60)), (None, repeat), ("c", repeat * 20), ("d", "ACG"), ("e", "N" * 50), ("f", ""), ("g", None), ("h", "T" * 40)]
    df = spark.createDataFrame(rows, "genome_id string, sequence string")
    want = similarity.canonical_kmers(df, k).groupBy("genome_id").agg(F.count("*").alias("n"), F.count_distinct("kmer").alias("n_distinct"), F.min("kmer").alias("first"))
    assert sorted(map(str, similarity.kmer_counts(df, k).collect())) == sorted(map(str, want.collect()))


def test_kmers_are_not_shuffled(spark, sf_dir):
    """Of genomes in one row no k-mer becomes a row."""
    c = adapters.contigs_from_documents(spark, sf_dir).select("genome_id", "sequence")
    assert "explode" not in similarity.kmer_counts(c, 21)._jdf.queryExecution().toString()


def related(seed, n, length=160):
    """Sequences of shared words, some of them copies, some too short for a k-mer, some long."""
    r = random.Random(seed)
    words = ["".join(r.choices("ACGT", k=12)) for _ in range(30)]
    texts = ["".join(r.choices(words, k=r.randrange(1, length // 12))) for _ in range(n)]
    return [(f"g{i}", r.choice(texts[: i + 1]) if i % 3 == 0 else t[:3] if i % 17 == 5 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,size", [(2, 8), (5, 10), (11, 40), (11, 400)])
def test_sketch_hits_are_the_nearest_of_all_pairs(spark, monkeypatch, k, size):
    """In several blocks of either side, and with ties at an identity of 0; no pair becomes a row."""
    monkeypatch.setattr(similarity, "BLOCK", 300)
    df = spark.createDataFrame(related(k, 90), "genome_id string, sequence string")
    sketched = similarity.sketches(df, k, size)
    test = F.crc32("genome_id") % 3 == 0
    proposal = df.select("genome_id", F.when(test, "test").otherwise("train").alias("candidate_partition"))
    hits = protocols.sketch_hits(proposal, sketched, k, size, 0.95)
    q, r = sketched.where(test).withColumnRenamed("genome_id", "query_id"), sketched.where(~test).withColumnRenamed("genome_id", "reference_id")
    want = similarity.nearest(similarity.pairwise(q, r, k, size), q)
    assert rows(hits, "genome_id", "nearest_train_genome_id", "max_train_similarity") == rows(want, "query_id", "nearest_id", "max_similarity")
    plan = hits._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan


@pytest.mark.parametrize("k,size", [(1, 3), (11, 20), (31, 500)])
def test_sketches_by_row_are_those_of_merged_stretches(spark, monkeypatch, k, size):
    monkeypatch.setattr(similarity, "LONG", 900)
    some = [*related(k, 40), ("long", dna(1, 5000)), ("unclear", dna(2, 90) + "N" + dna(3, 90)), ("none", None), (None, dna(4)), ("g1", dna(5)), ("n", "N" * 60)]
    df = spark.createDataFrame(some, "genome_id string, sequence string")
    got, want = similarity.sketches(df, k, size), similarity._sketch_columns(similarity._merged_parts(df, k, size, "genome_id", "sequence"), size, "genome_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    once = similarity.sketches(df.where("genome_id <> 'g1'"), k, size)
    assert "MapInArrow" in once._jdf.queryExecution().toString()
