import random

import xxhash
from pyspark.sql import functions as F

from splitbench.llm import components, simhash

from .conftest import documents


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = [i for i, _ in prints]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((str(ids[i]), least.get(find(i))) for i in range(len(ids)))


def test_fingerprints_match_a_slow_version():
    for text in ("", None, "One", "one TWO", "A b\tc\nd É", "É é a b " * 900, "ÀB c d"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_pairs_lose_no_link(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3, 3, 4, 5)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_pairs(spark.createDataFrame(signed, "fp long")).collect()}
    want = {(a, b) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 3}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in want} and len(got) == len(want) // 2


def test_the_index_is_not_broadcast(spark):
    pairs = simhash.near_pairs(spark.range(100).toDF("fp"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rounds_over_many_edges_broadcast_nothing(spark, monkeypatch):
    edges = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
    for star in (components._large_star, components._small_star):
        assert "Broadcast" not in star(edges, True)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(components, "FEW_ROWS", 0)
    assert {r.label for r in components.connected_components(edges).collect()} == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 299), (299, 300)]
    out = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").where("a <> b")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + i] == 100 for i in range(30)) and out[300] == 299


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for group in range(12):
        text = rng.choices(words, k=400)
        for copy in range(1 + group % 4):
            changed = list(text)
            if copy:
                changed[rng.randrange(400)] = "changed"
            rows.append((n, " ".join(changed), "en", "s"))
            n += 1
    return rows


def test_near_duplicates_match_brute_force(spark, odd):
    df = odd.union(documents(spark, [(i + 1000, *r) for i, *r in near_rows()]))
    want = brute_components([(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want
    digest = simhash.digest_components(simhash.near_duplicates(df)).where("doc_id = 100").first()
    assert digest.fingerprint == "0" * 16 and digest.component_id == 100


def test_one_row_of_each_group_stays(spark, odd, clashing, empty):
    df = odd.union(documents(spark, [(i + 1000, *r) for i, *r in near_rows()]))
    labels = {str(i): c for i, c in brute_components([(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()])}
    kept = simhash.keep_one(df)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted(set(labels.values()), key=str)
    assert kept.columns == df.columns and simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0
    nameless = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(nameless).count() == len(set(labels.values()))
