import math
import random

import pytest
from pyspark.sql import functions as F

from splitbench.llm import mixing

from .conftest import documents


def test_targets_stop_at_three_times_a_source():
    t = mixing.targets([("a", 10), ("b", 1000), ("c", 1000), (None, 1)])
    assert t["a"] == 30 and t[None] == 3 and math.isclose(sum(t.values()), 2011)
    assert t["b"] / 2 == pytest.approx(t["c"] / 3)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}
    assert mixing.targets([("z", 100), ("a", 100), (None, 100)]) == {"a": 50, "z": 100, None: 150}


def test_taken_words_meet_the_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(400), "en", rng.choice(["hot"] * 5 + ["b", "c", "d", None])) for i in range(800)]
    out = mixing.mix_sources(documents(spark, rows)).collect()
    sums = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        sums.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    for taken, target, _ in sums.values():
        assert taken == math.floor(target)
    again = mixing.mix_sources(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_repeated_ids_at_the_threshold(spark):
    rows = [(1, "one two three four", "en", "a")] * 300 + [(2, "x " * 900, "en", "b")]
    out = mixing.mix_sources(documents(spark, rows)).where("source = 'a'").collect()
    assert abs(sum(r.taken for r in out) - out[0].target) <= 300


def test_odd_rows(spark, odd, empty, clashing):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r.size for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[100].size == 0 and by[100].taken == 0 and by[103].size == 30_000 and by[101].source is None
    assert mixing.mix_sources(empty).count() == 0 and mixing.repeat_by_mix(empty).count() == 0
    assert mixing.repeat_by_mix(clashing).columns == clashing.columns


def test_repeats_follow_the_mix(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(400)] + [(999, "", "en", "a")]
    df = documents(spark, rows)
    n = {r.source: r.n for r in mixing.repeat_by_mix(df).where("doc_id < 999").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 400 / 3) <= 1 and abs(n["b"] - 800 / 3) <= 1
    assert mixing.repeat_by_mix(df).where("doc_id = 999").count() == 1


def test_main_path_is_native(odd):
    plan = mixing.mix_sources(odd)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan
