import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from splitbench.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def counted(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_statistics(df).collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=80), min_size=1, max_size=30))
def test_base_statistics_match_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert counted(df) == {i: brute(t) for i, t in enumerate(texts)}


def test_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in quality.quality_cascade(quality.base_statistics(odd), before="base_failed").collect()}
    assert rows[100].n_words == 0 and not rows[100].kept and rows[101].word_chars == 0
    assert rows[103].n_repeat_words == 30_000 and rows[104].n_words == 1
    assert counted(odd)[103] == brute("word " * 30_000)
    assert rows[0].kept


def test_order_never_changes_the_verdict(spark, odd):
    verdicts = []
    for rules in (quality.default_rules(), quality.default_rules()[::-1]):
        out = quality.quality_cascade(odd, rules)
        verdicts.append(sorted((str(r.doc_id), str(r.text)[:20], r.kept) for r in out.collect()))
    assert verdicts[0] == verdicts[1]


def test_rules_are_ordered_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(100)], "doc_id long, text string")
    n = F.length("text")
    rules = [
        quality.Rule("dear", F.regexp_count("text", F.lit("x")) > 10),
        quality.Rule("cheap", n > 50),
        quality.Rule("useless", n < 0),
    ]
    assert [r.scans() for r in rules] == [1, 0, 0]
    assert [r.name for r in quality.order_rules(df, rules)] == ["cheap", "dear", "useless"]


def test_rules_are_judged_on_rows_that_reach_them(spark):
    """A rule that rejects only what was out before counts for nothing, and every partition is sampled."""
    rows = [(i, "few words" if i < 300 else " ".join(f"#{chr(97 + k)}" for k in range(20)) if i % 3 else "a plain text of more than ten words that every rule lets pass by") for i in range(600)]
    df = quality.base_statistics(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(6, "doc_id"))
    rules = [quality.Rule("few", F.col("n_words") < 10), quality.Rule("useless", F.length("text") < 0), quality.Rule("symbols", F.col("n_symbols") > 5)]
    assert [r.name for r in quality.order_rules(df, rules, reach=~F.col("base_failed"))][0] == "symbols"
    assert [r.name for r in quality.order_rules(df, rules)][0] == "few"
    sampled = df.sample(fraction=0.1, seed=17).select(F.spark_partition_id().alias("p")).distinct().count()
    assert sampled == 6


def test_counted_rules_agree_with_rules_on_text(spark, odd):
    counts = quality.base_statistics(odd)
    both = [quality.quality_cascade(counts, counted=c).select("doc_id", "text", "kept").collect() for c in (True, False)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1]))


def test_empty_and_clashing(spark, empty, clashing):
    assert quality.quality_cascade(quality.base_statistics(empty), before="base_failed").count() == 0
    assert quality.quality_cascade(quality.base_statistics(clashing), before="base_failed").count() == 12
    direct = quality.quality_cascade(clashing)
    assert direct.count() == 12 and dict(direct.dtypes)["kept"] == "boolean"
    plan = quality.quality_cascade(quality.base_statistics(clashing))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan
