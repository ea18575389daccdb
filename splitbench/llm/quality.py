"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule is a predicate over one row.  On a sample of the rows that reach the
rules at all, its rejections are counted and its cost estimated: one unit for
each row, and one for each character that one of its patterns reads.  The rules
then run in order of rejections per cost, each judged on what those before it
leave, and a row stops at the first rule that it fails.  Costs are counted, not
timed, so that reruns choose the same order; the order never changes which rows
are kept.

Defined cases: a null text has no words and every count is 0; texts of any
length are read whole; repeated rows are judged alike; an empty table gives no
rows and leaves the rules in their given order; columns named like the results
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, WORD, Numbered, pick

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def removed(text: Column, pattern: str) -> Column:
    """How many characters of text the pattern matches."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, pattern, "")), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return (F.coalesce(F.length(text), F.lit(0)) - removed(text, BLANK + "+")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words that the text has twice or more.

    Windows are compared by a 64-bit hash.  Texts without a repeat, most of them,
    need one hash set; the others sort (hash, place) pairs, so that long
    repetitive texts cost n log n.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(p, at)["h"] == x["h"], F.lit(False))
            twice = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def length(starts: Column) -> Column:
            # A window adds five words, or as many as lie before the next one's start.
            own = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(pairs, repeats), length))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered))

    return let(words, windows).cast("long")


def base_statistics(df: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row."""
    text = F.col("text")

    def of_words(w: Column) -> Column:
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), n_repeat_words(w).alias("n_repeat_words"))

    counted = pick(df, "doc_id", "text").select(
        "doc_id",
        "text",
        let(words_of(text), of_words).alias("w"),
        n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words").withColumn("base_failed", failed)


@dataclass(frozen=True)
class Rule:
    """A named predicate that is true for rows to reject."""

    name: str
    fails: Column

    def scans(self) -> int:
        """How often the predicate goes through the text: its calls of functions that match patterns."""
        return len(re.findall(r"\b(?:regexp_\w+|rlike|split)\(", str(self.fails), re.IGNORECASE))


#: What default_rules() can take from columns of base_statistics().
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines")


def default_rules(counted: bool = False) -> list[Rule]:
    """Rules over ``text``, and over base_statistics() if they are ``counted`` already.

    Their thresholds leave ordinary prose of any language alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text).cast("double")
    part = lambda pattern: removed(text, pattern) / F.greatest(size, F.lit(1.0))
    made = {"n_words": F.regexp_count(text, F.lit(WORD)), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text)}
    n_words, chars, symbols, dup_lines = (F.col(f"_stat_{name}") if counted else made[name] for name in STATISTICS)
    n_lines = F.greatest(F.regexp_count(text, F.lit(r"[^\n]*[^\x20\x09-\x0D][^\n]*")), F.lit(1))
    return [
        Rule("too_few_words", n_words < 10),
        Rule("symbols", symbols > 0.3 * n_words),
        Rule("mostly_no_letters", part(r"\p{L}+") < 0.4),
        Rule("shouting", (part(r"\p{Lu}+") > 0.5 * part(r"\p{L}+")) & (size > 40)),
        Rule("repeated_lines", (dup_lines > 0) & (dup_lines > 0.3 * n_lines)),
        Rule("word_length", ~(chars / F.greatest(n_words, F.lit(1))).between(1.5, 60.0)),
    ]


def order_rules(sample: DataFrame, rules: list[Rule], reach: Column | None = None) -> list[Rule]:
    """The rules by rejections per unit of work, each judged on sample rows that those before it leave.

    Rows that do not ``reach`` the rules do not count.  One job returns a count
    and the characters read for each set of failed rules, at most one row per
    sample row.
    """
    if len(rules) < 2:
        return list(rules)
    if reach is not None:
        sample = sample.where(reach)
    mask = sum((F.when(F.coalesce(r.fails, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)), F.lit(0))
    seen = sample.select(mask.alias("mask"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    groups = seen.groupBy("mask").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    scans = [r.scans() for r in rules]
    left, order = list(range(len(rules))), []
    while left:

        def gain(i: int) -> float:
            rejected = sum(g["n"] for g in groups if g["mask"] >> i & 1)
            return rejected / max(sum(g["n"] + scans[i] * g["chars"] for g in groups), 1)

        best = max(left, key=lambda i: (gain(i), -scans[i], -i))
        order.append(rules[best])
        left.remove(best)
        groups = [g for g in groups if not g["mask"] >> best & 1]
    return order


def sample_of(df: DataFrame, rows: int, seed: int = 17) -> DataFrame:
    """A Bernoulli sample over all of df, of about so many rows."""
    return df.sample(fraction=min(1.0, rows / max(1, df.count())), seed=seed)


def quality_cascade(
    df: DataFrame, rules: list[Rule] | None = None, before: str | None = None, sample_rows: int = 2000, counted: bool = False, sample: DataFrame | None = None
) -> DataFrame:
    """df with kept and failed_rule (null if kept), rules in order of rejections per cost.

    ``before`` names a boolean column of df that is known already: rows for which
    it holds are rejected as ``before`` without looking at any rule.  A CASE
    evaluates its branches in order and stops at the first that holds.  With
    ``counted``, df comes from base_statistics() and its counts are not made
    again.  ``sample`` has the columns of df; without it, about ``sample_rows``
    rows of df are drawn.
    """
    own = Numbered(df)

    def ready(rows: DataFrame) -> DataFrame:
        named = {"text": F.col(own.place("text"))} | {f"_stat_{name}": F.col(own.place(name)) for name in STATISTICS if counted}
        return rows.withColumns(named)

    drawn = sample_of(own.df, sample_rows) if sample is None else Numbered(sample).df
    out = F.lit(False) if before is None else F.coalesce(F.col(own.place(before)), F.lit(False))
    ordered = order_rules(ready(drawn), default_rules(counted) if rules is None else rules, ~out)
    verdict = F.when(out, F.lit("before"))
    for rule in ordered:
        verdict = verdict.when(rule.fails, F.lit(rule.name))
    judged = ready(own.df).withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())
    return own.restore(judged, "kept", "failed_rule")


def judge_documents(df: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """base_statistics() of df with kept and failed_rule; a row that fails the base is rejected before any rule.

    The sample is drawn from df itself, so that nothing is counted on rows outside it.
    """
    rows = pick(df, "doc_id", "text")
    return quality_cascade(base_statistics(rows), before="base_failed", counted=True, sample=base_statistics(sample_of(rows, sample_rows)))
