"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its id.  Words are summed by source and leading
hash digits; a running sum over at most 2**10 buckets of a source finds the
bucket in which the source's budget ends, and only that bucket is looked at with
the next 10 bits, six times in all.  A row is then taken by comparing its hash
with its source's threshold: nothing is sorted, and no row is moved.

Defined cases: a null text has size 0; null sources are one source, the last; a
null id hashes as the text ``null``; rows that share the boundary hash (repeated
ids) are taken in part, each by the same fraction; a row of size 0 takes 0; an
empty table gives no rows.  Sources are metadata: their totals, one row each,
are collected to compute the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Numbered, pick, shared_table

LEVELS, BITS = 6, 10
#: A table with a row of numbers per source is broadcast up to this many sources, else joined by shuffle.
BROADCAST_ROWS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as decimal text."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(totals: list[tuple[str | None, int]], cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict[str | None, float]:
    """Target of each source: a share by weight of all words, at most ``most`` times its own.

    What sources at their limit leave over is shared by weight among the rest
    until none is above its limit.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: cycle[i % len(cycle)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    fixed: dict[str | None, float] = {}
    while free := [s for s in size if s not in fixed]:
        left = sum(size.values()) - sum(fixed.values())
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * size[s]]
        if not over:
            return fixed | {s: unit * weight[s] for s in free}
        fixed |= {s: float(most * size[s]) for s in over}
    return fixed


def _bucket(level: int) -> Column:
    return F.shiftright("hash", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _sized(table: DataFrame, rows: int) -> DataFrame:
    """A driver-made table of that many rows, marked for broadcast if they are few."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _rows(df: DataFrame) -> DataFrame:
    return pick(df, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash"))


def plan_mix(rows: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """What each source gives: one row of numbers per source, from rows of (source, size, hash).

    ``passes`` whole passes over the source, one more for hashes below ``edge``,
    and ``rest`` of the ``atom`` words that have the hash ``edge`` itself.
    """
    spark = rows.sparkSession
    totals = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    size = dict(totals)
    plan = {}
    for s, want in targets(totals, cycle, most).items():
        passes = min(int(want // size[s]), most) if size[s] else 0
        plan[s] = {"target": float(want), "passes": passes, "rest": int(want - passes * size[s]), "edge": 0, "atom": 1}

    source = T.StructField("source", T.StringType())
    asked = T.StructType([source, *[T.StructField(c, T.LongType()) for c in ("prefix", "rest")]])
    for level in range(LEVELS):
        table = _sized(spark.createDataFrame([(s, p["edge"], p["rest"]) for s, p in plan.items()], asked), len(plan))
        here = F.shiftright("hash", BITS * (LEVELS - level)) if level else F.lit(0).cast("long")
        part = rows.join(table, _same_source(rows, table) & (here == table["prefix"])).select(rows["source"], "size", "rest", _bucket(level).alias("bucket"))
        sums = part.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("n"))
        sums = sums.withColumn("run", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        edge = sums.where((F.col("run") > F.col("rest")) & (F.col("run") - F.col("n") <= F.col("rest")))
        found = {r["source"]: r for r in edge.collect()}
        for s, p in plan.items():
            p["edge"] <<= BITS
            if s in found:
                r = found[s]
                p["edge"] += r["bucket"]
                p["rest"] -= r["run"] - r["n"]
                p["atom"] = r["n"]
            else:
                p["rest"] = 0

    fields = [source, T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]
    fields += [T.StructField(c, T.LongType()) for c in ("passes", "edge", "rest", "atom")]
    table = [(s, size[s], *[p[c] for c in ("target", "passes", "edge", "rest", "atom")]) for s, p in plan.items()]
    return _sized(spark.createDataFrame(table, T.StructType(fields)), len(table))


def taken_words() -> Column:
    """The words that the mix takes of a row, from size, hash and its source's numbers."""
    exact = "decimal(19,0)"  # the product may not fit a long
    share = F.floor(F.col("rest").cast(exact) * F.col("size").cast(exact) / F.col("atom").cast(exact)).cast("long")
    more = F.when(F.col("hash") < F.col("edge"), F.col("size")).when((F.col("hash") == F.col("edge")) & (F.col("rest") > 0), share).otherwise(F.lit(0))
    return (F.col("passes") * F.col("size") + more).cast("long")


def mix_sources(df: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes, repeats counted: whole
    passes over the row, and one more if its hash is below its source's
    threshold.  The row on the threshold is taken in part, so that a source's
    sum is its target, rounded down, for distinct ids.
    """
    rows = shared_table(_rows(df), "mixing")
    table = plan_mix(rows, cycle, most)
    return rows.join(table, _same_source(rows, table)).select(
        "doc_id", rows["source"], "size", "source_size", "target", taken_words().alias("taken")
    )


def repeat_by_mix(df: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of df, each as often as the mix takes it, with df's own columns.

    A row taken in part counts as whole if at least half of it is taken; a row
    of size 0 gives the mix nothing and is kept once.  Words are counted in one
    pass over the texts; the pass that repeats the rows only asks whether there
    is a word, and counts again the few rows that lie on a threshold.
    """
    rows = shared_table(_rows(df), "mixing")
    table = plan_mix(rows, cycle, most).withColumnsRenamed({c: f"_mix_{c}" for c in ("source", "source_size", "target", "passes", "edge", "rest", "atom")})
    own = Numbered(df)
    text = F.col(own.place("text"))
    full = own.df.withColumn("hash", id_hash(F.col(own.place("doc_id"))))
    joined = full.join(table, F.col(own.place("source")).eqNullSafe(F.col("_mix_source"))).withColumnsRenamed({f"_mix_{c}": c for c in ("passes", "edge", "rest", "atom")})
    joined = joined.withColumn("size", F.when((F.col("hash") == F.col("edge")) & (F.col("rest") > 0), word_count(text)).otherwise(F.lit(1)))
    times = F.when(text.rlike(WORD), F.round(taken_words() / F.col("size")).cast("int")).otherwise(F.lit(1))
    copies = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times)))
    return own.restore(copies)
