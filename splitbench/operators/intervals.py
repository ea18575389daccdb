"""Half-open intervals on linear and circular sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segments(df: DataFrame, start: str = "start", end: str = "end", length: str = "source_length") -> DataFrame:
    """Intervals that run past a circular origin as two; adds segment_start and segment_end."""
    s, e, n = F.col(start), F.col(end), F.col(length)
    part = lambda a, b: F.struct(a.cast("long").alias("segment_start"), b.cast("long").alias("segment_end"))
    parts = F.when(e <= n, F.array(part(s, e))).otherwise(F.array(part(s, n), part(F.lit(0), e - n)))
    return df.withColumn("part", F.explode(parts)).select(*df.columns, "part.*")


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping intervals of a key merged; intervals that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    marked = df.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged"))
    return merged.drop("_island")


def overlapping(test: DataFrame, train: DataFrame, keys: list[str], ident: str, bin_size: int = 4096) -> DataFrame:
    """Distinct ids of test intervals that overlap a train interval of the same keys.

    The axis is cut into bins, so that a key with very many intervals joins bin
    by bin; train intervals are merged first.
    """
    binned = lambda d: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    a = binned(test.where("end > start")).alias("a")
    b = binned(islands(train.where("end > start"), keys)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = (F.col("a._bin") == F.col("b._bin")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    for s in same:
        on = on & s
    return a.join(b, on, "left_semi").select(ident).distinct()
