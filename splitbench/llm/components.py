"""Connected components by alternating large and small stars, for edges of any number.

Each round is joins and aggregates over the edge table; nothing is collected but
two numbers that tell whether a round changed anything.  A node with very many
neighbours is a hot key of a join against one row, which Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, shared_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _unsent(table: DataFrame, many: bool) -> DataFrame:
    """table, joined by shuffle if the edges are many: the planner knows their compressed size only, and may broadcast a side that is far larger."""
    return table.hint("merge") if many else table


def _large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Link each node's larger neighbours to the smallest node around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(_unsent(least, many), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_unsent(least, many), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], int(r["s"] or 0)


#: A round's edges are written in files of so many rows.
EDGES_A_FILE = 500_000


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b); label is its component's smallest node."""
    edges = shared_table(edges.distinct(), "edges")
    before = _mark(edges)
    for _ in range(rounds if before[0] else 0):
        # A round makes no more edges than twice the last one's.
        many = before[0] > FEW_ROWS
        edges = shared_table(_small_star(_large_star(edges, many), many).distinct().coalesce(1 + 2 * before[0] // EDGES_A_FILE), "edges", as_is=True)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
