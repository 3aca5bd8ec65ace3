"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TASK_ROWS, join_hot, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    edges has two columns of one orderable type. Alternates the large-star and small-star
    steps (Kiveris et al., 2014): each is a minimum per node that goes to the node's neighbours. Up to task_rows edges it is a window over the node, as even a hub's edges are few enough for
    a task; beyond, an aggregate (a hub costs one row per task) that is joined back to the edges (join_hot: a hub's edges stay spread over tasks). Each
    round is written to the shared folder. Loops, repeated edges and edges with a null end
    change nothing; no edge gives no row.
    """
    a, b = edges.columns
    count = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    at = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    at = materialise(at)
    seen = count(at)
    for _ in range(max_rounds):
        step = _spread_round(at, seen[0]) if 2 * seen[0] > task_rows else _window_round(at)
        at = materialise(step.where("u <> v").distinct())
        now = count(at)
        if now == seen:
            roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _spread_round(at: DataFrame, total: int) -> DataFrame:
    both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    large = join_hot(both, 2 * total, low, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    small = join_hot(large, total, low, "u", "n")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def _window_round(at: DataFrame) -> DataFrame:
    near = Window.partitionBy("u")
    both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = both.withColumn("m", F.least(F.min("v").over(near), "u")).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = large.withColumn("m", F.min("v").over(near))
    return small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
