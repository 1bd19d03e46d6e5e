"""Connected components of an edge table by repeated contraction; nothing leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail.llm.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the least id reachable.

    Each round every node joins the neighbour (or itself) of least priority and edges are redrawn
    between the nodes so joined, until none is left. The priority is the id in even rounds, which
    ends stars at once, and a hash in odd ones, which shrinks chains by a constant factor, so the
    rounds grow with the logarithm of the nodes. Minima only: no adjacency list is ever gathered.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(both.where("a <> b").distinct(), "edges")
    found = None
    turn = 0
    while not left.isEmpty():
        priority = F.xxhash64("b", F.lit(turn)) if turn % 2 else F.col("b")
        nearest = left.groupBy("a").agg(F.min(F.struct(priority.alias("p"), "b")).alias("n"))
        own = F.xxhash64("a", F.lit(turn)) if turn % 2 else F.col("a")
        nearer = F.col("n.p") < own
        joined = written(nearest.select(F.col("a").alias("id"),
                                        F.when(nearer, F.col("n.b")).otherwise(F.col("a"))
                                        .alias("root")), "joined")
        step = joined.select(F.col("id").alias("root"), F.col("root").alias("next"))
        found = joined if found is None else written(
            found.join(step, "root", "left")
            .select("id", F.coalesce("next", "root").alias("root")), "roots")
        roots = joined.withColumnRenamed("root", "r")
        left = written(
            left.join(roots.withColumnRenamed("id", "a"), "a")
            .select(F.col("r").alias("x"), "b")
            .join(roots.withColumnRenamed("id", "b"), "b")
            .select(F.col("x").alias("a"), F.col("r").alias("b"))
            .where("a <> b").distinct(), "edges")
        turn += 1
    if found is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return written(found.join(least, "root").select("id", "component"), "components")
