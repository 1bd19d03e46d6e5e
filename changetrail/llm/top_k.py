"""Exact top-k search by inner product: ball-tree branch and bound in every shard.

The components become integers, floor(``SCALE`` * x). Vectors are dealt out to shards of about
``SHARD_ROWS`` rows by hash, queries to blocks of about ``BLOCK_ROWS``, and a task searches the ball
tree of one shard for one block. For a query, nodes are visited in the order of the greatest inner
product that their ball allows, and the search ends when that is below the k-th score so far. All
shards start from a shared k-th score: that among ``SEED_ROWS`` rows, chosen by hash, which every
query meets first. So most shards prune from their first node; no bound ever drops a result.

Results: vectors that are null, or hold null or non-finite components, and rows without an id, take
no part; a query meets vectors of its own length only, and no row of its own id; of query rows with
one id the least vector counts; equal scores go to the smaller id; fewer candidates give fewer
rows; scores beyond 64 bits are cut to that range; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from changetrail.llm.shipping import ship_code
from changetrail.llm.storage import written

SCALE = 1024
K = 10
SHARD_ROWS = 8192
LEAST_SHARD_ROWS = 512
BLOCK_ROWS = 1024
SEED_ROWS = 2048
LEAF_ROWS = 64
EXACT = 2.0**53


def integers(vector: Column) -> Column:
    """The components as whole numbers; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.lit(float(SCALE)) * x.cast("double"))
    # A whole double is its own floor, also where it is beyond 64 bits.
    return F.when(~bad, F.transform(whole, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double"))
                                    .otherwise(x)))


class BallTree:
    """Nodes of balls over rows of a matrix; children and rows are numbered."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.centers, self.radii, self.content = rows, [], [], []
        self._add(np.arange(len(rows)))
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)

    def _add(self, members: np.ndarray) -> int:
        number, own = len(self.radii), self.rows[members]
        center = own.mean(axis=0)
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        self.centers.append(center)
        self.radii.append(away.max())
        self.content.append(members)
        if len(members) > LEAF_ROWS and away.max() > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            order = np.argsort(own @ (other - one), kind="stable")
            half = len(members) // 2
            self.content[number] = (self._add(members[order[:half]]), self._add(members[order[half:]]))
        return number


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as 64-bit numbers."""
    most = np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * rows.shape[1]
    if most < EXACT:
        return (rows @ query).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    own = [int(x) for x in query]
    sums = (sum(x * y for x, y in zip(row, own)) for row in whole)
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], dtype=np.int64)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
           floors: list[int | None], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its row, and ids and scores of its best candidates in the tree."""
    lengths = np.sqrt((queries**2).sum(axis=1))
    bounds = queries @ tree.centers.T + lengths[:, None] * tree.radii
    # Room for the rounding of the bounds.
    reach = np.sqrt((tree.centers**2).sum(axis=1)) + tree.radii
    bounds += 1e-9 * lengths[:, None] * reach + 1e-6
    out = []
    for row, (query, own, floor) in enumerate(zip(queries, query_ids, floors)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = float("-inf") if floor is None else floor
        heap = [(-bounds[row, 0], 0)]
        while heap and -heap[0][0] >= least:
            node = tree.content[heapq.heappop(heap)[1]]
            if isinstance(node, tuple):
                for child in node:
                    heapq.heappush(heap, (-bounds[row, child], child))
                continue
            scores = products(tree.rows[node], query)
            keep = (scores >= least) & (ids[node] != own)
            best_ids = np.concatenate([best_ids, ids[node][keep]])
            best = np.concatenate([best, scores[keep]])
            if len(best) >= k:
                order = np.lexsort((best_ids, ~best))[:k]  # ~x orders as -x and can't overflow
                best_ids, best = best_ids[order], best[order]
                least = max(least, int(best[-1]))
        out.append((row, best_ids, best))
    return out


def bucket(seed: int, n: int) -> Column:
    """A number below ``n`` by hash of the id. Of the type of the numbers in a sequence: the two sides
    of a cogroup meet by the hash of their keys, and equal numbers of other types hash differently."""
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    values = values if isinstance(values, pa.ListArray) else pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def nearest_by_product(vectors: DataFrame, is_query: Column, k: int = K, key: str = "vec_id",
                       vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every query row."""
    spark = vectors.sparkSession
    ship_code(spark)
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        integers(F.col(vector)).alias("v")).where("v is not null and size(v) > 0")
    rows = written(rows.withColumn("dim", F.size("v")), "vectors")
    total, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    least = -(-total // LEAST_SHARD_ROWS)
    shards = max(1, -(-total // SHARD_ROWS), min(least, spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-asked // BLOCK_ROWS))
    placed = rows.withColumn("shard", bucket(1, shards))
    queries = (rows.where("is_query").groupBy("id", "dim").agg(F.min("v").alias("v"))
               .groupBy("id").agg(F.min_by(F.struct("dim", "v"), "dim").alias("q"))
               .select("id", "q.*").withColumn("block", bucket(2, blocks)))
    queries = written(queries, "queries")

    def find(known: pa.Table, asking: pa.Table, floors: list[int | None]) -> pa.Table:
        if not known.num_rows or not asking.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        ids, query_ids = known["id"].to_numpy(), asking["id"].to_numpy()
        found = search(BallTree(matrix(known["v"])), ids, matrix(asking["v"]), query_ids, floors, k)
        return pa.table({"query_id": np.repeat(query_ids, [len(x[1]) for x in found]),
                         "id": np.concatenate([x[1] for x in found]),
                         "score": np.concatenate([x[2] for x in found])})

    schema = "query_id long, id long, score long"
    # The shared k-th score: that among the seeds, at most SEED_ROWS rows.
    seeds = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SEED_ROWS).select("id", "v", "dim")
    seeds = written(seeds, "seeds").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    started = (seeds.groupBy("block", "dim").cogroup(queries.groupBy("block", "dim")).applyInArrow(
        lambda x, y: find(x, y, [None] * y.num_rows), schema))
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kth = (started.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") == k)
           .select(F.col("query_id").alias("id"), F.col("score").alias("floor")))
    asked_rows = written(queries.join(kth, "id", "left"), "asked")
    spread = asked_rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["shard", "block", "dim"]
    found = dealt.select(*keys, "id", "v").groupBy(*keys).cogroup(
        spread.select(*keys, "id", "v", "floor").groupBy(*keys)).applyInArrow(
        lambda x, y: find(x, y, y["floor"].to_pylist()), schema)
    return (found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))
