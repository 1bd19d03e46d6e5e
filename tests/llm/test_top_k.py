import random

import pytest
from pyspark.sql import functions as F

from changetrail.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=10):
    import math

    known = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in known:
        if q % 100:
            continue
        cut = lambda s: min(max(s, -2**63), 2**63 - 1)
        scored = sorted(((-cut(sum(a * b for a, b in zip(own, v))), i)
                         for i, v in known if i != q and len(v) == len(own)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def float32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(n, dim=8, ties=False):
    rnd = random.Random(n)
    pick = (lambda: rnd.choice([-1.0, 0.0, 0.5])) if ties else (lambda: float32(rnd.gauss(0, 1)))
    return [(i, [pick() for _ in range(dim)], 0, "") for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1500), vectors(900, 3, ties=True), vectors(7), vectors(1)])
def test_equal_to_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    found = top_k.nearest_by_product(frame, F.col("vec_id") % 100 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(300, 4) + [
        (1000, None, 0, ""), (1100, [], 0, ""), (1200, [1.0, None, 2.0, 3.0], 0, ""),
        (1300, [float("nan"), 1.0, 1.0, 1.0], 0, ""), (1301, [float("inf"), 1.0, 1.0, 1.0], 0, ""),
        (1400, [1.0, 2.0], 0, ""), (1401, [2.0, 2.0], 0, ""), (None, [1.0] * 4, 0, ""),
        (1500, [float32(3e12)] * 4, 0, "")]
    found = top_k.nearest_by_product(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_many_shards_and_blocks(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 4), ("SEED_ROWS", 20), ("LEAF_ROWS", 5)):
        monkeypatch.setattr(top_k, name, value)
    rows = vectors(1200, 5)
    found = top_k.nearest_by_product(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_groups_meet_in_every_partition(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("BLOCK_ROWS", 4), ("SEED_ROWS", 20)):
        monkeypatch.setattr(top_k, name, value)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = vectors(1200, 5)
        found = top_k.nearest_by_product(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, found.collect())) == brute(rows)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_empty_table(spark):
    assert top_k.nearest_by_product(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
