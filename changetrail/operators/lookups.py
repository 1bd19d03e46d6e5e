"""Left joins to a dimension whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64
# Spark's estimate knows neither compression nor how long JSON text gets: trust it only where the
# limit leaves room for it to be this many times too low.
ESTIMATE_SLACK = 16
SALT_BUCKETS = 32


def measured_bytes(dimension: DataFrame) -> int:
    """Bytes of a dimension in memory, from one pass over exactly the columns to be joined."""
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(name).cast("string"))), F.lit(0))
               for name in dimension.columns]
    size = F.count(F.lit(1)) * ROW_OVERHEAD_BYTES
    for length in lengths:
        size = size + length
    return dimension.agg(size.alias("bytes")).first()["bytes"]


def spark_broadcasts(dimension: DataFrame, limit: int) -> bool:
    """Whether Spark's own statistics put the dimension well within its threshold and ``limit``."""
    plan = dimension._jdf.queryExecution().optimizedPlan()
    conf = dimension.sparkSession._jsparkSession.sessionState().conf()
    planned = int(plan.stats().sizeInBytes())
    return planned <= min(conf.autoBroadcastJoinThreshold(), limit // ESTIMATE_SLACK)


def may_broadcast(spark: SparkSession) -> bool:
    """Whether the session allows broadcasts at all: a negative threshold forbids them."""
    conf = spark._jsparkSession.sessionState().conf()
    return int(conf.autoBroadcastJoinThreshold()) >= 0


def splits_hot_keys(spark: SparkSession) -> bool:
    """Whether Spark itself splits the partition of a hot key, at run time."""
    return all(spark.conf.get(name) == "true" for name in
               ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled"))


def join_dimension(facts: DataFrame, dimension: DataFrame, on: list[str], spread_by: str,
                   broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                   salt_buckets: int | None = None) -> DataFrame:
    """``facts LEFT JOIN dimension``, keeping every fact row.

    A dimension that Spark knows to be small is left to Spark, which broadcasts it. Any other
    is measured: within ``broadcast_limit`` it is broadcast too, so the facts do not move, unless
    the session forbids broadcasts.
    A larger one is joined by shuffle. One key may hold a third of the facts (the user 0 of
    command runs, a much edited host). Spark splits the partition of such a key, on the side of the
    facts, where adaptive execution is on. Where it is off, or with ``salt_buckets`` given, each key is
    spread over the buckets by the hash of ``spread_by``, and the dimension is repeated once per bucket.
    """
    if spark_broadcasts(dimension, broadcast_limit):
        return facts.join(dimension, on, "left")
    if may_broadcast(dimension.sparkSession) and measured_bytes(dimension) <= broadcast_limit:
        return facts.join(F.broadcast(dimension), on, "left")
    if salt_buckets is None and splits_hot_keys(dimension.sparkSession):
        return facts.join(dimension.hint("shuffle_merge"), on, "left")
    salt_buckets = salt_buckets or SALT_BUCKETS
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salt_buckets)).cast("int")
    repeated = dimension.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return (facts.withColumn("_salt", salt)
            .join(repeated.hint("shuffle_merge"), [*on, "_salt"], "left")
            .drop("_salt"))
