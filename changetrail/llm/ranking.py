"""Global positions in a sort order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail.llm.storage import written

IN_PARTITION_BITS = 33  # the layout of monotonically_increasing_id: partition, then row


def ranked(frame: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``frame`` with each row's position, from 0, in ``order``; equal rows take any order.

    The rows are dealt out by ranges of the order and sorted there. A row's position is its place
    in its partition plus the rows of earlier partitions; only one count per partition meets.
    """
    dealt = (frame.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("_at", F.monotonically_increasing_id()))
    dealt = written(dealt.select(*frame.columns, F.shiftright("_at", IN_PARTITION_BITS).alias("_part"),
                                 F.col("_at").bitwiseAND(2**IN_PARTITION_BITS - 1).alias("_place")),
                    "ranked")
    counts = (dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).groupBy()
              .agg(F.array_sort(F.collect_list(F.struct("_part", "_rows"))).alias("_all")))
    before = counts.select(F.posexplode("_all").alias("_i", "_own"), "_all").select(
        F.col("_own._part").alias("_part"),
        F.aggregate(F.slice("_all", F.lit(1), F.col("_i")), F.lit(0).cast("long"),
                    lambda total, one: total + one["_rows"]).alias("_before"))
    return (dealt.join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_before") + F.col("_place"))
            .select(*frame.columns, name))
