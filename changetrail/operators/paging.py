"""Sorted pages of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changetrail.operators.checkpoints import ensure_checkpoint_dir

# Up to here Spark's top-k keeps offset + rows rows per task and merges them in one.
SHALLOW_ROWS = 100_000


def sort_order(column: str, descending: bool, id_column: str = "id") -> list[Column]:
    """Sort column with the id as tie-break in the same direction; NULLs rank lowest."""
    names = [column] if column == id_column else [column, id_column]
    return [F.col(name).desc() if descending else F.col(name).asc() for name in names]


def page_offset(page_no: int, rows: int) -> int:
    if page_no < 1 or rows < 1:
        raise ValueError("page_no and rows start at 1")
    return rows * (page_no - 1)


def slice_sorted(df: DataFrame, column: str, descending: bool, offset: int, rows: int,
                 id_column: str = "id", shallow_rows: int = SHALLOW_ROWS) -> DataFrame:
    """Rows ``offset .. offset + rows`` of ``df`` in order.

    Near the start this is a top-k. Deep slices would pull the whole prefix into one task, so
    there the sort keys alone are range-partitioned and ranked, and the slice is fetched by id.
    """
    order = sort_order(column, descending, id_column)
    if offset + rows <= shallow_rows:
        # Not offset(): Spark 4.1 takes an offset it has not run yet for an empty input when it
        # re-plans, and then drops a later sort. The window is over at most shallow_rows rows.
        top = df.orderBy(*order).limit(offset + rows)
        if offset == 0:
            return top
        place = F.row_number().over(Window.orderBy(*order))
        return (top.withColumn("_place", place).filter(F.col("_place") > offset)
                .orderBy("_place").drop("_place"))
    ranks = rank_keys(df, column, descending, id_column)
    # Not by id alone: an id that another value of the sort column has too is another row.
    wanted = (ranks.filter(F.col("rank").between(offset, offset + rows - 1))
              .select(F.col(id_column).alias("_id"), F.col(column).alias("_value"), "rank"))
    if rows <= shallow_rows:
        wanted = F.broadcast(wanted)
    same = F.col(id_column).eqNullSafe(F.col("_id")) & F.col(column).eqNullSafe(F.col("_value"))
    return df.join(wanted, same).orderBy("rank").select(*df.columns)


def rank_keys(df: DataFrame, column: str, descending: bool, id_column: str = "id") -> DataFrame:
    """``(sort column, id, rank)`` with zero-based global ranks.

    The id is part of the range key, so one sort value held by very many rows is split like any
    other range. The sorted keys are checkpointed: ranks build on partition numbers, which must
    not change if an executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = sort_order(column, descending, id_column)
    row_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = (df.select(*dict.fromkeys([column, id_column]))
            .repartitionByRange(partitions, *order)
            .sortWithinPartitions(*order)
            .withColumns({"part": F.spark_partition_id(), "row": row_in_partition})
            .checkpoint())
    # One row per partition, so the unpartitioned window is over a fixed, small number of rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keys.groupBy("part").count()
              .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    return (keys.join(F.broadcast(starts), "part")
            .withColumn("rank", F.col("start") + F.col("row"))
            .drop("part", "row", "start"))
