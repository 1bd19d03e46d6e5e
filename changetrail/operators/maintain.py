"""Retention, schema upkeep and the JSON-lines feed."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail import fixed_values as fixed
from changetrail.functions.requests import time_text
from changetrail.schemas import LOG_SCHEMA


def retention_cutoff(now: datetime, retention_days: int) -> datetime | None:
    """Events before this moment are due; ``None`` keeps everything."""
    if retention_days <= 0:
        return None
    return now.replace(microsecond=0) - timedelta(seconds=retention_days * fixed.SECONDS_PER_DAY)


def _limit(log: DataFrame, cutoff: datetime) -> Column:
    # The literal takes the column's type, not the other way round, so it reaches the scan.
    return F.lit(cutoff.isoformat(sep=" ")).cast(log.schema["event_time"].dataType)


def is_due(log: DataFrame, cutoff: datetime) -> Column:
    """Whether an event is older than the cutoff; NULL for an event without a time."""
    due = F.col("event_time") < _limit(log, cutoff)
    if "event_date" in log.columns:
        due = due & (F.col("event_date") <= F.lit(cutoff.date()))
    return due


def keep_since(log: DataFrame, cutoff: datetime) -> DataFrame:
    """Events from the cutoff on, and those without a time.

    On a log split by day both branches say so of the day too, so whole days are pruned.
    """
    kept, timeless = F.col("event_time") >= _limit(log, cutoff), F.col("event_time").isNull()
    if "event_date" in log.columns:
        kept = kept & (F.col("event_date") >= F.lit(cutoff.date()))
        timeless = timeless & F.col("event_date").isNull()
    return log.filter(kept | timeless)


def expire_events(log: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """The log without events older than the retention; an event without a time stays."""
    cutoff = retention_cutoff(now, retention_days)
    return log if cutoff is None else keep_since(log, cutoff)


def purged_count(log: DataFrame, now: datetime, retention_days: int) -> DataFrame:
    """How many events the retention removes."""
    cutoff = retention_cutoff(now, retention_days)
    due = F.lit(False) if cutoff is None else is_due(log, cutoff)
    return log.filter(due).agg(F.count(F.lit(1)).alias("purged"))


def evolve_schema(log: DataFrame, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """An older log in the current shape: missing columns come as NULL."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in log.columns}
    return log.withColumns(missing).select(*schema.fieldNames())


def overlong_values(log: DataFrame) -> DataFrame:
    """Values per column that exceed the column's declared width. They are kept whole."""
    return log.agg(*[
        F.count_if(F.char_length(name) > width).alias(f"{name}_over_{width}")
        for name, width in fixed.COLUMN_WIDTHS.items()])


def json_log_lines(events: DataFrame) -> DataFrame:
    """One JSON object per web event. ``post`` and ``object_data`` are JSON text inside it."""
    fields = [time_text(F.col(name)).alias(name) if name == "event_time" else F.col(name)
              for name in fixed.JSON_LOG_FIELDS]
    return events.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
