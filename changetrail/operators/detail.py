"""Details of single events; every function also works over a whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed
from changetrail.functions.binding import explode_positions
from changetrail.functions.params import pretty_rows, sorted_attributes
from changetrail.functions.requests import time_text


def event_header(named: DataFrame) -> DataFrame:
    """Head of a detail view; the user of a command run is its OS user."""
    is_cli = F.col("action") == fixed.ACTION_CLI
    return named.select(
        "id", "page",
        F.when(is_cli, F.col("user_agent")).otherwise(F.col("username")).alias("user_name"),
        "ip_address",
        time_text(F.col("event_time")).alias("event_time"),
        "action")


def cli_detail(log: DataFrame) -> DataFrame:
    """Command runs with their command text."""
    return log.filter(F.col("action") == fixed.ACTION_CLI).select(
        "id", "page", F.col("user_agent").alias("user_name"), "ip_address",
        time_text(F.col("event_time")).alias("event_time"),
        "action", F.col("post").alias("script"))


def event_attributes(log: DataFrame, numeric_keys: bool = True) -> DataFrame:
    """One row per parameter of each web event, numbered in key order within the event."""
    web = log.filter(F.coalesce(F.col("action") != fixed.ACTION_CLI, F.lit(True)))
    attributes = web.select(
        "id", sorted_attributes(F.col("post"), numeric_keys).alias("attributes"))
    wide = F.size("attributes") > fixed.WIDE_DETAIL_ABOVE
    rows = explode_positions(attributes, ["id", wide.alias("wide")], F.col("attributes"), "item")
    return rows.select("id", (F.col("position") + 1).alias("position"), "item.attribute",
                       "item.value", "wide")


def event_objects(log: DataFrame, pretty: bool = False) -> DataFrame:
    """One row per selected item: its looked-up rows as JSON, compact or one field per line."""
    objects = explode_positions(log, ["id"], F.from_json("object_data", "array<string>"), "record")
    return objects.withColumn("record", pretty_rows(F.col("record"))) if pretty else objects
