"""From raw web requests and command runs to rows of the log."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed
from changetrail.functions import params as P
from changetrail.functions import requests as R
from changetrail.operators.enrich import snapshot_objects
from changetrail.schemas import LOG_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.readers import with_request_fields


def _is_admitted() -> Column:
    return R.is_admitted(F.col("script_name"), F.col("req_action"), F.col("mode_arg"),
                         F.col("has_post"), F.col("purge_continue"))


def _is_by_a_person() -> Column:
    return R.is_foreground_command(F.get("argv", F.lit(0)))


def with_preset_action(requests: DataFrame) -> DataFrame:
    """Add the action that the rule gives which admits a request.

    A ``preset_action`` column of the source (set by the page itself) stands in where none does.
    """
    preset = R.preset_action(F.col("script_name"), F.col("mode_arg"), F.col("has_post"))
    if "preset_action" in requests.columns:
        preset = F.coalesce(preset, F.col("preset_action"))
    return requests.withColumn("preset_action", preset)


def admit_requests(requests: DataFrame, enabled: bool = True) -> DataFrame:
    """Keep requests that can change state; add the ``preset_action`` admission gives them."""
    if not enabled:
        requests = requests.filter(F.lit(False))
    return with_preset_action(requests.filter(_is_admitted()))


def classify_actions(admitted: DataFrame) -> DataFrame:
    """Add ``action`` to admitted requests."""
    return admitted.withColumn("action", R.classify_action(
        R.page_name(F.col("script_name")), F.col("drp_action"), F.col("has_items"),
        F.col("preset_action"), F.col("req_action")))


NO_ITEMS = "array<bigint>"


def _time(source: DataFrame) -> Column:
    return R.whole_seconds(F.col("event_time") if "event_time" in source.columns else R.utc_now())


def _request_row(source: DataFrame) -> list[Column]:
    """Columns of a web event, of a source that has its ``action``."""
    none = F.array().cast(NO_ITEMS)
    return [
        F.col("req_id").cast("long").alias("id"),
        R.page_name(F.col("script_name")).alias("page"),
        F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"),
        F.col("action"),
        R.client_ip(F.col("xff"), F.col("http_xff"), F.col("remote_addr")).alias("ip_address"),
        F.col("user_agent"),
        _time(source).alias("event_time"),
        P.encode_params(P.redact(P.parse_params(F.col("params")))).alias("post"),
        F.when(F.col("has_items"), F.coalesce("selected_items", none)).otherwise(none).alias("items")]


def _command_row(source: DataFrame, id_column: str) -> list[Column]:
    """Columns of a command event. The command text is not redacted."""
    return [
        F.col(id_column).cast("long").alias("id"),
        R.page_name(F.get("argv", F.lit(0))).alias("page"),
        F.lit(0).cast("long").alias("user_id"),
        F.lit(fixed.ACTION_CLI).alias("action"),
        F.col("host_ip").alias("ip_address"),
        F.col("os_user").alias("user_agent"),
        _time(source).alias("event_time"),
        F.array_join("argv", " ", "").alias("post")]


def normalise_requests(admitted: DataFrame) -> DataFrame:
    """Admitted requests as log rows, still carrying their ``items`` for the snapshot."""
    return classify_actions(admitted).select(*_request_row(admitted))


def admit_commands(commands: DataFrame) -> DataFrame:
    """Keep commands a person ran. The setting for web requests does not apply to them."""
    return commands.filter(_is_by_a_person())


def normalise_commands(commands: DataFrame) -> DataFrame:
    """Command runs as log rows. They have no snapshot."""
    return commands.select(*_command_row(commands, "event_id"),
                           F.lit(None).cast("string").alias("object_data"))


def split_routes(raw: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split events that may carry both a request and an ``argv`` into web and command events.

    A command is considered only where the request part was not admitted.
    """
    admitted = F.lit(enabled) & _is_admitted()
    return raw.filter(admitted), raw.filter(~admitted & F.col("argv").isNotNull())


def routed_rows(raw: DataFrame, enabled: bool = True, marks: Collection[str] = ()) -> DataFrame:
    """Raw records (``RAW_SCHEMA``) as log rows of both kinds, with ``items`` and ``is_web``.

    One pass: each record takes the web route if its request is admitted, else the command route if
    it has an ``argv`` that a person ran, else none. Works on streams too. Records with a value in one of
    the columns ``marks`` stay, whatever their route, and so do these columns.
    """
    fields = classify_actions(with_preset_action(with_request_fields(raw)))
    admitted = F.coalesce(F.lit(enabled) & _is_admitted(), F.lit(False))
    is_web, none = F.col("is_web"), F.array().cast(NO_ITEMS).alias("items")
    by_command = F.col("argv").isNotNull() & _is_by_a_person()
    marked = [F.col(name).isNotNull() for name in marks]
    taken = fields.withColumn("is_web", admitted).filter(reduce(or_, marked, is_web | by_command))
    names = [*LOG_SCHEMA.fieldNames()[:-1], "items"]
    # Column by column, not as one struct per route: a filter of one column then repeats no other.
    both = zip(names, _request_row(fields), [*_command_row(fields, "req_id"), none], strict=True)
    rows = {name: F.when(is_web, web).otherwise(command) for name, web, command in both}
    rows["id"] = F.when(is_web, unique_id(F.col("req_id").cast("long"), 0)).otherwise(
        unique_id(F.col("req_id").cast("long"), 1))
    return taken.select(*[column.alias(name) for name, column in rows.items()], "is_web", *marks)


def with_snapshots(rows: DataFrame, tables: Mapping[str, DataFrame],
                   lookups: Mapping[str, tuple] = fixed.ENTITY_LOOKUPS) -> DataFrame:
    """Routed rows as the log has them, with the object snapshots of the web ones."""
    snapshots = snapshot_objects(rows, tables, lookups, id_column="id")
    return (snapshots.withColumn("object_data", F.when(F.col("is_web"), F.col("object_data")))
            .select(*LOG_SCHEMA.fieldNames()))


def routed_events(raw: DataFrame, tables: Mapping[str, DataFrame], settings: Settings = Settings(),
                  lookups: Mapping[str, tuple] = fixed.ENTITY_LOOKUPS) -> DataFrame:
    """Log rows of raw records of both kinds, with the object snapshots of the web ones."""
    return with_snapshots(routed_rows(raw, settings.enabled), tables, lookups)


def unique_id(source_id: Column, source: int) -> Column:
    """Id of an event in the log: the two sources number their events apart from one another,
    so the log keeps even numbers for web requests (0) and odd ones for command runs (1)."""
    return source_id * 2 + source


def web_events(requests: DataFrame, tables: Mapping[str, DataFrame],
               settings: Settings = Settings(), lookups: Mapping[str, tuple] = fixed.ENTITY_LOOKUPS,
               ) -> DataFrame:
    """Log rows of the admitted web requests, with object snapshots.

    Parameters that steer admission are taken out of ``params`` unless the source has them as columns.
    """
    rows = normalise_requests(admit_requests(with_request_fields(requests), settings.enabled))
    return (snapshot_objects(rows, tables, lookups, id_column="id")
            .withColumn("id", unique_id(F.col("id"), 0)).select(*LOG_SCHEMA.fieldNames()))


def command_events(commands: DataFrame) -> DataFrame:
    """Log rows of the commands people ran."""
    rows = normalise_commands(admit_commands(commands))
    return rows.withColumn("id", unique_id(F.col("id"), 1)).select(*LOG_SCHEMA.fieldNames())


def log_events(requests: DataFrame, commands: DataFrame, tables: Mapping[str, DataFrame],
               settings: Settings = Settings()) -> DataFrame:
    """Log rows of both sources."""
    return web_events(requests, tables, settings).unionByName(command_events(commands))
