"""User names and snapshots of the objects an event touches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail import fixed_values as fixed
from changetrail.functions.binding import explode_positions
from changetrail.functions.requests import time_text
from changetrail.operators.lookups import BROADCAST_LIMIT_BYTES, join_dimension

EMPTY_LIST = "[]"


def with_username(log: DataFrame, users: DataFrame, id_column: str = "id",
                  broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Add ``username``; an event of an unknown user stays, with NULL."""
    names = users.select(F.col("id").alias("user_id"), "username")
    joined = join_dimension(log, names, ["user_id"], spread_by=id_column,
                            broadcast_limit=broadcast_limit)
    return joined.select(*log.columns, "username")


def device_flag_columns() -> dict[str, Column]:
    """Readable state flags of a discovered device; NULL counts as off."""
    return {"snmp": F.when(F.col("snmp") == 1, "UP").otherwise("Down"),
            "up": F.when(F.col("up") == 1, "Yes").otherwise("No")}


def decode_device_flags(devices: DataFrame) -> DataFrame:
    return devices.withColumns(device_flag_columns())


def _json_list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _as_stored(source: DataFrame, name: str) -> Column:
    """A column as the log stores it: times as ``yyyy-MM-dd HH:mm:ss``, in UTC if they have a zone."""
    kind, column = source.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        column = F.convert_timezone(F.current_timezone(), F.lit("UTC"), column.cast("timestamp_ntz"))
    elif not isinstance(kind, T.TimestampNTZType):
        return column
    return time_text(column)


def entity_rows(tables: Mapping[str, DataFrame],
                lookups: Mapping[str, tuple] = fixed.ENTITY_LOOKUPS) -> DataFrame:
    """All dimensions as one table ``(page, item, rows)``, ``rows`` being a JSON list.

    The row text is made before the union, so pages with different columns fit together and
    one join serves them all. A key that may repeat is aggregated here, on the dimension side,
    so that the join never multiplies events.
    """
    parts = []
    for page, (table, key, columns, unique) in lookups.items():
        if table not in tables:
            continue
        source = tables[table]
        if page == fixed.DEVICE_PAGE:
            source = decode_device_flags(source)
        row = F.to_json(F.struct(*[_as_stored(source, name).alias(field) for name, field in columns]),
                        {"ignoreNullFields": "false"})
        keyed = source.select(F.col(key).cast("long").alias("item"), row.alias("row"))
        if unique:
            rows = keyed.select("item", _json_list(F.array("row")).alias("rows"))
        else:
            rows = keyed.groupBy("item").agg(
                _json_list(F.sort_array(F.collect_list("row"))).alias("rows"))
        parts.append(rows.select(F.lit(page).alias("page"), "item", "rows"))
    if not parts:
        raise ValueError("no entity table given for any known page")
    return reduce(DataFrame.unionByName, parts)


def snapshot_objects(events: DataFrame, tables: Mapping[str, DataFrame],
                     lookups: Mapping[str, tuple] = fixed.ENTITY_LOOKUPS,
                     id_column: str = "event_id", items_column: str = "items",
                     broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Add ``object_data``: per selected item, in order, the list of its rows as JSON.

    A missing entity leaves an empty inner list; no items or an unknown page give ``[]``. An
    event of a page whose table is not in ``tables`` is an error.

    Events without anything to look up (most of them) do not move. Of the others each item goes
    through the lookup join as ``(id, position, page, item)``, and the first one carries the event
    along; one shuffle by id puts events and their documents together. The group of one event is no
    larger than its own item list, which is one row of the input already. Ids must be unique.
    """
    has_lookup = F.coalesce(
        (F.size(items_column) > 0) & F.col("page").isin(*lookups), F.lit(False))
    plain = events.filter(~has_lookup).withColumn("object_data", F.lit(EMPTY_LIST))
    wanted = explode_positions(
        events.filter(has_lookup),
        [F.col(id_column).alias("_id"), "page", F.struct(*events.columns).alias("_event")],
        F.col(items_column), "item")
    wanted = wanted.withColumn("_event", F.when(F.col("position") == 0, F.col("_event")))
    unread = [page for page, (table, *_) in lookups.items() if table not in tables]
    if unread:
        # A table that is not there must not look like entities that are not there.
        message = F.concat(F.lit("no entity table given for page "), F.col("page"))
        wanted = wanted.withColumn("item", F.when(F.col("page").isin(*unread), F.raise_error(message)
                                                  .cast("long")).otherwise(F.col("item")))
    found = join_dimension(wanted, entity_rows(tables, lookups), ["page", "item"],
                           spread_by="_id", broadcast_limit=broadcast_limit)
    slot = F.struct("position", F.coalesce("rows", F.lit(EMPTY_LIST)).alias("rows"))
    in_order = F.sort_array(F.collect_list(slot))["rows"]
    finished = found.groupBy("_id").agg(F.first("_event", ignorenulls=True).alias("_event"),
                                        _json_list(in_order).alias("object_data"))
    return plain.unionByName(finished.select("_event.*", "object_data"))
