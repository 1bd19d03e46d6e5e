"""Export of matching events, without order or limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed
from changetrail.functions.params import flatten_post
from changetrail.functions.requests import time_text
from changetrail.operators.enrich import with_username
from changetrail.operators.lookups import BROADCAST_LIMIT_BYTES
from changetrail.operators.search import EventFilter

FORMATS = ("csv", "legacy")


def export_events(log: DataFrame, users: DataFrame, where: EventFilter = EventFilter(),
                  broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Matching events with user names and flattened parameters (empty for command text)."""
    needed = ["id", "page", "user_id", "action", "ip_address", "user_agent", "event_time", "post"]
    named = with_username(where.apply(log).select(*needed), users,
                          broadcast_limit=broadcast_limit)
    return named.select(
        "page", "user_id", "username", "action", "ip_address", "user_agent",
        time_text(F.col("event_time")).alias("event_time"),
        F.coalesce(flatten_post(F.col("post")), F.lit("")).alias("post"))


def legacy_lines(exported: DataFrame) -> DataFrame:
    """Unquoted fields joined by a comma and a blank, one ``line`` per event."""
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in exported.columns]
    return exported.select(F.concat_ws(", ", *fields).alias("line"))


def escape_fields(exported: DataFrame) -> DataFrame:
    """Optional: drop double quotes and turn commas into bars, for unquoted output."""
    def clean(name):
        text = F.replace(F.col(name).cast("string"), F.lit('"'), F.lit(""))
        return F.replace(text, F.lit(","), F.lit("|")).alias(name)
    return exported.select(*[clean(name) for name in exported.columns])


def _write_header(exported: DataFrame, path: str) -> None:
    """The header as a part file whose name comes before those of Spark's parts."""
    spark = exported.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-0-header.txt")
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file, False)
    try:
        stream.write(bytearray(f"{fixed.EXPORT_HEADER}\n".encode()))
    finally:
        stream.close()


def write_export(exported: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write an export as a folder of part files, in parallel.

    ``csv`` quotes fields, doubles quotes inside them, and has a header per file. ``legacy`` is plain lines with one header
    in the first part, so the parts in name order are one file; nothing at all if no event.
    """
    if fmt == "csv":
        exported.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')
    elif fmt == "legacy":
        legacy_lines(exported).write.mode("errorifexists").text(path)
        # From what was written: whether there is any event must not take a second run.
        if not exported.sparkSession.read.text(path).isEmpty():
            _write_header(exported, path)
    else:
        raise ValueError(f"export format is one of {FORMATS}, not {fmt!r}")
