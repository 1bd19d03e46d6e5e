"""Continuous ingestion: each micro-batch goes to the log and, if wanted, to the JSON feed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from changetrail import fixed_values as fixed
from changetrail.operators.enrich import with_username
from changetrail.operators.ingest import command_events, routed_rows, web_events, with_snapshots
from changetrail.operators.search import display_view
from changetrail.settings import Settings
from changetrail.sources.log_table import LogTable, append_json_log
from changetrail.sources.readers import BROKEN, split_broken

Tables = Mapping[str, DataFrame]


def batch_label(batch: DataFrame, name: str, batch_id: int) -> str:
    """Name of a micro-batch: the same when it is replayed, another under a new checkpoint.

    Spark keeps the id of a query in its checkpoint. Batch numbers alone start again with a new
    one, and would replace older batches.
    """
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{name}-{query or 'batch'}-{batch_id:09d}"


def web_batch_writer(log: LogTable, tables: Callable[[], Tables], settings: Settings,
                     name: str) -> Callable[[DataFrame, int], None]:
    """Writer of one micro-batch of requests.

    Entity tables are opened per batch, so a snapshot shows objects as they are when the request
    arrives, before a deletion takes effect. Both sinks are keyed by the batch number: a batch
    replayed after a failure replaces what it wrote before.
    """
    def write(requests: DataFrame, batch_id: int) -> None:
        batch = batch_label(requests, name, batch_id)
        events = web_events(requests, tables(), settings)
        if not settings.json_log_enabled:
            log.append(events, batch)
            return
        events = events.persist()          # two sinks, one computation
        try:
            log.append(events, batch)
            append_json_log(events, settings, batch)
        finally:
            events.unpersist()
    return write


def routed_batch_writer(log: LogTable, tables: Callable[[], Tables], settings: Settings,
                        name: str) -> Callable[[DataFrame, int], None]:
    """Writer of one micro-batch of raw records of both kinds.

    Both routes are one append under one batch label, so a replay replaces both at once. Lines that
    could not be read are put aside under the same label. The JSON feed gets web events only.
    """
    def write(raw: DataFrame, batch_id: int) -> None:
        batch = batch_label(raw, name, batch_id)
        marks = [BROKEN] if BROKEN in raw.columns else []
        # Snapshots read their events more than once: read and parsed once, with the lines put aside.
        rows = routed_rows(raw, settings.enabled, marks).persist()
        try:
            records = rows
            if marks:
                records, broken = split_broken(rows)
                log.quarantine(broken, batch)
            events = with_snapshots(records, tables())
            log.append(events, batch)
            if settings.json_log_enabled:
                append_json_log(events.filter(F.col("action") != fixed.ACTION_CLI), settings, batch)
        finally:
            rows.unpersist()
    return write


def command_batch_writer(log: LogTable, name: str) -> Callable[[DataFrame, int], None]:
    def write(commands: DataFrame, batch_id: int) -> None:
        log.append(command_events(commands), batch_label(commands, name, batch_id))
    return write


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
           trigger: Mapping) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def ingest_requests(stream: DataFrame, log: LogTable, tables: Callable[[], Tables],
                    checkpoint: str, settings: Settings = Settings(), name: str = "web",
                    trigger: Mapping = {"processingTime": "5 minutes"}) -> StreamingQuery:
    """Start ingesting a stream of web requests."""
    return _start(stream, web_batch_writer(log, tables, settings, name), checkpoint, trigger)


def ingest_commands(stream: DataFrame, log: LogTable, checkpoint: str, name: str = "cli",
                    trigger: Mapping = {"processingTime": "5 minutes"}) -> StreamingQuery:
    """Start ingesting a stream of command runs. They have no JSON feed and no snapshot."""
    return _start(stream, command_batch_writer(log, name), checkpoint, trigger)


def ingest_routed(stream: DataFrame, log: LogTable, tables: Callable[[], Tables], checkpoint: str,
                  settings: Settings = Settings(), name: str = "raw",
                  trigger: Mapping = {"processingTime": "5 minutes"}) -> StreamingQuery:
    """Start ingesting one stream of raw records (``RAW_SCHEMA``), web requests and command runs.

    With the column of broken lines that ``read_json_lines`` adds, these lines are put aside.
    """
    return _start(stream, routed_batch_writer(log, tables, settings, name), checkpoint, trigger)


def live_view(stream: DataFrame, users: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """A stream of raw records as readers see the events: a stream-static left join with user names."""
    if BROKEN in stream.columns:
        stream, _ = split_broken(stream)
    rows = routed_rows(stream, settings.enabled).drop("items", "is_web")
    return display_view(with_username(rows, users))
