"""The log as a Parquet table of the session's catalog, split by day, with retention and purge.

Everything is what Spark does with tables: ``CREATE TABLE``, ``INSERT OVERWRITE`` of the partitions
written, ``ALTER TABLE`` to add columns and drop partitions, ``TRUNCATE TABLE``. Whether the table
outlives the session is up to the session's catalog.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Collection, Iterable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail.functions.requests import utc_now
from changetrail.operators.checkpoints import shared_folder
from changetrail.operators.maintain import is_due, json_log_lines, retention_cutoff
from changetrail.operators.paging import page_offset
from changetrail.operators.search import ALL, EventFilter, count_per_day, in_days, list_events
from changetrail.operators.signatures import FILE, file_signatures, files_with, needle_grams
from changetrail.schemas import LOG_SCHEMA, STORED_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.files import delete_folder, folder_exists, is_complete

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
# A search that must read more files than this is left to a plain scan.
MOST_FILES = 5_000
# How many times more days a page opens if those opened so far do not fill it.
DAYS_GROWTH = 8
# Overwriting replaces the partitions that are written and no others. Ids and users of any time meet
# in a row group's range, as files are sorted by time: Bloom filters tell which row groups hold one.
TABLE_OPTIONS = {
    "partitionOverwriteMode": "dynamic",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.enabled#id": "true",
    "parquet.bloom.filter.enabled#user_id": "true",
}


def _in_partitions(partitions: Iterable[tuple[date | None, str]]) -> Column:
    """Whether an event is in one of these partitions."""
    by_day: dict[date | None, list[str]] = {}
    for day, batch in partitions:
        by_day.setdefault(day, []).append(batch)
    return reduce(or_, [in_days([day]) & F.col("batch").isin(batches) for day, batches in by_day.items()],
                  F.lit(False))


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class LogTable:
    """A log held by the table ``name`` (with its database, if it is not the current one).

    Partitions are ``event_date``, by which searches prune, and ``batch``: a batch written again
    replaces itself, so retries add nothing. Retention and purges remove files: a DataFrame opened
    before may fail afterwards; open the log anew then. One retention job runs at a time.
    """

    spark: SparkSession
    name: str

    # --- definition -------------------------------------------------------------------
    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def ensure(self, schema: T.StructType = LOG_SCHEMA) -> LogTable:
        """Create an empty log unless there is one."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in
                            [*schema.fields, *STORED_SCHEMA.fields[-2:]])
        options = ", ".join(f"{quoted(k)} = {quoted(v)}" for k, v in TABLE_OPTIONS.items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
                       f"OPTIONS ({options}) PARTITIONED BY (event_date, batch)")
        return self

    def evolve(self, schema: T.StructType = LOG_SCHEMA) -> LogTable:
        """Add the columns of ``schema`` that the table is without; older events have NULL there."""
        known = self.spark.table(self.name).columns
        missing = [f for f in schema if f.name not in known]
        if missing:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
            self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({columns})")
        return self

    def clone_schema(self, target: str) -> LogTable:
        """An empty log of the same shape under another name, unless one is there. Copies no events."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {target} LIKE {self.name}")
        return LogTable(self.spark, target)

    # --- reading ----------------------------------------------------------------------
    def _partitions(self, table: str = "") -> list[tuple[date | None, str]]:
        """Day and batch of every partition, as the catalog has them."""
        found = []
        for row in self.spark.sql(f"SHOW PARTITIONS {table or self.name}").collect():
            day, _, batch = row["partition"].removeprefix("event_date=").partition("/batch=")
            found.append((None if day == NO_DAY else date.fromisoformat(day), unquote(batch)))
        return found

    def days(self) -> list[date | None]:
        """Days that may hold events, oldest first; events without a time come before all."""
        return sorted({day for day, _ in self._partitions()}, key=lambda d: d or date.min)

    def read(self, days: Collection[date | None] | None = None) -> DataFrame:
        """The log, with ``event_date`` to prune by; with days given, of these days only.

        The catalog knows the schema and the partitions, so planning opens no file and lists only
        the folders of the days read.
        """
        # Another session, such as that of a stream, may have written since.
        self.spark.catalog.refreshTable(self.name)
        log = self.spark.table(self.name)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in STORED_SCHEMA if f.name not in log.columns}
        log = log.withColumns(missing).select(*STORED_SCHEMA.fieldNames())
        return log if days is None else log.filter(in_days(list(days)))

    def list_events(self, users: DataFrame, where: EventFilter = EventFilter(), rows: int = ALL,
                    page_no: int = 1, sort_column: str = "event_time",
                    sort_direction: str = "DESC", settings: Settings = Settings(),
                    **options) -> DataFrame:
        """A sorted page. By time, only as many days are opened, from the near end, as it needs."""
        rows = settings.rows_per_page if rows == ALL else rows
        log, per_day = None, None
        if sort_column == "event_time":
            needed = page_offset(page_no, rows) + rows
            log, per_day = self._days_with(where, needed, sort_direction.upper() == "DESC")
        return list_events(self.read() if log is None else log, users, where, rows, page_no,
                           sort_column, sort_direction, settings, per_day=per_day, **options)

    def _days_with(self, where: EventFilter, needed: int,
                   descending: bool) -> tuple[DataFrame, dict[date | None, int]]:
        """The fewest days (up to a factor) that hold ``needed`` matching events, and their counts."""
        days = self.days()[::-1] if descending else self.days()
        opened, counted, per_day = 1, 0, {}
        while True:
            # Days counted before are not counted again.
            per_day |= count_per_day(where.apply(self.read(days[counted:opened])))
            if opened >= len(days) or sum(per_day.values()) >= needed:
                return self.read(days[:opened]), per_day
            opened, counted = opened * DAYS_GROWTH, opened

    def search(self, where: EventFilter) -> DataFrame:
        """Matching events. Of signed batches only the files are read that may hold the text searched.

        The same rows as ``where.apply(log.read())``. Without a part long enough, or with more than
        ``MOST_FILES`` files left, nothing is passed over.
        """
        needles = needle_grams(where)
        if not needles or not self.spark.catalog.tableExists(self._signatures):
            return where.apply(self.read())
        self.spark.catalog.refreshTable(self._signatures)
        found = files_with(self.spark.table(self._signatures), needles).limit(MOST_FILES + 1).collect()
        if len(found) > MOST_FILES:
            return where.apply(self.read())
        signed = self.read().filter(F.col("_metadata.file_path").isin([r[FILE] for r in found]))
        hits = where.apply(signed.select(*STORED_SCHEMA.fieldNames()))
        unsigned = set(self._partitions()) - set(self._partitions(self._signatures))
        if not unsigned:
            return hits
        return hits.unionByName(where.apply(self.read().filter(_in_partitions(unsigned))))

    # --- writing ----------------------------------------------------------------------
    def append(self, events: DataFrame, batch: str | None = None, rebalance: bool = True,
               sign: bool = False) -> str:
        """Append events; writing the same ``batch`` again replaces it, so a retry adds nothing.

        ``sign`` reads what was written once more for the signatures that ``search`` uses. Rebalancing gives well-sized files per day and splits a day that holds most of the
        events. Files are sorted by time and id, which makes their row groups skippable.
        """
        self.ensure().evolve(T.StructType([f for f in LOG_SCHEMA if f.name in events.columns]))
        batch = batch or uuid.uuid4().hex
        dated = events.withColumns({"event_date": F.to_date("event_time"), "batch": F.lit(batch)})
        missing = {f.name: F.lit(None).cast(f.dataType) for f in LOG_SCHEMA if f.name not in events.columns}
        dated = dated.withColumns(missing).select(*self.spark.table(self.name).columns)
        if rebalance:
            dated = dated.hint("rebalance", "event_date")
        self._forget([p for p in self._partitions() if p[1] == batch])
        (dated.sortWithinPartitions("event_date", "batch", "event_time", "id")
         .write.mode("overwrite").insertInto(self.name))
        if sign:
            self._sign([(day, name) for day, name in self._partitions() if name == batch])
        return batch

    @property
    def _signatures(self) -> str:
        return f"{self.name}_signatures"

    def _sign(self, partitions: Collection[tuple[date | None, str]]) -> None:
        """Write the signatures of the files of some partitions."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._signatures} (file string, bucket bigint, bits binary, "
                       "event_date date, batch string) USING parquet "
                       "OPTIONS (partitionOverwriteMode = 'dynamic') PARTITIONED BY (event_date, batch)")
        if partitions:
            (file_signatures(self.read().filter(_in_partitions(partitions)))
             .write.mode("overwrite").insertInto(self._signatures))

    def _forget(self, partitions: Collection[tuple[date | None, str]]) -> list[tuple[date | None, str]]:
        """Drop the signatures of partitions whose files are about to change; returns which there were.

        A partition without signatures is always searched, so a run that is killed loses nothing.
        """
        if not self.spark.catalog.tableExists(self._signatures):
            return []
        known = [p for p in self._partitions(self._signatures) if p in set(partitions)]
        self._drop(known, self._signatures)
        return known

    @property
    def _quarantine(self) -> str:
        return f"{self.name}_quarantine"

    def quarantine(self, lines: DataFrame, batch: str) -> None:
        """Put lines that could not be read aside, in a table of their own, by batch."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._quarantine} (line string, batch string) "
                       "USING parquet OPTIONS (partitionOverwriteMode = 'dynamic') PARTITIONED BY (batch)")
        lines.select("line", F.lit(batch).alias("batch")).write.mode("overwrite").insertInto(self._quarantine)

    def quarantined(self) -> DataFrame:
        """The lines put aside, with their batch."""
        self.spark.catalog.refreshTable(self._quarantine)
        return self.spark.table(self._quarantine)

    # --- maintenance ------------------------------------------------------------------
    def expire(self, now: datetime, retention_days: int) -> int:
        """Remove the events that are older than the retention now; returns how many.

        Partitions of which nothing is left are dropped. Those that the cut goes through, all of
        one day, are filtered, staged and written back. A run that was killed in between is made
        up for by the next one: what it had staged in full is written back first.
        """
        cutoff = retention_cutoff(now, retention_days)
        if cutoff is None or not self.exists():
            return 0
        self._write_back()
        touched = [d for d in self.days() if d is not None and d <= cutoff.date()]
        due = F.coalesce(is_due(self.read(), cutoff), F.lit(False))
        # One row per partition.
        counts = (self.read(touched).groupBy("event_date", "batch")
                  .agg(F.count_if(due).alias("due"), F.count_if(~due).alias("kept")).collect())
        gone = [(r["event_date"], r["batch"]) for r in counts if r["due"] and not r["kept"]]
        self._drop(gone)
        self._forget(gone)
        cut = [r["batch"] for r in counts if r["due"] and r["kept"]]
        if cut:
            self._stage(self.read([cutoff.date()]).filter(F.col("batch").isin(cut) & ~due))
            self._write_back()
        return sum(r["due"] for r in counts)

    @property
    def _staging(self) -> str:
        """The folder of staged events, one for each table."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}")
        place = described.filter("col_name = 'Location'").first()["data_type"]
        known = hashlib.sha256(place.encode()).hexdigest()[:16]
        return f"{shared_folder(self.spark).rstrip('/')}/changetrail-staged-{known}"

    def _stage(self, kept: DataFrame) -> None:
        kept.write.mode("overwrite").parquet(self._staging)

    def _write_back(self) -> None:
        """Replace the partitions that are staged by what is staged, if that is complete."""
        staged = self._staging
        if is_complete(self.spark, staged):
            columns = self.spark.table(self.name).columns
            kept = self.spark.read.schema(STORED_SCHEMA).parquet(staged).select(*columns)
            names = [r["batch"] for r in kept.select("batch").distinct().collect()]
            signed = self._forget([p for p in self._partitions() if p[1] in names])
            (kept.hint("rebalance", "event_date", "batch")
             .sortWithinPartitions("event_date", "batch", "event_time", "id")
             .write.mode("overwrite").insertInto(self.name))
            if signed:
                self._sign(signed)
        delete_folder(self.spark, staged)

    def _drop(self, partitions: Iterable[tuple[date | None, str]], table: str = "") -> None:
        specs = [f"PARTITION (event_date = {f'DATE{quoted(str(day))}' if day else 'NULL'}, "
                 f"batch = {quoted(batch)})" for day, batch in partitions]
        if specs:
            self.spark.sql(f"ALTER TABLE {table or self.name} DROP IF EXISTS {', '.join(specs)}")

    @property
    def _purges(self) -> str:
        return f"{self.name}_purges"

    def purge(self, actor: str = "") -> None:
        """Remove every event. Who purged, and when, is a row of a table of its own."""
        self.ensure()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._purges} "
                       "(actor string, purged_at timestamp_ntz, events bigint) USING parquet")
        note = self.read().agg(F.count(F.lit(1)).alias("events")).select(
            F.lit(actor).alias("actor"), utc_now().alias("purged_at"), "events")
        note.write.insertInto(self._purges)
        # What a killed retention run has staged must not come back.
        delete_folder(self.spark, self._staging)
        partitions = self._partitions()
        self.spark.sql(f"TRUNCATE TABLE {self.name}")
        self._drop(partitions)
        self._forget(partitions)

    def purges(self) -> DataFrame:
        """Who purged, when, and how many events went."""
        return self.spark.table(self._purges)


def append_json_log(events: DataFrame, settings: Settings, batch: str) -> bool:
    """Feed web events to the JSON-lines log, if it is on, named and there; says whether it was.

    Each batch has a folder of its own that a retry overwrites.
    """
    if not (settings.json_log_enabled and settings.json_log_path):
        return False
    if not folder_exists(events.sparkSession, settings.json_log_path):
        return False
    json_log_lines(events).write.mode("overwrite").text(f"{settings.json_log_path}/batch={batch}")
    return True
