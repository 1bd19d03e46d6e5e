"""Search over the log: filters, counts, facets and sorted pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from changetrail import fixed_values as fixed
from changetrail.functions.requests import time_text, upper_first
from changetrail.operators.enrich import with_username
from changetrail.operators.lookups import BROADCAST_LIMIT_BYTES
from changetrail.operators.paging import SHALLOW_ROWS, page_offset, slice_sorted, sort_order
from changetrail.settings import Settings

ALL = -1
# A page of at most this many rows is fetched by literal keys, which Parquet can skip on.
LITERAL_KEYS = 1_000
KEY_COLUMNS = ("id", "event_time", "event_date")


def like_pattern(text: str) -> str:
    """``%text%`` for Spark's LIKE with the stored log's escape rules.

    ``%`` and ``_`` of the user stay wildcards and a backslash takes the next character
    literally. Spark accepts a backslash only before ``%``, ``_`` and itself.
    """
    pattern, out, i = f"%{text}%", [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            i += 1
            char = pattern[i] if pattern[i] not in "%_\\" else "\\" + pattern[i]
        out.append(char)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class EventFilter:
    """Optional predicates, joined by AND. ``None`` (or -1) leaves one out; user 0 is the CLI."""

    search: str = ""
    page_name: str | None = None
    user_id: int | None = None
    literal: bool = False        # take % and _ in `search` as plain characters
    ignore_case: bool = False    # for the page name only; posts compare byte by byte

    def predicates(self) -> list[Column]:
        out = []
        if self.search != "":
            page, post = F.col("page"), F.col("post")
            needle = self.search
            if self.ignore_case:
                page, needle = F.lower(page), self.search.lower()
            if self.literal:
                out.append(page.contains(needle) | post.contains(self.search))
            else:
                out.append(page.like(like_pattern(needle)) | post.like(like_pattern(self.search)))
        if self.page_name not in (None, str(ALL)):
            out.append(F.col("page") == self.page_name)
        if self.user_id is not None and self.user_id > ALL:
            out.append(F.col("user_id") == self.user_id)
        return out

    def apply(self, log: DataFrame) -> DataFrame:
        predicates = self.predicates()
        return log.filter(reduce(and_, predicates)) if predicates else log


def event_by_id(log: DataFrame, event_id: int, day: date | None = None) -> DataFrame:
    """One event. Parquet skips row groups whose id range does not hold it.

    On a log split by day, a day that the caller knows prunes all others.
    """
    found = log.filter(F.col("id") == event_id)
    return found if day is None else found.filter(F.col("event_date") == F.lit(day))


def count_events(log: DataFrame, where: EventFilter = EventFilter()) -> DataFrame:
    """Number of matching events.

    User ids are unique, so joining user names could not change the count and is left out.
    """
    return where.apply(log).agg(F.count(F.lit(1)).alias("events"))


def page_facet(log: DataFrame) -> DataFrame:
    return log.select("page").distinct().orderBy("page")


def user_facet(log: DataFrame, users: DataFrame) -> DataFrame:
    """Users seen in the log, without the fixed choice 0 (command runs), with their names."""
    seen = log.filter(F.col("user_id") != 0).select("user_id").distinct()
    names = users.select(F.col("id").alias("user_id"), "username")
    return seen.join(names, "user_id", "left").orderBy("user_id")


def _checked_sort(column: str, direction: str) -> bool:
    if column not in fixed.SORTABLE_COLUMNS:
        raise ValueError(f"cannot sort by {column!r}; choose from {fixed.SORTABLE_COLUMNS}")
    if direction.upper() not in ("ASC", "DESC"):
        raise ValueError(f"sort direction is ASC or DESC, not {direction!r}")
    return direction.upper() == "DESC"


def list_events(log: DataFrame, users: DataFrame, where: EventFilter = EventFilter(),
                rows: int = ALL, page_no: int = 1, sort_column: str = "event_time",
                sort_direction: str = "DESC", settings: Settings = Settings(),
                broadcast_limit: int = BROADCAST_LIMIT_BYTES,
                shallow_rows: int = SHALLOW_ROWS,
                per_day: dict[date | None, int] | None = None) -> DataFrame:
    """One sorted page of matching events, with user names.

    User ids are unique, so a left join neither adds nor drops rows: unless the page is sorted
    by user name, names are joined to the finished page only. A page near the start of a log that is
    not split by ``event_date`` takes one scan. Otherwise narrow columns are ranked, and the wide ones are
    read for the page alone. ``per_day`` passes
    counts of matching events per day that the caller has already.
    """
    descending = _checked_sort(sort_column, sort_direction)
    rows = settings.rows_per_page if rows == ALL else rows
    offset = page_offset(page_no, rows)
    hits = where.apply(log)
    columns = [name for name in log.columns if name not in ("event_date", "batch")]

    def rank(source: DataFrame) -> DataFrame:
        if sort_column == "username":
            source = with_username(source, users, broadcast_limit=broadcast_limit)
        return slice_sorted(source, sort_column, descending, offset, rows,
                            shallow_rows=shallow_rows)

    if "event_date" in log.columns:
        if sort_column == "event_time":
            per_day = count_per_day(hits) if per_day is None else per_day
            days, offset = days_of_slice(per_day, descending, offset, rows)
            hits = hits.filter(in_days(days))
    names = users.select(F.col("id").alias("user_id"), "username")

    def named(page: DataFrame) -> DataFrame:
        # No hint: the page is small, and Spark holds the users' size against its own threshold.
        if "username" not in page.columns:
            page = page.join(names, "user_id", "left")
        return page.select(*columns, "username").orderBy(*sort_order(sort_column, descending))

    if "event_date" not in log.columns and offset + rows <= min(LITERAL_KEYS, shallow_rows):
        # One scan: the few rows up to the page's end are carried whole.
        return named(rank(hits))
    # Only keys are ranked; the wide columns are read for the rows of the page alone.
    narrow = {"id", "event_time", "event_date", "user_id", sort_column}
    keys = rank(hits.select(*[n for n in hits.columns if n in narrow])).select(
        *[n for n in KEY_COLUMNS if n in hits.columns])
    if "event_date" in log.columns and rows <= LITERAL_KEYS:
        page = _fetch(hits, keys.collect())
    else:
        page = _with_keys(hits, F.broadcast(keys) if rows <= shallow_rows else keys)
    return named(page)


def events_per_day(hits: DataFrame) -> DataFrame:
    """Matching events per day: their sum is the total, and paging by time is cut down by it."""
    return hits.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


def count_per_day(hits: DataFrame) -> dict[date | None, int]:
    """The same on the driver, which gets one number per day."""
    return {r["event_date"]: r["events"] for r in events_per_day(hits).collect()}


def days_of_slice(per_day: dict[date | None, int], descending: bool, offset: int,
                  rows: int) -> tuple[list[date | None], int]:
    """Days that hold rows ``offset .. offset + rows``, and the offset within those days."""
    order = sorted(per_day, key=lambda d: (d is not None, d or date.min), reverse=descending)
    days, before, skipped = [], 0, 0
    for day in order:
        if before >= offset + rows:
            break
        if before + per_day[day] <= offset:
            skipped += per_day[day]
        else:
            days.append(day)
        before += per_day[day]
    return days, offset - skipped


def in_days(days: list[date | None]) -> Column:
    """Whether an event is of one of these days."""
    if not days:
        return F.lit(False)
    dated = F.col("event_date").isin([d for d in days if d is not None])
    return dated | F.col("event_date").isNull() if None in days else dated


def _with_keys(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """Exactly the events whose keys are given, NULLs included."""
    names = keys.columns
    named = keys.select(*[F.col(n).alias(f"_{n}") for n in names])
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return hits.join(named, same, "left_semi")


def _fetch(hits: DataFrame, keys: list[Row]) -> DataFrame:
    """Whole events of one page, by literals on day, time and id that prune files and row groups.

    ``keys`` are those of the page, at most ``LITERAL_KEYS``. The literals alone would also take
    another page's event with the id of one row and the day of another, so the keys themselves
    decide.
    """
    if not keys:
        return hits.filter(F.lit(False))
    fetched = hits.filter(in_days(list({k["event_date"] for k in keys}))
                          & F.col("id").isin([k["id"] for k in keys]))
    times = [k["event_time"] for k in keys]
    if None not in times:
        kind = hits.schema["event_time"].dataType
        low, high = (F.lit(str(t)).cast(kind) for t in (min(times), max(times)))
        fetched = fetched.filter(F.col("event_time").between(low, high))
    schema = hits.select(*[n for n in KEY_COLUMNS if n in hits.columns]).schema
    return _with_keys(fetched, F.broadcast(hits.sparkSession.createDataFrame(keys, schema)))


def display_view(page: DataFrame) -> DataFrame:
    """Events as a reader sees them: a command run shows its OS user and no agent."""
    is_cli = F.col("action") == fixed.ACTION_CLI
    return page.select(
        "id", "page",
        F.when(is_cli, F.col("user_agent")).otherwise(F.col("username")).alias("user_name"),
        upper_first(F.col("action")).alias("action"),
        F.when(is_cli, fixed.NOT_APPLICABLE).otherwise(F.col("user_agent")).alias("user_agent"),
        "ip_address",
        time_text(F.col("event_time")).alias("event_time"))
