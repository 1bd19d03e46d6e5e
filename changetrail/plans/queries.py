"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail.functions import params as P
from changetrail.functions import requests as R
from changetrail.functions.binding import explode_positions
from changetrail.operators import detail, enrich, export, ingest, maintain, search
from changetrail.operators.checkpoints import shared_folder
from changetrail.operators.search import EventFilter
from changetrail.plans import fixtures as fx
from changetrail.schemas import LOG_SCHEMA, RAW_SCHEMA, REQUEST_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.files import make_folder
from changetrail.sources.log_table import LogTable, append_json_log
from changetrail.sources.readers import (read_entity_tables, read_json_lines, read_requests,
                                          read_users, split_broken, with_request_fields)
from changetrail.streaming.ingest import ingest_requests, live_view
from changetrail.streaming.ingest import ingest_routed as start_routed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

NOW = datetime(2024, 1, 31)
RETENTION_DAYS = 14
LATE_IDS = 10**9
MIXED_PAGES = (("event_time", 30, 3), ("event_time", 1200, 1), ("page", 40, 2), ("username", 600, 1))
LOG_COLUMNS = LOG_SCHEMA.fieldNames()


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/changetrail-{uuid.uuid4().hex}"


def _empty_log(spark: SparkSession) -> LogTable:
    """A log in a database of its own, whose tables lie in the shared folder."""
    folder = _scratch(spark)
    database = folder.rpartition("/")[2].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    return LogTable(spark, f"{database}.activity_log")


def _stored_log(spark: SparkSession, sf: str) -> LogTable:
    log = _empty_log(spark)
    log.append(maintain.evolve_schema(fx.activity_log(spark, sf)), batch="load")
    return log


def _request_log(spark: SparkSession, sf: str) -> DataFrame:
    """All requests as log rows, whether admitted or not, without snapshots."""
    requests = fx.raw_requests(spark, sf).withColumn("preset_action", F.lit(None).cast("string"))
    return ingest.normalise_requests(requests).drop("items")


# --- search ------------------------------------------------------------------------------
@query
def list_events(spark, sf):
    return search.list_events(fx.activity_log(spark, sf), fx.users(spark, sf),
                              EventFilter(search="r"), rows=30, page_no=1)


@query
def list_second_page(spark, sf):
    return search.list_events(fx.activity_log(spark, sf), fx.users(spark, sf),
                              EventFilter(search="r"), rows=30, page_no=2)


@query
def list_by_username_asc(spark, sf):
    return search.list_events(fx.activity_log(spark, sf), fx.users(spark, sf), rows=200,
                              page_no=3, sort_column="username", sort_direction="ASC")


@query
def list_deep_page(spark, sf):
    """The way deep pages go, taken here at any depth."""
    return search.list_events(fx.activity_log(spark, sf), fx.users(spark, sf), rows=70,
                              page_no=9, sort_column="page", sort_direction="ASC",
                              shallow_rows=0)


@query
def list_stored_page(spark, sf):
    """A page of a log split by day."""
    return _stored_log(spark, sf).list_events(
        fx.users(spark, sf), EventFilter(search="i"), rows=40, page_no=7)


@query
def search_events(spark, sf):
    return EventFilter(search="e_ro").apply(fx.activity_log(spark, sf))


@query
def search_literal(spark, sf):
    return EventFilter(search="5}", literal=True).apply(fx.activity_log(spark, sf))


@query
def search_ignore_case(spark, sf):
    return EventFilter(search="IEW.p", ignore_case=True).apply(fx.activity_log(spark, sf))


SIGNED_NEEDLES = ("click%7", "k\\.php", "e", "purchase", '"k": 5%', "no such text", "8_}", "sig", "")


@query
def search_signed(spark, sf):
    """Searches of a log whose files have signatures, but for those of one batch."""
    log = _empty_log(spark)
    events = maintain.evolve_schema(fx.activity_log(spark, sf))
    for number in range(3):
        log.append(events.filter(F.col("id") % 3 == number), f"part-{number}", sign=number < 2)
    log.expire(NOW, RETENTION_DAYS)
    found = [log.search(EventFilter(search=needle)).select(F.lit(needle).alias("needle"), *LOG_COLUMNS)
             for needle in SIGNED_NEEDLES]
    return reduce(DataFrame.unionByName, found)


@query
def filter_page(spark, sf):
    return EventFilter(page_name="click.php").apply(fx.activity_log(spark, sf))


@query
def filter_user(spark, sf):
    return EventFilter(user_id=7).apply(fx.activity_log(spark, sf))


@query
def filter_cli(spark, sf):
    return EventFilter(user_id=0).apply(fx.activity_log(spark, sf))


@query
def filter_all(spark, sf):
    where = EventFilter(search="1", page_name="view.php", user_id=8)
    return where.apply(fx.activity_log(spark, sf))


@query
def event_by_id(spark, sf):
    return search.event_by_id(fx.activity_log(spark, sf), 500)


@query
def count_events(spark, sf):
    return search.count_events(fx.activity_log(spark, sf), EventFilter(search="r"))


@query
def page_facet(spark, sf):
    return search.page_facet(fx.activity_log(spark, sf))


@query
def user_facet(spark, sf):
    return search.user_facet(fx.activity_log(spark, sf), fx.users(spark, sf))


@query
def with_username(spark, sf):
    return enrich.with_username(fx.activity_log(spark, sf), fx.users(spark, sf))


@query
def with_username_read(spark, sf):
    """Users from the files of the user dimension, which hold more than is read."""
    path = _scratch(spark)
    fx.users(spark, sf).withColumn("email", F.lit("x")).write.parquet(path)
    return enrich.with_username(fx.activity_log(spark, sf), read_users(spark, path))


@query
def with_username_shuffled(spark, sf):
    """The way taken when the user dimension is too large to broadcast."""
    return enrich.with_username(fx.activity_log(spark, sf), fx.users(spark, sf),
                                broadcast_limit=0)


@query
def display_view(spark, sf):
    named = enrich.with_username(fx.activity_log(spark, sf), fx.users(spark, sf))
    return search.display_view(named)


# --- detail and export -------------------------------------------------------------------
@query
def event_header(spark, sf):
    named = enrich.with_username(fx.activity_log(spark, sf), fx.users(spark, sf))
    return detail.event_header(named)


@query
def cli_detail(spark, sf):
    return detail.cli_detail(fx.activity_log(spark, sf))


@query
def event_attributes(spark, sf):
    return detail.event_attributes(_request_log(spark, sf))


@query
def attribute_order(spark, sf):
    """Whole numbers, signs, letters and the empty name as names of attributes; few and many."""
    return detail.event_attributes(fx.odd_attributes(spark, sf))


@query
def event_objects_pretty(spark, sf):
    """Snapshots of all pages, one field per line."""
    log = enrich.snapshot_objects(fx.selected_items_all_pages(spark, sf), fx.entity_tables(spark, sf))
    return detail.event_objects(log.withColumnRenamed("event_id", "id"), pretty=True)


@query
def event_objects(spark, sf):
    log = enrich.snapshot_objects(fx.selected_items(spark, sf), fx.entity_tables(spark, sf))
    return detail.event_objects(log.withColumnRenamed("event_id", "id"))


@query
def export_events(spark, sf):
    return export.export_events(_request_log(spark, sf), fx.users(spark, sf))


@query
def export_filtered(spark, sf):
    return export.export_events(fx.activity_log(spark, sf), fx.users(spark, sf),
                                EventFilter(search="k", page_name="purchase.php"))


@query
def export_lines(spark, sf):
    """The plain-text export, written and read back, header included."""
    path = _scratch(spark)
    export.write_export(export_events(spark, sf), path, fmt="legacy")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def export_csv(spark, sf):
    """The quoted export, written and read back."""
    path = _scratch(spark)
    exported = export.export_events(fx.activity_log(spark, sf), fx.users(spark, sf))
    export.write_export(exported, path, fmt="csv")
    return spark.read.schema(exported.schema).csv(path, header=True, escape='"')


@query
def export_escaped(spark, sf):
    """Fields without the characters that unquoted output can't hold."""
    return export.escape_fields(export_events(spark, sf))


@query
def flatten_post(spark, sf):
    return fx.raw_requests(spark, sf).select(
        "req_id", P.flatten_post(F.col("params")).alias("flat"))


# --- ingest ------------------------------------------------------------------------------
@query
def request_fields(spark, sf):
    fields = with_request_fields(fx.web_form_requests(spark, sf))
    return fields.select("req_id", "req_action", "mode_arg", "drp_action", "purge_continue",
                         "has_items", F.array_join("selected_items", ",").alias("items"))


@query
def admit_requests(spark, sf):
    return ingest.admit_requests(fx.raw_requests(spark, sf)).select(
        "req_id", "script_name", "preset_action")


@query
def classify_action(spark, sf):
    admitted = ingest.admit_requests(fx.raw_requests(spark, sf))
    return ingest.classify_actions(admitted).select("req_id", "action")


@query
def normalise_requests(spark, sf):
    """Log rows of admitted requests before their snapshots."""
    admitted = ingest.admit_requests(fx.raw_requests(spark, sf))
    return ingest.normalise_requests(admitted).drop("items")


@query
def client_ip(spark, sf):
    return fx.raw_requests(spark, sf).select(
        "req_id", R.client_ip(F.col("xff"), F.col("http_xff"), F.col("remote_addr"))
        .alias("ip_address"))


@query
def page_name(spark, sf):
    return fx.raw_requests(spark, sf).select(
        "req_id", R.page_name(F.col("script_name")).alias("page"))


@query
def admit_cli(spark, sf):
    return ingest.admit_commands(fx.raw_cli(spark, sf)).select(
        "event_id", F.col("argv")[0].alias("script"))


@query
def normalise_cli(spark, sf):
    return ingest.command_events(fx.raw_cli(spark, sf))


@query
def route_events(spark, sf):
    """Requests of which every fourth also carries a command line."""
    raw = fx.raw_requests(spark, sf).withColumn(
        "argv", F.when(F.col("req_id") % 4 == 0, F.array(F.lit("/a/cli/add.php"))))
    web, cli = ingest.split_routes(raw)
    return (web.select("req_id", F.lit("web").alias("route"))
            .unionByName(cli.select("req_id", F.lit("cli").alias("route"))))


@query
def redact_params(spark, sf):
    redacted = P.redact(P.parse_params(F.col("params")))
    rows = explode_positions(fx.raw_requests(spark, sf), ["req_id"],
                             F.map_entries(redacted), "param")
    return rows.select("req_id", F.col("param.key").alias("param"),
                       F.to_json("param.value").alias("value"))


@query
def encode_post(spark, sf):
    redacted = P.redact(P.parse_params(F.col("params")))
    return fx.raw_requests(spark, sf).select("req_id", P.encode_params(redacted).alias("post"))


@query
def decode_selected_items(spark, sf):
    fields = with_request_fields(fx.web_form_requests(spark, sf))
    return explode_positions(fields.filter("has_items"), ["req_id", "drp_action"],
                             F.col("selected_items"), "item")


# --- enrichment --------------------------------------------------------------------------
def _snapshots(events: DataFrame, tables, **options) -> DataFrame:
    return enrich.snapshot_objects(events, tables, **options).select("event_id", "object_data")


@query
def snapshot_objects(spark, sf):
    return _snapshots(fx.selected_items(spark, sf), fx.entity_tables(spark, sf))


@query
def snapshot_all_pages(spark, sf):
    return _snapshots(fx.selected_items_all_pages(spark, sf), fx.entity_tables(spark, sf))


@query
def snapshot_read_tables(spark, sf):
    """Entity tables from their files."""
    folder = _scratch(spark)
    paths = {}
    for name, entities in fx.entity_tables(spark, sf).items():
        paths[name] = f"{folder}/{name}"
        entities.write.parquet(paths[name])
    return _snapshots(fx.selected_items(spark, sf), read_entity_tables(spark, paths))


@query
def snapshot_shuffled(spark, sf):
    """The way taken when the entity tables are too large to broadcast."""
    return _snapshots(fx.selected_items_all_pages(spark, sf), fx.entity_tables(spark, sf),
                      broadcast_limit=0)


@query
def device_flags(spark, sf):
    devices = fx.entity_tables(spark, sf)["automation_devices"]
    return enrich.decode_device_flags(devices).select("id", "snmp", "up")


# --- maintenance and sinks ---------------------------------------------------------------
@query
def expire_events(spark, sf):
    return maintain.expire_events(fx.activity_log(spark, sf), NOW, RETENTION_DAYS)


@query
def purged_count(spark, sf):
    return maintain.purged_count(fx.activity_log(spark, sf), NOW, RETENTION_DAYS)


@query
def expire_stored(spark, sf):
    """What is left of a stored log after its retention job."""
    store = _stored_log(spark, sf)
    store.expire(NOW, RETENTION_DAYS)
    return store.read().select(*LOG_COLUMNS)


def _web_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.web_events(fx.raw_requests(spark, sf), fx.entity_tables(spark, sf))


@query
def append_events(spark, sf):
    """Web requests and command runs appended to a log and read back."""
    store = _empty_log(spark)
    store.append(ingest.log_events(fx.raw_requests(spark, sf), fx.raw_cli(spark, sf),
                                   fx.entity_tables(spark, sf)))
    return store.read().select(*LOG_COLUMNS)


@query
def ingest_stream(spark, sf):
    folder = _scratch(spark)
    requests = fx.raw_requests(spark, sf).select(
        *[F.col(f.name).cast(f.dataType) for f in REQUEST_SCHEMA])
    requests.write.parquet(f"{folder}/raw")
    stream = read_requests(spark, f"{folder}/raw", REQUEST_SCHEMA, stream=True)
    store = _empty_log(spark)
    job = ingest_requests(stream, store, lambda: fx.entity_tables(spark, sf),
                          f"{folder}/checkpoint", trigger={"availableNow": True})
    job.awaitTermination()
    return store.read().select(*LOG_COLUMNS)


@query
def web_events_raw(spark, sf):
    """Requests as they come: parameters to fields, admission, action, items, snapshot, post."""
    return ingest.web_events(fx.web_form_requests(spark, sf), fx.entity_tables(spark, sf))


@query
def route_raw(spark, sf):
    """Raw records of both kinds, each over the route that it takes."""
    return ingest.routed_events(fx.raw_records(spark, sf), fx.entity_tables(spark, sf))


def _routed_in_two_runs(spark: SparkSession, sf: str, records: DataFrame, read, write) -> LogTable:
    """A log fed by a stream over two sets of files that is stopped and started again in between."""
    folder, log = _scratch(spark), _empty_log(spark)
    for part in ("first", "second"):
        write(records.filter(F.col("part") == part).drop("part"), f"{folder}/raw")
        job = start_routed(read(f"{folder}/raw"), log, lambda: fx.entity_tables(spark, sf),
                           f"{folder}/checkpoint", trigger={"availableNow": True})
        job.awaitTermination()
    return log


HALVES = "case when {} % 3 = 0 then 'second' else 'first' end"


@query
def ingest_routed(spark, sf):
    """One stream of raw records, both routes, over a restart."""
    records = fx.raw_records(spark, sf).withColumn("part", F.expr(HALVES.format("req_id")))
    return _routed_in_two_runs(
        spark, sf, records, lambda path: read_requests(spark, path, RAW_SCHEMA, stream=True),
        lambda part, path: part.write.mode("append").parquet(path)).read().select(*LOG_COLUMNS)


def _written_lines(spark: SparkSession, sf: str) -> str:
    path = _scratch(spark)
    fx.json_lines(spark, sf).write.text(path)
    return path


@query
def whole_json_lines(spark, sf):
    whole, _ = split_broken(read_json_lines(spark, _written_lines(spark, sf)))
    fields = ingest.with_request_fields(whole)
    return fields.select("req_id", F.col("user_id").isNotNull().alias("has_user"),
                         R.page_name(F.col("script_name")).alias("page"),
                         P.encode_params(P.redact(P.parse_params(F.col("params")))).alias("post"))


@query
def broken_json_lines(spark, sf):
    return split_broken(read_json_lines(spark, _written_lines(spark, sf)))[1]


@query
def ingest_json_stream(spark, sf):
    """JSON lines as a stream: what was logged, and the lines that were put aside."""
    halves, lines = HALVES.format("length(value)"), _scratch(spark)
    # Which half a line is in shows only when it is made: made once, and then read by halves.
    fx.json_lines(spark, sf).withColumn("part", F.expr(halves)).write.partitionBy("part").text(lines)
    log = _routed_in_two_runs(
        spark, sf, spark.read.text(lines),
        lambda path: read_json_lines(spark, path, stream=True),
        lambda part, path: part.write.mode("append").text(path))
    return log.read().select(*LOG_COLUMNS).unionByName(log.quarantined().select("line"),
                                                       allowMissingColumns=True)


@query
def live_view_stream(spark, sf):
    """Events as they come in, with user names: a stream joined to a table that stands still."""
    folder = _scratch(spark)
    fx.raw_records(spark, sf).write.parquet(f"{folder}/raw")
    seen = live_view(read_requests(spark, f"{folder}/raw", RAW_SCHEMA, stream=True), fx.users(spark, sf))
    (seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start(f"{folder}/seen").awaitTermination())
    return spark.read.schema(seen.schema).parquet(f"{folder}/seen")


@query
def json_log_sink(spark, sf):
    """The JSON-lines feed, written and parsed back."""
    settings = Settings(json_log_enabled=True, json_log_path=_scratch(spark))
    make_folder(spark, settings.json_log_path)
    append_json_log(_web_events(spark, sf), settings, batch="web-0")
    lines = spark.read.text(settings.json_log_path)
    fields = "page string, user_id bigint, action string, ip_address string, " \
             "user_agent string, event_time string, post string, object_data string"
    return lines.select(F.from_json("value", fields).alias("e")).select("e.*")


@query
def evolve_schema(spark, sf):
    """The log from before snapshots, read in the current shape."""
    return maintain.evolve_schema(fx.activity_log(spark, sf))


OLD_COLUMNS = [name for name in LOG_COLUMNS if name != "object_data"]


def _two_shapes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The log in two parts: from before snapshots were kept, and since."""
    log = fx.activity_log(spark, sf)
    since = log.filter("id % 2 = 1").withColumn("object_data", F.lit("[]"))
    return log.filter("id % 2 = 0").select(*OLD_COLUMNS), since.select(*LOG_COLUMNS)


@query
def evolve_table(spark, sf):
    """A table that gets a column: files of both shapes, read as one."""
    before, since = _two_shapes(spark, sf)
    log = _empty_log(spark).ensure(T.StructType([LOG_SCHEMA[name] for name in OLD_COLUMNS]))
    log.append(before, "before")
    log.evolve().append(since, "since")
    return log.read().select(*LOG_COLUMNS)


@query
def evolve_files(spark, sf):
    """Files of both shapes in one folder, whose columns are merged."""
    path = _scratch(spark)
    for part in _two_shapes(spark, sf):
        part.write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select(*LOG_COLUMNS)


@query
def purge_notes(spark, sf):
    """Who purged the log, and how many events went."""
    store = _stored_log(spark, sf)
    store.expire(NOW, RETENTION_DAYS)
    store.purge("bea")
    store.append(maintain.evolve_schema(fx.activity_log(spark, sf)), batch="anew")
    store.purge("admin")
    return store.purges().select("actor", "events")


@query
def purge_all(spark, sf):
    store = _stored_log(spark, sf)
    before = store.read().count()
    store.purge()
    return store.read().agg(F.lit(before).alias("events_before"),
                            F.count(F.lit(1)).alias("events_after"))


@query
def append_after_expire(spark, sf):
    """Older events that arrive after a retention run stay until the next one."""
    store = _stored_log(spark, sf)
    store.expire(NOW, RETENTION_DAYS)
    late = maintain.evolve_schema(fx.activity_log(spark, sf))
    store.append(late.withColumn("id", F.col("id") + LATE_IDS), batch="late")
    return store.read().select(*LOG_COLUMNS)


@query
def append_after_purge(spark, sf):
    """A purge forgets the retention of what it removed."""
    store = _stored_log(spark, sf)
    store.expire(NOW, RETENTION_DAYS)
    store.purge("admin")
    store.append(maintain.evolve_schema(fx.activity_log(spark, sf)), batch="anew")
    return store.read().select(*LOG_COLUMNS)


def _mixed_log(spark: SparkSession, sf: str) -> LogTable:
    """A stored log of web requests and command runs, whose source ids overlap."""
    store = _empty_log(spark)
    store.append(ingest.log_events(fx.raw_requests(spark, sf), fx.raw_cli(spark, sf),
                                   fx.entity_tables(spark, sf)))
    return store


@query
def list_mixed_log(spark, sf):
    """Pages below and above the limits at which paging takes another way."""
    store, users, pages = _mixed_log(spark, sf), fx.users(spark, sf), []
    for sort, rows, page in MIXED_PAGES:
        listed = store.list_events(users, rows=rows, page_no=page, sort_column=sort, shallow_rows=500)
        pages.append(listed.select(F.lit(f"{sort} {rows}").alias("list"), *LOG_COLUMNS, "username"))
    return reduce(DataFrame.unionByName, pages)


@query
def event_by_id_mixed(spark, sf):
    """The events of both sources that have the same source id."""
    log = _mixed_log(spark, sf).read()
    return search.event_by_id(log, 1200).unionByName(search.event_by_id(log, 1201)).select(*LOG_COLUMNS)


@query
def ensure_log(spark, sf):
    """Ensuring a log that exists leaves its events alone."""
    store = _stored_log(spark, sf).ensure()
    return store.read().agg(F.count(F.lit(1)).alias("events"))


@query
def clone_schema(spark, sf):
    store = _stored_log(spark, sf)
    clone = store.clone_schema(f"{store.name}_clone")
    columns = len(set(store.read().columns) & set(clone.read().columns))
    return store.read().agg(
        F.count(F.lit(1)).alias("events"), F.lit(clone.read().count()).alias("cloned_events"),
        F.lit(columns).alias("columns"))


@query
def overlong_values(spark, sf):
    return maintain.overlong_values(fx.activity_log(spark, sf))
