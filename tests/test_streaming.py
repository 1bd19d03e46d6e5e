"""Streams give what a batch gives, through restarts and replays."""

import json

import pytest
from tables import SF_DIR, new_log
from pyspark.sql import functions as F

from changetrail.operators.enrich import with_username
from changetrail.operators.ingest import command_events, routed_events, routed_rows, web_events
from changetrail.operators.search import display_view
from changetrail.plans import fixtures as fx
from changetrail.schemas import CLI_SCHEMA, LOG_SCHEMA, RAW_SCHEMA, REQUEST_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.files import make_folder
from changetrail.sources.readers import read_commands, read_json_lines, read_requests, split_broken
from changetrail.streaming.ingest import (ingest_commands, ingest_requests, ingest_routed, live_view,
                                          routed_batch_writer, web_batch_writer)

NOW = {"availableNow": True}


def rows(df):
    return sorted(map(str, df.select(*LOG_SCHEMA.fieldNames()).collect()))


@pytest.fixture
def requests(spark):
    return fx.raw_requests(spark, SF_DIR).select(
        *[F.col(f.name).cast(f.dataType) for f in REQUEST_SCHEMA])


def test_stream_equals_batch_across_a_restart(spark, folder, requests):
    def tables():
        return fx.entity_tables(spark, SF_DIR)

    settings = Settings(json_log_enabled=True, json_log_path=folder + "/json")
    store = new_log(spark, folder + "/log")
    make_folder(spark, folder + "/json")

    def run():
        stream = read_requests(spark, folder + "/raw", REQUEST_SCHEMA, stream=True,
                               maxFilesPerTrigger="1")
        ingest_requests(stream, store, tables, folder + "/checkpoint", settings,
                        trigger=NOW).awaitTermination()

    requests.filter("req_id % 3 <> 0").repartition(2).write.parquet(folder + "/raw")
    run()
    requests.filter("req_id % 3 = 0").repartition(1).write.parquet(folder + "/raw", mode="append")
    run()
    run()                                            # nothing new
    want = rows(web_events(requests, tables(), settings))
    assert rows(store.read()) == want
    batches = {r["batch"] for r in store.read().select("batch").distinct().collect()}
    assert len(batches) == 3 and len({b[:-9] for b in batches}) == 1
    assert not any(b.startswith("web-batch") for b in batches)

    # the last batch again, as after a failure before its commit
    last = requests.filter("req_id % 3 = 0")
    context, key = spark.sparkContext, "sql.streaming.queryId"
    context.setLocalProperty(key, batches.pop().removeprefix("web-")[:-10])
    try:
        web_batch_writer(store, tables, settings, "web")(last, 2)
    finally:
        context.setLocalProperty(key, None)
    assert rows(store.read()) == want
    lines = [json.loads(r["value"]) for r in spark.read.text(folder + "/json").collect()]
    assert len(lines) == len(want)
    assert not any("password" in line["post"].lower() for line in lines)


def test_command_stream(spark, folder):
    commands = fx.raw_cli(spark, SF_DIR).select(
        *[F.col(f.name).cast(f.dataType) for f in CLI_SCHEMA])
    commands.write.parquet(folder + "/raw")
    store = new_log(spark, folder + "/log")
    stream = read_commands(spark, folder + "/raw", stream=True)
    ingest_commands(stream, store, folder + "/checkpoint", trigger=NOW).awaitTermination()
    assert rows(store.read()) == rows(command_events(commands))


def test_one_stream_takes_both_routes_across_a_restart_and_a_replay(spark, folder):
    def tables():
        return fx.entity_tables(spark, SF_DIR)

    settings = Settings(json_log_enabled=True, json_log_path=folder + "/json")
    log = new_log(spark, folder + "/log")
    make_folder(spark, folder + "/json")
    lines = fx.json_lines(spark, SF_DIR)

    def run():
        stream = read_json_lines(spark, folder + "/raw", stream=True, maxFilesPerTrigger="1")
        ingest_routed(stream, log, tables, folder + "/checkpoint", settings, trigger=NOW).awaitTermination()

    lines.filter("length(value) % 3 <> 0").repartition(2).write.text(folder + "/raw")
    run()
    rest = lines.filter("length(value) % 3 = 0")
    rest.repartition(1).write.mode("append").text(folder + "/raw")
    run()
    run()                                            # nothing new
    records, broken = split_broken(read_json_lines(spark, folder + "/raw"))
    want = rows(routed_events(records, tables()))
    assert rows(log.read()) == want
    web = log.read().filter("action <> 'cli'").count()
    assert 0 < web < len(want) and log.read().filter("object_data is null").count() == len(want) - web
    aside = sorted(r["value"] for r in lines.filter("value not like '%event_time%'").collect())
    assert sorted(r["line"] for r in log.quarantined().collect()) == aside
    assert sorted(r["line"] for r in broken.collect()) == aside and aside

    # The last batch again, as after a failure before its commit: log, feed and lines put aside.
    batches = sorted(r["batch"] for r in log.read().select("batch").distinct().collect())
    assert len(batches) == 3
    rest.write.text(folder + "/last")
    context, key = spark.sparkContext, "sql.streaming.queryId"
    context.setLocalProperty(key, batches[-1].removeprefix("raw-")[:-10])
    try:
        routed_batch_writer(log, tables, settings, "raw")(read_json_lines(spark, folder + "/last"), 2)
    finally:
        context.setLocalProperty(key, None)
    assert rows(log.read()) == want
    assert sorted(r["line"] for r in log.quarantined().collect()) == aside
    assert spark.read.text(folder + "/json").count() == web


def test_lines_that_are_no_records_are_kept_whole(spark, folder):
    lines = ['{"req_id":1,"script_name":"/a/host.php","argv":["x"]}', '{"req_id":2,', "not json", "",
             '{"req_id":"seven"}', "  ", '{"req_id":3,"event_time":"2024-01-02T03:04:05","new":1}', "[]x"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(folder + "/raw")
    for stream in (False, True):
        records = read_json_lines(spark, folder + "/raw", stream=stream)
        assert records.columns == [*RAW_SCHEMA.fieldNames(), "broken_line"] and records.isStreaming == stream
    whole, broken = split_broken(read_json_lines(spark, folder + "/raw"))
    assert sorted(r["req_id"] for r in whole.collect()) == [1, 3]
    assert sorted(r["line"] for r in broken.collect()) == sorted([lines[1], lines[2], lines[4], lines[7]])


def test_the_live_view_joins_users_that_stand_still(spark, folder):
    raw, users = fx.raw_records(spark, SF_DIR), fx.users(spark, SF_DIR)
    raw.write.parquet(folder + "/raw")
    view = live_view(read_requests(spark, folder + "/raw", RAW_SCHEMA, stream=True), users)
    assert view.isStreaming
    (view.writeStream.format("memory").queryName("seen").trigger(**NOW).start().awaitTermination())
    want = display_view(with_username(routed_rows(raw).drop("items", "is_web"), users))
    assert sorted(map(str, spark.table("seen").collect())) == sorted(map(str, want.collect()))
    off = live_view(raw, users, Settings(enabled=False))
    assert {r["action"] for r in off.select("action").distinct().collect()} == {"Cli"}
