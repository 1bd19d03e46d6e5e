"""The stored log: appending, retention, purge, schema upkeep and export."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tables import new_log

from changetrail.operators import detail, export, maintain
from changetrail.schemas import LOG_SCHEMA, STORED_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.files import folder_exists
from changetrail.sources.log_table import LogTable, append_json_log
from test_search import log_of

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


def some_events(spark, n=60):
    times = [dt.datetime(2024, 1, 1, 12) + dt.timedelta(hours=12 * i) for i in range(n)]
    return log_of(spark, [{"id": i, "page": "p", "event_time": t} for i, t in enumerate(times)]
                  + [{"id": 1000, "page": "p", "event_time": None}])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_append_is_idempotent_per_batch(spark, folder):
    store = new_log(spark, folder)
    events = some_events(spark)
    store.append(events, "b1")
    store.append(events, "b1")
    assert ids(store.read()) == ids(events)
    store.append(events.filter("id < 3"), "b2")
    assert store.read().count() == 64
    store.append(events.filter("id = 5"))
    assert store.read().count() == 65


def test_reading_some_days(spark, folder):
    store = new_log(spark, folder)
    store.append(some_events(spark))
    day = dt.date(2024, 1, 3)
    assert ids(store.read([day])) == [3, 4]
    assert ids(store.read([None, dt.date(1999, 1, 1)])) == [1000]
    assert ids(store.read([])) == []
    assert store.days()[:2] == [None, dt.date(2024, 1, 1)] and len(store.days()) == 32


def test_retention_keeps_from_the_cutoff_on(spark, folder):
    store = new_log(spark, folder)
    store.append(some_events(spark))
    assert store.expire(NOW, 0) == 0 and store.expire(NOW, -1) == 0
    assert store.read().count() == 61
    purged = store.expire(NOW, 14)
    assert purged == 32                              # everything before 17 January, noon
    assert ids(store.read()) == [*range(32, 60), 1000]
    days = {d for d in os.listdir(folder + "/activity_log") if d.startswith("event_date")}
    assert all(not os.listdir(f"{folder}/activity_log/{d}") for d in days if "2024-01-16" in d)
    assert store.expire(NOW, 14) == 0                # running it again changes nothing
    assert store.expire(NOW, 90) == 0                # a longer retention brings nothing back
    assert ids(store.read()) == [*range(32, 60), 1000]
    assert store.days()[:2] == [None, dt.date(2024, 1, 17)]
    # No state beside the events.
    assert {d for d in os.listdir(folder)} == {"activity_log"}
    assert not folder_exists(spark, store._staging)


def test_retention_does_not_hide_later_events(spark, folder):
    store = new_log(spark, folder)
    store.append(some_events(spark))
    store.expire(NOW, 14)
    late = some_events(spark).withColumn("id", F.col("id") + 5000)
    store.append(late, "late")
    assert ids(store.read()) == sorted([*range(32, 60), 1000, *ids(late)])
    assert store.expire(NOW, 14) == 32               # the next run removes them
    assert ids(store.read()) == sorted([*range(32, 60), 1000, *range(5032, 5060), 6000])


def day_of_the_cut(spark):
    """Events every hour, in batches of which the cut at noon of 17 January leaves all, some or nothing."""
    times = [dt.datetime(2024, 1, 16, 18) + dt.timedelta(hours=i) for i in range(36)]
    events = log_of(spark, [{"id": i, "page": "p", "event_time": t} for i, t in enumerate(times)])
    kept = [i for i, t in enumerate(times) if t >= dt.datetime(2024, 1, 17, 12)]
    return events, kept


class Killed(Exception):
    pass


def killed(*_):
    raise Killed


@pytest.mark.parametrize("lost", [False, True])
def test_a_run_killed_between_staging_and_overwrite_is_made_up_for(spark, folder, monkeypatch, lost):
    store = new_log(spark, folder)
    events, kept = day_of_the_cut(spark)
    for name, where in (("early", "id < 12"), ("cut", "id between 12 and 24"), ("late", "id > 24")):
        store.append(events.filter(where), name)
    write_back, done = LogTable._write_back, []

    def killed_once_staged(table):
        if not done:
            done.append(1)                           # nothing is staged when a run begins
            return write_back(table)
        raise Killed

    monkeypatch.setattr(LogTable, "_write_back", killed_once_staged)
    with pytest.raises(Killed):
        store.expire(NOW, 14)
    monkeypatch.undo()
    assert folder_exists(spark, store._staging)
    if lost:
        # As if the overwrite had removed the old files, and had not put the new ones in their place.
        store._drop([(dt.date(2024, 1, 17), "cut")])
    store.append(events.filter("id = 13").withColumn("id", F.lit(777)), "meanwhile")
    again = store.expire(NOW, 14)
    assert again == 1                                # what came meanwhile; the rest was done
    assert ids(store.read()) == kept
    assert not folder_exists(spark, store._staging)
    assert store.expire(NOW, 14) == 0


def test_a_run_killed_while_staging_starts_anew(spark, folder, monkeypatch):
    store = new_log(spark, folder)
    events, kept = day_of_the_cut(spark)
    store.append(events, "b")
    monkeypatch.setattr(LogTable, "_stage", killed)
    with pytest.raises(Killed):
        store.expire(NOW, 14)
    monkeypatch.undo()
    # Half a staging: files, but no mark of Spark's that they are all.
    store.read().limit(1).write.parquet(store._staging)
    os.remove(store._staging.removeprefix("file:") + "/_SUCCESS")
    store.expire(NOW, 14)
    assert ids(store.read()) == kept


def test_what_is_staged_does_not_outlive_a_purge(spark, folder, monkeypatch):
    store = new_log(spark, folder)
    events, _ = day_of_the_cut(spark)
    store.append(events, "b")
    store._stage(store.read())
    store.purge("bea")
    store.append(events.filter("id = 30"), "c")
    store.expire(NOW, 14)
    assert ids(store.read()) == [30]


def test_purge_forgets_the_retention_and_notes_who(spark, folder):
    store = new_log(spark, folder)
    store.append(some_events(spark))
    store.expire(NOW, 14)
    store.purge("bea")
    store.append(some_events(spark))
    assert store.read().count() == 61
    store.purge()
    notes = store.purges().orderBy("purged_at", F.desc("actor")).collect()
    assert [(note["actor"], note["events"]) for note in notes] == [("bea", 29), ("", 61)]


def test_pages_of_a_log_of_both_sources_agree_on_every_path(spark, folder):
    web = some_events(spark).withColumn("id", F.col("id") * 2)
    store = new_log(spark, folder)
    store.append(web.unionByName(some_events(spark).withColumn("id", F.col("id") * 2 + 1)))
    users = spark.createDataFrame([(i, f"u{i % 3}") for i in range(5)], "id long, username string")
    for sort in ("event_time", "page", "username"):
        whole = [r["id"] for r in store.list_events(users, rows=500, sort_column=sort).collect()]
        assert len(whole) == len(set(whole)) == 122
        for options in ({}, {"shallow_rows": 0}):
            for rows, page in ((7, 3), (30, 2), (2000, 1)):
                got = [r["id"] for r in store.list_events(users, rows=rows, page_no=page, sort_column=sort,
                                                          **options).collect()]
                assert got == whole[rows * (page - 1):rows * page], (sort, options, rows)


def test_kept_and_purged_make_up_the_log(spark):
    events = some_events(spark)
    for days in (1, 14, 29, 400):
        kept = maintain.expire_events(events, NOW, days).count()
        purged = maintain.purged_count(events, NOW, days).first()["purged"]
        assert kept + purged == 61
    assert maintain.purged_count(events, NOW, 0).first()["purged"] == 0


def test_purge(spark, folder):
    store = new_log(spark, folder)
    store.append(some_events(spark), "b")
    store.purge()
    assert store.read().count() == 0 and store.read().columns == STORED_SCHEMA.fieldNames()
    assert store.exists() and store.days() == []
    store.append(some_events(spark), "b")
    assert store.read().count() == 61


def test_ensure_and_clone(spark, folder):
    store = new_log(spark, folder).ensure()
    assert store.read().count() == 0
    store.append(some_events(spark))
    assert store.ensure().read().count() == 61
    clone = store.clone_schema(store.name + "_remote")
    assert clone.read().schema == store.read().schema and clone.read().count() == 0
    clone.append(some_events(spark).filter("id < 2"), "b")
    clone.append(some_events(spark).filter("id < 2"), "b")   # a clone replaces batches too
    assert store.clone_schema(clone.name).read().count() == 2


def test_a_log_from_before_a_column_was_added(spark, folder):
    store = new_log(spark, folder)
    old = T.StructType([f for f in LOG_SCHEMA if f.name != "object_data"])
    store.ensure(old).append(some_events(spark).drop("object_data"), "old")
    assert "object_data" not in spark.table(store.name).columns
    assert store.read().filter("object_data is null").count() == 61
    store.append(some_events(spark).withColumn("object_data", F.lit("[]")), "new")
    assert "object_data" in spark.table(store.name).columns
    by_batch = {r["batch"]: r["n"] for r in store.read().groupBy("batch").agg(
        F.count("object_data").alias("n")).collect()}
    assert by_batch == {"old": 0, "new": 61}
    store.append(some_events(spark).drop("object_data"), "later")
    assert store.read().count() == 183
    assert maintain.evolve_schema(some_events(spark).drop("object_data")).columns == LOG_SCHEMA.fieldNames()


def test_overlong_values_are_reported_and_kept(spark):
    log = log_of(spark, [{"id": 1, "page": "p" * 41, "action": "a" * 20},
                         {"id": 2, "page": "p" * 40, "action": "a" * 21, "user_agent": "u" * 999}])
    assert tuple(maintain.overlong_values(log).first()) == (1, 1, 0, 1)


def test_json_log(spark, folder):
    events = log_of(spark, [{"id": 1, "page": "p", "user_id": 3, "action": "save",
                             "event_time": dt.datetime(2024, 1, 2, 3, 4, 5),
                             "post": '{"a":"é"}', "object_data": '[[{"n":null}]]'}])
    assert not append_json_log(events, Settings(), "b")
    assert not append_json_log(events, Settings(json_log_enabled=True), "b")
    missing = Settings(json_log_enabled=True, json_log_path=folder + "/none")
    assert not append_json_log(events, missing, "b")
    ready = Settings(json_log_enabled=True, json_log_path=folder)
    assert append_json_log(events, ready, "b") and append_json_log(events, ready, "b")
    assert append_json_log(events, ready, "c")
    lines = [json.loads(r["value"]) for r in spark.read.text(folder).collect()]
    assert lines == [{"page": "p", "user_id": 3, "action": "save", "ip_address": None,
                      "user_agent": None, "event_time": "2024-01-02 03:04:05",
                      "post": '{"a":"é"}', "object_data": '[[{"n":null}]]'}] * 2


def exported(spark):
    users = spark.createDataFrame([(1, "bea")], "id long, username string")
    log = log_of(spark, [
        {"id": 1, "page": "p", "user_id": 1, "action": "save", "ip_address": "1, 2",
         "user_agent": 'a "b"', "event_time": dt.datetime(2024, 1, 2, 3, 4, 5),
         "post": '{"a":["1","2"],"b":"x"}'},
        {"id": 2, "page": "q", "user_id": 5, "action": "cli", "post": "/a/b.php --x"}])
    return export.export_events(log, users)


def test_legacy_export_is_one_file_in_parts(spark, folder):
    export.write_export(exported(spark), folder + "/out", fmt="legacy")
    parts = sorted(p for p in os.listdir(folder + "/out") if p.startswith("part-"))
    text = "".join(open(f"{folder}/out/{p}").read() for p in parts)
    lines = text.splitlines()
    assert lines[0] == ("page, user_id, username, action, ip_address, user_agent, event_time, "
                        "post")
    assert sorted(lines[1:]) == [
        'p, 1, bea, save, 1, 2, a "b", 2024-01-02 03:04:05, a:1%2|b:x', "q, 5, , cli, , , , "]


def test_an_empty_export_has_no_header(spark, folder):
    export.write_export(exported(spark).limit(0), folder + "/out", fmt="legacy")
    assert spark.read.text(folder + "/out").count() == 0
    with pytest.raises(ValueError):
        export.write_export(exported(spark), folder + "/x", fmt="xml")


def test_csv_export_reads_back(spark, folder):
    out = exported(spark)
    export.write_export(out, folder + "/out")
    back = spark.read.schema(out.schema).csv(folder + "/out", header=True, escape='"')
    row = back.filter("page = 'p'").first()
    assert (row["ip_address"], row["user_agent"], row["post"]) == ("1, 2", 'a "b"', "a:1%2|b:x")
    cleaned = export.escape_fields(out).filter("page = 'p'").first()
    assert (cleaned["ip_address"], cleaned["user_agent"]) == ("1| 2", "a b")


def test_details(spark):
    keys = {f"k{i:02}": str(i) for i in range(17)}
    log = log_of(spark, [
        {"id": 1, "action": "save", "post": json.dumps(keys),
         "object_data": '[[{"name":"a"}],[],[{"n":1},{"n":null}]]'},
        {"id": 2, "action": "save", "post": '{"b":["1","2"],"a":true}', "object_data": "[]"},
        {"id": 3, "action": "cli", "post": '{"looks":"like json"}'},
        {"id": 4, "action": None, "post": "[]"}])
    rows = detail.event_attributes(log).collect()
    assert {r["id"]: r["wide"] for r in rows} == {1: True, 2: False}
    assert [(r["position"], r["attribute"], r["value"]) for r in rows if r["id"] == 2] == [
        (1, "a", "1"), (2, "b", "1,2")]
    objects = [(r["id"], r["position"], json.loads(r["record"]))
               for r in detail.event_objects(log).collect()]
    assert objects == [(1, 0, [{"name": "a"}]), (1, 1, []), (1, 2, [{"n": 1}, {"n": None}])]
    assert [r["script"] for r in detail.cli_detail(log).collect()] == ['{"looks":"like json"}']
