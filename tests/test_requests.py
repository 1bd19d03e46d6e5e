"""Admission, classification and normalisation, one row per rule and boundary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail.functions import requests as R
from changetrail.functions.item_lists import decode_item_list
from changetrail.operators import ingest
from changetrail.schemas import LOG_SCHEMA, REQUEST_SCHEMA, WEB_REQUEST_SCHEMA
from changetrail.settings import Settings
from changetrail.sources.readers import with_request_fields

TIME = dt.datetime(2024, 1, 2, 3, 4, 5, 987654)


def requests(spark, *rows):
    names = REQUEST_SCHEMA.fieldNames()
    base = {"has_post": False, "purge_continue": False, "has_items": False, "params": "{}",
            "event_time": TIME}
    data = [tuple({**base, "req_id": i, **row}.get(n) for n in names)
            for i, row in enumerate(rows)]
    return spark.createDataFrame(data, REQUEST_SCHEMA)


ADMISSION = [
    # script, fields, admitted, preset action
    ("/x/graph_view.php", {"has_post": True}, False, None),
    ("/x/user_admin.php", {"has_post": True, "req_action": "checkpass"}, False, None),
    ("/x/user_admin.php", {"has_post": True, "req_action": "save"}, True, None),
    ("/x/user_admin.php", {"has_post": True}, True, None),
    ("/x/host.php", {"has_post": True, "req_action": "checkpass"}, True, None),
    ("/x/plugins.php", {"has_post": True}, False, None),
    ("/x/plugins.php", {"mode_arg": "install"}, True, "install"),
    ("/x/plugins.php", {"mode_arg": ""}, True, ""),
    ("/x/plugins.php", {"purge_continue": True}, False, None),
    ("/x/auth_profile.php", {"has_post": True}, False, None),
    ("/x/index.php", {"has_post": True, "purge_continue": True}, False, None),
    ("/x/auth_changepassword.php", {"has_post": True}, False, None),
    ("/x/utilities.php", {"has_post": True, "purge_continue": True}, True, None),
    ("/x/utilities.php", {"purge_continue": True}, True, "purge"),
    ("/x/utilities.php", {}, False, None),
    ("/x/utilities.php", {"purge_continue": None, "has_post": None}, False, None),
    # substring tests look at the whole path
    ("/graph_view.php/host.php", {"has_post": True}, False, None),
    ("/x/my_plugins.php", {"mode_arg": "m"}, True, "m"),
]


def test_admission_rules(spark):
    df = requests(spark, *[{"script_name": s, **f} for s, f, _, _ in ADMISSION])
    found = {r["req_id"]: r["preset_action"] for r in ingest.admit_requests(df).collect()}
    expected = {i: preset for i, (_, _, ok, preset) in enumerate(ADMISSION) if ok}
    assert found == expected


def test_the_setting_gates_web_requests_only(spark):
    df = requests(spark, {"script_name": "/x/host.php", "has_post": True})
    assert ingest.admit_requests(df, enabled=False).count() == 0
    both = df.withColumn("argv", F.array(F.lit("/a/tool.php")))
    web, cli = ingest.split_routes(both, enabled=False)
    assert (web.count(), cli.count()) == (0, 1)
    web, cli = ingest.split_routes(both)
    assert (web.count(), cli.count()) == (1, 0)


ACTIONS = [
    # page, drp_action, has_items, preset, request action, result
    ("automation_devices.php", "2", True, None, "save", "Delete Device"),
    ("automation_devices.php", "1", True, None, "save", "Create Device"),
    ("automation_devices.php", "1", False, None, "save", "delete"),
    ("automation_devices.php", "2", False, None, "save", "save"),
    ("automation_devices.php", "2", None, None, "save", "save"),
    ("host.php", "2", True, None, "save", "Host Enabled"),
    ("host.php", "3", True, None, "save", "Host Disabled"),
    ("host.php", "1", True, None, "save", "delete"),
    ("host.php", "4", True, None, "save", "disable"),
    ("host.php", "2", False, None, None, "none"),
    ("data.php", "1", False, "install", "save", "delete"),
    ("data.php", "04", False, None, "save", "disable"),
    ("data.php", "5", True, "install", "save", "install"),
    ("data.php", "x", False, "purge", "save", "purge"),
    ("data.php", None, False, "", "save", "save"),
    ("data.php", None, False, "0", "save", "save"),
    ("data.php", None, False, None, "", ""),
    ("data.php", None, False, "0", None, "none"),
]


def test_action_precedence(spark):
    df = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(ACTIONS)],
        "i int, page string, drp string, items boolean, preset string, req string, want string")
    out = df.select("i", "want", R.classify_action(
        F.col("page"), F.col("drp"), F.col("items"), F.col("preset"), F.col("req")).alias("got"))
    assert [r for r in out.collect() if r["want"] != r["got"]] == []


@pytest.mark.parametrize("argv0, kept", [
    ("/opt/cli/add_device.php", True), ("/opt/poller.php", False), ("poller_x", False),
    ("/opt/cmd.php", False), ("/opt/scripts/a.php", False), ("scripts/a.php", True),
    ("/opt/script_server.php", False), ("/opt/boost_process.php", False),
    ("/opt/process.php", True)])
def test_background_commands_are_left_out(spark, argv0, kept):
    df = spark.createDataFrame([([argv0, "a"],)], "argv array<string>")
    assert (ingest.admit_commands(df).count() == 1) is kept


def test_command_rows(spark):
    df = spark.createDataFrame(
        [(7, ["/opt/cli/add.php", "--password=x", "y"], "10.0.0.1", "root", TIME)],
        "event_id long, argv array<string>, host_ip string, os_user string, "
        "event_time timestamp_ntz")
    row = ingest.command_events(df).first()
    assert row.asDict() == {
        "id": 15, "page": "add.php", "user_id": 0, "action": "cli", "ip_address": "10.0.0.1",
        "user_agent": "root", "event_time": TIME.replace(microsecond=0),
        "post": "/opt/cli/add.php --password=x y", "object_data": None}


def test_web_rows_without_snapshot(spark):
    df = requests(
        spark,
        {"script_name": "/x/links.php", "has_post": True, "user_id": None,
         "params": '{"a":"1","password":"p"}', "http_xff": "2.2.2.2, 9.9.9.9",
         "remote_addr": "3.3.3.3", "user_agent": "browser"},
        {"script_name": "/x/links.php", "has_post": True, "user_id": 9, "xff": "",
         "params": '{"password":"p"}', "remote_addr": "3.3.3.3"})
    tables = {"host": spark.createDataFrame(
        [], "id long, site_id int, description string, hostname string, status int, "
            "status_fail_date string, status_rec_date string")}
    out = ingest.web_events(df, tables).orderBy("id").collect()
    assert out[0].asDict() == {
        "id": 0, "page": "links.php", "user_id": 0, "action": "none",
        "ip_address": "2.2.2.2, 9.9.9.9", "user_agent": "browser",
        "event_time": TIME.replace(microsecond=0), "post": '{"a":"1"}', "object_data": "[]"}
    assert (out[1]["ip_address"], out[1]["post"], out[1]["user_agent"]) == ("", "[]", None)
    assert ingest.web_events(df, tables, Settings(enabled=False)).count() == 0


def test_time_defaults_to_now(spark):
    df = requests(spark, {"script_name": "/x/a.php", "has_post": True}).drop("event_time")
    time = ingest.normalise_requests(ingest.admit_requests(df)).first()["event_time"]
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert time.microsecond == 0 and abs(now - time) < dt.timedelta(minutes=5)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        gap = dt.datetime(2024, 3, 31, 2, 30, 0, 5)    # does not exist in Berlin
        df = spark.createDataFrame([(gap,)], "t timestamp_ntz")
        row = df.select(R.whole_seconds(F.col("t")).alias("t"),
                        R.time_text(F.col("t")).alias("s")).first()
        assert row["t"] == gap.replace(microsecond=0)
        assert row["s"] == "2024-03-31 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_small_text_functions(spark):
    df = spark.createDataFrame([("/a/b.php",), ("b.php",), ("/a/b/",), ("",)], "p string")
    names = [r[0] for r in df.select(R.page_name(F.col("p"))).collect()]
    assert names == ["b.php", "b.php", "b", ""]
    df = spark.createDataFrame([("host Disabled by",), ("",), ("é",), (None,)], "p string")
    assert [r[0] for r in df.select(R.upper_first(F.col("p"))).collect()] == [
        "Host Disabled by", "", "É", None]


@pytest.mark.parametrize("text, ids", [
    ('a:3:{i:0;s:2:"12";i:1;s:1:"5";i:2;i:7;}', [12, 5, 7]), ("a:0:{}", []), ("junk", None), (None, None),
    ('a:1:{i:0;s:30:"123456789012345678901234567890";}', [None]),   # no object has such an id
    ('a:1:{i:0;s:0:"";}', [None]), ('a:2:{s:3:"é1";i:4;i:1;s:2:"-3";}', [4, -3]),
    ('["5","12"]', [5, 12]), ("[7, 1]", [7, 1]), ("[]", []), ("5", None), ('["5",""]', [5, None]),
    # A nested list, texts that look like entries, wrong lengths and counts: not taken in part.
    ('a:2:{i:0;s:1:"5";i:1;a:1:{i:0;i:7;}}', None), ("[[7]]", None), ('["5","x"]', None),
    ('a:1:{i:0;s:11:"x;i:0;i:9;}";}', None), ('a:1:{i:0;s:8:"i:0;i:9;";}', None),
    ('a:1:{i:0;s:1:"é";}', None), ('a:1:{i:0;s:9:"5";}', None), ('a:1:{i:0;s:1:"55";}', None),
    ("a:2:{i:0;i:7;}", None), ("a:1:{i:0;i:7;i:1;i:8;}", None), ("a:1:{i:0;i:7;}x", None),
    ("a:1:{i:0;i:7;", None), ("a:1:{i:0;b:1;}", None), ("a:1:{i:0;N;}", None), ("a:1:{i:0;d:1.5;}", None),
    ("a:999999999:{}", None), ('O:1:"x":0:{}', None), ('["5"', None)])
def test_item_lists_are_taken_whole_or_not_at_all(spark, text, ids):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_item_list(F.col("t"))).first()[0] == ids


def test_a_long_item_list(spark):
    n = 3000
    text = f"a:{n}:{{" + "".join(f'i:{i};s:{len(str(i))}:"{i}";' for i in range(n)) + "}"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_item_list(F.col("t"))).first()[0] == list(range(n))


def test_steering_fields_come_from_the_parameters(spark):
    params = ['{"action":"save","drp_action":"1","selected_items":"a:1:{i:0;s:1:\\"4\\";}"}',
              '{"mode":"install","purge_continue":""}', "not json"]
    schema = T.StructType([f for f in WEB_REQUEST_SCHEMA if f.name in ("req_id", "params")])
    df = spark.createDataFrame(list(enumerate(params)), schema)
    out = with_request_fields(df).orderBy("req_id").drop("params").collect()
    assert [tuple(r) for r in out] == [
        (0, "save", None, "1", False, True, [4]),
        (1, None, "install", None, True, False, None),
        (2, None, None, None, False, False, None)]
    given = with_request_fields(df.withColumn("req_action", F.lit("own")))
    assert {r["req_action"] for r in given.collect()} == {"own"}


def test_log_rows_have_the_log_schema(spark):
    df = requests(spark, {"script_name": "/x/a.php", "has_post": True, "user_id": 1})
    tables = {"user_auth": spark.createDataFrame([(1, "u")], "id long, username string")}
    kinds = {f.name: f.dataType for f in ingest.web_events(df, tables).schema}
    assert kinds == {f.name: f.dataType for f in LOG_SCHEMA}
