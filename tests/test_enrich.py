"""User names and object snapshots, by broadcast and by shuffle, with hot keys."""

import json

import pytest

from changetrail.operators import enrich
from changetrail.operators.lookups import join_dimension, measured_bytes

HOST = "id long, site_id int, description string, hostname string, status int, " \
       "status_fail_date string, status_rec_date string"


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "host": spark.createDataFrame(
            [(1, 5, 'a "quoted" é/b', "h1", 3, None, "2024"), (2, 6, "b", "h2", 0, "x", None)],
            HOST),
        "automation_devices": spark.createDataFrame(
            [(1, 9, "d", "10.0.0.1", "sys", "loc", 1, 1), (2, 9, "e", None, None, None, 0, None)],
            "id long, network_id int, hostname string, ip string, sysName string, "
            "syslocation string, snmp int, up int"),
        "data_template_data": spark.createDataFrame(
            [(7, "z", "on"), (7, "a", ""), (8, "m", None)],
            "local_data_id long, name_cache string, active string"),
        "user_auth": spark.createDataFrame([(1, "bea")], "id long, username string"),
    }


def snapshot(spark, tables, page, items, **options):
    events = spark.createDataFrame([(1, page, items, "kept")],
                                   "event_id long, page string, items array<long>, note string")
    rows = enrich.snapshot_objects(events, tables, **options).collect()
    assert len(rows) == 1 and rows[0]["note"] == "kept" and rows[0]["items"] == items
    return json.loads(rows[0]["object_data"])


@pytest.mark.parametrize("limit", [10**9, 0])
def test_snapshots(spark, tables, limit):
    def shot(page, items):
        return snapshot(spark, tables, page, items, broadcast_limit=limit)

    host1 = {"host_id": 1, "site_id": 5, "description": 'a "quoted" é/b', "hostname": "h1",
             "status": 3, "last_failed_date": None, "last_recovered_date": "2024"}
    assert shot("host.php", [1, 404, 1]) == [[host1], [], [host1]]
    assert shot("automation_devices.php", [2]) == [[{
        "id": 2, "network_id": 9, "hostname": "e", "ip": None, "sysName": None,
        "syslocation": None, "snmp": "Down", "up": "No"}]]
    assert shot("data_sources.php", [8, 7]) == [
        [{"Data_Source_Name": "m", "active": None}],
        [{"Data_Source_Name": "a", "active": ""}, {"Data_Source_Name": "z", "active": "on"}]]
    assert shot("user_admin.php", [None, 1]) == [[], [{"username": "bea"}]]
    # a known page whose table was not given must not look like deleted entities
    with pytest.raises(Exception, match="no entity table given for page thold.php"):
        shot("thold.php", [1, 2])
    # an unknown page, and no items
    assert shot("links.php", [1]) == []
    assert shot(None, [1]) == []
    assert shot("host.php", []) == []
    assert shot("host.php", None) == []


def test_times_are_stored_as_text_in_utc(spark):
    table = spark.sql("""select 1L id, timestamp_ntz '2024-01-02 03:04:05.25' local,
        timestamp '2024-01-02 03:04:05+02:00' zoned, cast(null as timestamp) missing""")
    lookups = {"x.php": ("x", "id", (("local", "a"), ("zoned", "b"), ("missing", "c")), True)}
    assert snapshot(spark, {"x": table}, "x.php", [1], lookups=lookups) == [[
        {"a": "2024-01-02 03:04:05", "b": "2024-01-02 01:04:05", "c": None}]]


def test_item_order_is_kept_beyond_ten(spark, tables):
    items = [1, 2] * 15
    got = snapshot(spark, tables, "host.php", items)
    assert [r[0]["host_id"] for r in got] == items


def test_a_table_name_can_be_changed(spark):
    lookups = {"graph_templates.php": ("graph_template", "id", (("name", "name"),), True)}
    tables = {"graph_template": spark.createDataFrame([(1, "t")], "id long, name string")}
    assert snapshot(spark, tables, "graph_templates.php", [1], lookups=lookups) == [[{"name": "t"}]]
    with pytest.raises(ValueError):
        enrich.entity_rows({}, lookups)


def test_hot_item_and_hot_user_lose_nothing(spark):
    """A third of the events share one item and one user; both ways of joining agree."""
    events = spark.range(3000).selectExpr(
        "id as event_id", "'user_admin.php' as page",
        "array(if(id % 3 = 0, 1, id), id % 50) as items", "if(id % 3 = 0, 1, id % 700) as user_id")
    users = spark.range(600).selectExpr("id", "concat('u', id) as username")
    both = []
    for limit in (10**9, 0):
        shots = enrich.snapshot_objects(events, {"user_auth": users}, broadcast_limit=limit)
        named = enrich.with_username(shots, users, id_column="event_id", broadcast_limit=limit)
        both.append(sorted(map(tuple, named.select(
            "event_id", "object_data", "username").collect())))
    assert both[0] == both[1] and len(both[0]) == 3000
    assert both[0][3] == (3, '[[{"username":"u1"}],[{"username":"u3"}]]', "u1")
    assert both[0][650][2] is None


def test_shuffled_join_spreads_a_hot_key(spark):
    facts = spark.range(8000).selectExpr("id", "1 as k")
    dim = spark.createDataFrame([(1, "v")], "k int, v string")
    joined = join_dimension(facts, dim, ["k"], "id", broadcast_limit=0, salt_buckets=16)
    plan = joined._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "_salt" in plan
    assert joined.filter("v = 'v'").count() == 8000
    assert joined.columns == ["k", "id", "v"]


def test_size_is_measured(spark):
    small = spark.createDataFrame([(1, "ab"), (2, None)], "id int, name string")
    assert measured_bytes(small) == 2 * 64 + 2 + 2
    assert measured_bytes(small.limit(0)) == 0


def test_device_flags(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (None, None), (2, 2)], "snmp int, up int")
    assert [tuple(r) for r in enrich.decode_device_flags(df).collect()] == [
        ("UP", "Yes"), ("Down", "No"), ("Down", "No"), ("Down", "No")]
