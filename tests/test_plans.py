"""Physical plans: what is pushed down, pruned, broadcast and shuffled."""

import datetime as dt
from unittest.mock import Mock

import pytest
from tables import SF_DIR, new_log

import __spark_entry__ as driver
from changetrail.operators import maintain, search
from changetrail.operators.checkpoints import shared_folder
from changetrail.operators.search import EventFilter
from changetrail.plans import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = new_log(spark, tmp_path_factory.mktemp("plans"))
    store.append(maintain.evolve_schema(fx.activity_log(spark, SF_DIR)))
    return store


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in text


def test_filters_reach_the_scan(stored):
    log = stored.read()
    text = plan(search.event_by_id(log, 5))
    assert "EqualTo(id,5)" in text
    text = plan(EventFilter(search="ab", user_id=3, page_name="x").apply(log))
    for pushed in ("StringContains(page,ab)", "EqualTo(user_id,3)", "EqualTo(page,x)"):
        assert pushed in text
    text = plan(maintain.expire_events(log, dt.datetime(2024, 1, 31), 14))
    assert "GreaterThanOrEqual(event_time" in text
    partition_filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partition_filters


def test_counting_reads_no_wide_column(stored):
    text = plan(search.count_events(stored.read(), EventFilter(user_id=3)))
    assert "post" not in text and "object_data" not in text and "Join" not in text


def test_the_page_is_taken_before_names_are_joined(spark):
    text = plan(driver.queries()["list_events"](spark, SF_DIR))
    assert text.index("BroadcastHashJoin") < text.index("TakeOrderedAndProject")


@pytest.mark.parametrize("name", ["list_events", "list_second_page", "list_by_username_asc"])
def test_a_page_near_the_start_takes_one_scan(spark, name):
    text = plan(driver.queries()[name](spark, SF_DIR))
    assert text.count("FileScan parquet") == 2       # the log and the users
    assert text.count("events.parquet") == 1


def test_a_deep_page_is_not_carried_whole(spark):
    text = plan(search.list_events(fx.activity_log(spark, SF_DIR), fx.users(spark, SF_DIR), rows=100, page_no=40))
    assert text.count("events.parquet") == 2


def test_a_stored_page_is_fetched_by_day_time_and_id(spark, stored):
    text = plan(stored.list_events(fx.users(spark, SF_DIR), rows=20))
    assert "event_date=2024-01-30" in text and "event_date=2024-01-29" not in text
    assert "GreaterThanOrEqual(event_time" in text and "PartitionFilters: [isnotnull(event_date" in text


def test_snapshots_shuffle_by_event_only_when_tables_fit_in_a_broadcast(spark):
    events = spark.range(10).selectExpr("id as event_id", "'host.php' as page",
                                        "array(id) as items")
    from changetrail.operators.enrich import snapshot_objects
    tables = {"host": fx.entity_tables(spark, SF_DIR)["host"]}
    text = plan(snapshot_objects(events, tables))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text   # a range is dealt by id


def test_snapshots_read_the_source_twice(spark):
    text = plan(driver.queries()["snapshot_objects"](spark, SF_DIR))
    assert text.count("orders.parquet") == 2         # events without a lookup, and those with one
    assert text.count("Exchange hashpartitioning(_id") == 1 and "SortMergeJoin" not in text


def test_checkpoints_go_where_the_session_says(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


@pytest.mark.parametrize("master, fails", [("local[2]", False), ("local", False), ("spark://host:7077", True),
                                           ("local-cluster[2,1,1024]", True)])
def test_only_a_local_master_gets_a_temporary_folder(master, fails):
    session = Mock()
    session.conf.get.return_value = None
    session.sparkContext.master = master
    session.sparkContext.getCheckpointDir.return_value = None
    if fails:
        with pytest.raises(ValueError):
            shared_folder(session)
    else:
        session.sparkContext.setCheckpointDir.assert_not_called()
        session.sparkContext.setCheckpointDir.side_effect = lambda folder: None
        assert shared_folder(session)
        session.sparkContext.setCheckpointDir.assert_called_once()
