"""Filters, facets, sorting and paging."""

import datetime as dt
import random

import pytest
from tables import new_log

from changetrail.operators import search
from changetrail.operators.maintain import evolve_schema
from changetrail.operators.paging import slice_sorted
from changetrail.operators.search import EventFilter, days_of_slice, like_pattern, list_events
from changetrail.schemas import LOG_SCHEMA

START = dt.datetime(2024, 1, 1)


def log_of(spark, rows):
    names = LOG_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LOG_SCHEMA)


@pytest.fixture(scope="module")
def events(spark):
    """300 events; a third share one second, some have no time, users 0-4 and one unknown."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        time = (START + dt.timedelta(days=3, seconds=30) if i % 3 == 0
                else None if i % 50 == 1
                else START + dt.timedelta(seconds=rng.randrange(9 * 86400)))
        rows.append({"id": i, "page": rng.choice(["host.php", "HOST.php", "a_b.php", None]),
                     "user_id": rng.choice([0, 1, 2, 3, 4, 99]), "action": "save",
                     "user_agent": f"agent-{i % 4}", "ip_address": f"10.0.0.{i % 9}",
                     "event_time": time, "post": f'{{"k":"{i}%","x":"50\\\\y"}}'})
    log = log_of(spark, rows).cache()
    return rows, log


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "bea"), (2, "al"), (3, "bea"), (4, "cy")],
                                 "id long, username string")


@pytest.fixture(scope="module")
def stored(spark, events, tmp_path_factory):
    store = new_log(spark, tmp_path_factory.mktemp("log"))
    store.append(events[1])
    return store


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("text, pattern", [
    ("a%b_", "%a%b_%"), ("50\\%", "%50\\%%"), ("a\\b", "%ab%"), ("a\\\\b", "%a\\\\b%"),
    ("x\\", "%x\\%")])
def test_like_pattern(text, pattern):
    assert like_pattern(text) == pattern


def test_search_modes(spark):
    log = log_of(spark, [
        {"id": 1, "page": "host.php", "post": "50%"}, {"id": 2, "page": "Host.php", "post": "500"},
        {"id": 3, "page": None, "post": "a\\b host"}, {"id": 4, "page": "x", "post": None}])
    def found(**kw):
        return sorted(ids(EventFilter(**kw).apply(log)))
    assert found() == [1, 2, 3, 4]
    assert found(search="host") == [1, 3]
    assert found(search="HOST", ignore_case=True) == [1, 2]
    assert found(search="50%") == [1, 2]
    assert found(search="50\\%") == [1]
    assert found(search="50%", literal=True) == [1]
    assert found(search="a\\\\b") == [3]
    assert found(search="a\\b", literal=True) == [3]
    assert found(search="a_b") == [3]
    assert found(page_name="host.php") == [1]
    assert found(page_name="-1") == [1, 2, 3, 4]


def test_user_zero_is_a_filter_and_minus_one_is_none(events):
    rows, log = events
    assert sorted(ids(EventFilter(user_id=0).apply(log))) == [
        r["id"] for r in rows if r["user_id"] == 0]
    assert EventFilter(user_id=-1).apply(log).count() == 300


def brute_force(rows, names, column, descending):
    def key(r):
        value = names.get(r["user_id"]) if column == "username" else r[column]
        return (value is not None, value if value is not None else 0, r["id"]) \
            if value is not None else (False, 0, r["id"])
    return [r["id"] for r in sorted(rows, key=key, reverse=descending)]


NAMES = {1: "bea", 2: "al", 3: "bea", 4: "cy"}


@pytest.mark.parametrize("column, direction", [
    ("event_time", "DESC"), ("event_time", "ASC"), ("username", "ASC"), ("page", "DESC"),
    ("user_agent", "ASC")])
@pytest.mark.parametrize("shallow", [100_000, 0])
def test_pages_make_up_the_whole_sorted_list(events, users, column, direction, shallow):
    rows, log = events
    want = brute_force(rows, NAMES, column, direction == "DESC")
    got = []
    for page_no in range(1, 5):
        page = list_events(log, users, rows=85, page_no=page_no, sort_column=column,
                           sort_direction=direction, shallow_rows=shallow)
        got += ids(page)
    assert got == want


@pytest.mark.parametrize("column, direction", [
    ("event_time", "DESC"), ("event_time", "ASC"), ("username", "DESC")])
@pytest.mark.parametrize("shallow", [100_000, 10])
def test_a_stored_log_gives_the_same_pages(events, users, stored, column, direction, shallow):
    want = brute_force(events[0], NAMES, column, direction == "DESC")
    for page_no in (1, 3, 6, 11, 12):
        page = stored.list_events(users, rows=29, page_no=page_no, sort_column=column,
                                  sort_direction=direction, shallow_rows=shallow)
        assert page.columns == [*LOG_SCHEMA.fieldNames(), "username"]
        assert ids(page) == want[29 * (page_no - 1):29 * page_no]


def test_large_pages_of_a_stored_log(events, users, stored, monkeypatch):
    monkeypatch.setattr(search, "LITERAL_KEYS", 10)
    want = brute_force(events[0], NAMES, "event_time", True)
    assert ids(stored.list_events(users, rows=120, page_no=2)) == want[120:240]


def test_stored_page_with_filters(events, users, stored):
    where = EventFilter(search="7", user_id=1)
    want = [i for i in brute_force(events[0], NAMES, "event_time", True)
            if events[0][i]["user_id"] == 1 and "7" in events[0][i]["post"]]
    assert ids(stored.list_events(users, where, rows=100)) == want


def test_count_and_days(events, stored):
    rows, log = events
    where = EventFilter(user_id=2)
    count = search.count_events(log, where).first()["events"]
    per_day = search.events_per_day(where.apply(stored.read())).collect()
    assert count == sum(r["events"] for r in per_day) == sum(r["user_id"] == 2 for r in rows)


def test_days_of_slice():
    d1, d2, d3 = (dt.date(2024, 1, n) for n in (1, 2, 3))
    per_day = {d1: 10, d2: 5, d3: 10, None: 2}
    assert days_of_slice(per_day, True, 0, 5) == ([d3], 0)
    assert days_of_slice(per_day, True, 10, 5) == ([d2], 0)
    assert days_of_slice(per_day, True, 9, 7) == ([d3, d2, d1], 9)
    assert days_of_slice(per_day, True, 24, 9) == ([d1, None], 9)
    assert days_of_slice(per_day, False, 0, 3) == ([None, d1], 0)
    assert days_of_slice(per_day, True, 27, 5) == ([], 0)
    assert days_of_slice({}, True, 0, 5) == ([], 0)


def test_past_the_end_and_wrong_arguments(events, users, stored):
    log = events[1]
    assert ids(list_events(log, users, rows=100, page_no=9)) == []
    assert ids(stored.list_events(users, rows=100, page_no=9)) == []
    for wrong in ({"sort_column": "post"}, {"sort_column": "1; drop"}, {"sort_direction": "UP"},
                  {"page_no": 0}, {"rows": 0}):
        with pytest.raises(ValueError):
            list_events(log, users, **wrong)


def test_default_number_of_rows(events, users):
    assert len(ids(list_events(events[1], users))) == 30


def test_deep_slices_split_a_value_held_by_a_third(events):
    want = brute_force(events[0], NAMES, "event_time", False)
    got = ids(slice_sorted(events[1], "event_time", False, 40, 120, shallow_rows=0))
    assert got == want[40:160]


def test_event_by_id(events, stored):
    assert ids(search.event_by_id(events[1], 17)) == [17]
    day = events[0][17]["event_time"].date()
    assert ids(search.event_by_id(stored.read(), 17, day)) == [17]
    assert ids(search.event_by_id(stored.read(), 17, dt.date(2023, 1, 1))) == []


def test_facets(spark, users):
    log = log_of(spark, [{"id": i, "page": p, "user_id": u} for i, (p, u) in enumerate(
        [("b", 0), ("a", 2), ("b", 2), (None, 77), ("a", 1)])])
    assert [r["page"] for r in search.page_facet(log).collect()] == [None, "a", "b"]
    assert [tuple(r) for r in search.user_facet(log, users).collect()] == [
        (1, "bea"), (2, "al"), (77, None)]


def test_display_view(spark, users):
    log = log_of(spark, [
        {"id": 1, "page": "p", "user_id": 0, "action": "cli", "user_agent": "root"},
        {"id": 2, "page": "p", "user_id": 1, "action": "save it", "user_agent": "fox",
         "event_time": dt.datetime(2024, 1, 2, 3, 4, 5, 600000)}])
    shown = search.display_view(list_events(evolve_schema(log), users, sort_column="page",
                                            sort_direction="ASC")).collect()
    assert [tuple(r)[2:5] for r in shown] == [("root", "Cli", "N/A"), ("bea", "Save it", "fox")]
    assert shown[1]["event_time"] == "2024-01-02 03:04:05"
