"""What searches and point lookups pass over: files by signatures, row groups by Bloom filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tables import new_log

from changetrail.operators import signatures
from changetrail.operators.search import EventFilter, event_by_id
from changetrail.sources.log_table import TABLE_OPTIONS, LogTable
from test_search import log_of

NEEDLES = ["alpha-3", "alp%-3", "a_pha-3", "beta\\%x", "al", "", "%", "zzz", "alpha", "é1y", "x\\", "ta%%x", "page-1"]
NOW = dt.datetime(2024, 1, 10, 12)


def scanned(df, metric):
    """A figure of the scans of ``df`` after it has run."""
    execution = df._jdf.queryExecution()
    df._jdf.collectAsList()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaf.metrics().get(metric).get().value() for leaf in
               (leaves.apply(i) for i in range(leaves.size())) if leaf.metrics().contains(metric))


@pytest.fixture
def signed(spark, folder):
    """Ten days, each with a post that no other day has."""
    rows = [{"id": 10 * day + i, "page": f"page-{i}.php" if day else None, "action": "save",
             "event_time": dt.datetime(2024, 1, 1 + day, 6 + i),
             "post": f"alpha-{day}" if i < 3 else "beta%x" if i < 6 else f"é{day}y" if i < 9 else None}
            for day in range(10) for i in range(10)] + [{"id": 1000, "page": "alpha-3"}]
    log = new_log(spark, folder)
    log.append(log_of(spark, rows), "all", sign=True)
    return log


def found(df):
    return sorted(r["id"] for r in df.collect())


def test_grams_of_needles():
    grams = lambda text, **kw: signatures.needle_grams(EventFilter(search=text, **kw))
    assert grams("abcd") == ["abc", "bcd"] and grams("ab%cd_e") == [] and grams("") == []
    assert grams("ab%cd_efg") == ["efg"] and grams("a%c", literal=True) == ["a%c"]
    assert grams("a\\%c") == ["a%c"] and grams("a\\bc") == ["abc"] and grams("a\\\\c") == ["a\\c"]
    assert grams("abc", ignore_case=True) == []


@pytest.mark.parametrize("literal", [False, True])
def test_a_search_finds_the_same_with_signatures(signed, literal):
    for needle in NEEDLES:
        where = EventFilter(search=needle, literal=literal)
        assert found(signed.search(where)) == found(where.apply(signed.read())), needle
    where = EventFilter(search="alpha-3", user_id=None, page_name="page-1.php")
    assert found(signed.search(where)) == [31]


def test_a_search_reads_the_files_that_may_hold_its_text(spark, signed):
    everything = EventFilter(search="beta").apply(signed.read())
    files = scanned(everything, "numFiles")
    assert files >= 11
    assert scanned(signed.search(EventFilter(search="alpha-7")), "numFiles") == 1
    assert scanned(signed.search(EventFilter(search="alpha-3")), "numFiles") == 2   # the page of a timeless event
    assert scanned(signed.search(EventFilter(search="al")), "numFiles") == files
    assert scanned(signed.search(EventFilter(search="no such")), "numFiles") == 0


def test_batches_without_signatures_are_searched(spark, signed):
    late = log_of(spark, [{"id": 5, "page": "p", "event_time": dt.datetime(2024, 1, 4, 1), "post": "alpha-3"}])
    signed.append(late, "late")
    assert found(signed.search(EventFilter(search="alpha-3"))) == [5, 30, 31, 32, 1000]
    # Written again, with another text and without signatures.
    signed.append(late.withColumn("post", F.lit("other")), "late", sign=True)
    signed.append(late, "late")
    assert found(signed.search(EventFilter(search="alpha-3"))) == [5, 30, 31, 32, 1000]
    assert found(signed.search(EventFilter(search="other"))) == []


def test_retention_and_purge_keep_signatures_right(signed, monkeypatch):
    assert signed.expire(NOW, 7) == 26               # two days, and the third up to noon
    for needle in NEEDLES:
        where = EventFilter(search=needle)
        assert found(signed.search(where)) == found(where.apply(signed.read())), needle
    assert scanned(signed.search(EventFilter(search="alpha-7")), "numFiles") == 1

    def killed(*_):
        raise RuntimeError

    # A run that is killed before it signs what it has written back: those days are searched without.
    monkeypatch.setattr(LogTable, "_sign", killed)
    with pytest.raises(RuntimeError):
        signed.expire(NOW, 6)
    monkeypatch.undo()
    where = EventFilter(search="é3y")
    assert found(signed.search(where)) == found(where.apply(signed.read())) != []
    signed.purge()
    assert found(signed.search(where)) == []


def test_row_groups_without_an_id_are_passed_over(spark, folder):
    """Ids and users that are spread over all times: ranges of row groups overlap, Bloom filters tell."""
    events = spark.range(0, 40_000, 1, 1).select(
        (F.col("id") * 7919 % 1_000_003).alias("id"), (F.col("id") * 31 % 40_009).alias("user_id"), F.lit("p").alias("post"))
    small = {"parquet.block.size": "65536", "parquet.block.size.row.check.min": "100",
             "parquet.block.size.row.check.max": "1000", "parquet.dictionary.page.size": "512"}
    events.write.options(**TABLE_OPTIONS, **small).parquet(folder + "/log")
    rows = {}
    for bloom in ("true", "false"):
        log = spark.read.options(**{"parquet.filter.bloom.enabled": bloom,
                                    "parquet.filter.columnindex.enabled": "false"}).parquet(folder + "/log")
        rows[bloom] = [scanned(event_by_id(log, 7919 * 20_000 % 1_000_003), "numOutputRows"),
                       scanned(EventFilter(user_id=31).apply(log), "numOutputRows")]
    assert rows["false"] == [40_000, 40_000]
    assert 0 < rows["true"][0] < 10_000 and 0 < rows["true"][1] < 10_000
