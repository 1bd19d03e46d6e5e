"""What must not grow faster than the input: repeated expressions, repeated dimensions, sorted grams."""

import pytest
from tables import SF_DIR, new_log

from changetrail.functions import item_lists
from changetrail.functions.binding import let
from changetrail.operators import enrich, ingest, signatures
from changetrail.operators.lookups import join_dimension
from changetrail.operators.search import EventFilter
from changetrail.plans import fixtures as fx
from changetrail.sources.readers import read_json_lines, split_broken
from changetrail.streaming.ingest import routed_batch_writer
from pyspark.sql import functions as F
from test_search import log_of


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("events, source", [(ingest.routed_events, fx.raw_records),
                                            (ingest.web_events, fx.web_form_requests)])
def test_requests_are_parsed_above_the_join_and_once(spark, events, source):
    text = optimized(events(source(spark, SF_DIR), fx.entity_tables(spark, SF_DIR)))
    # Once for events with a lookup and once for those without; 36 and 6 times when filters repeated it.
    assert text.count("aggregate(") <= 2
    assert all("from_json" not in line for line in text.splitlines() if "Join " in line)


def test_a_list_as_usual_is_read_as_entry_by_entry(spark):
    texts = ["a:0:{}", "a:1:{i:0;i:5;}", 'a:2:{i:0;s:1:"5";i:1;s:0:"";}', 'a:1:{i:0;s:2:"5";}', 'a:1:{i:0;s:01:"5";}',
             'a:2:{i:0;s:1:"5";}', 'a:1:{i:0;s:1:"5";}\n', 'a:1:{i:0;s:1:"+";}', 'a:1:{i:0;s:2:"-5";}', 'a:1:{i:0;d:5;}',
             'a:1:{i:0;s:21:"123456789012345678901";}', 'a:1:{s:3:"\u00e91";i:5;}', "a:1:{i:0;i:;}", "a:1:{i:0;i:5;}}",
             "a:9999:{" + "".join(f'i:{i};s:{len(str(i))}:"{i}";' for i in range(9999)) + "}"]
    df = spark.createDataFrame([(text,) for text in texts], "text string")
    slow = let(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), item_lists._fold)
    rows = df.select("text", item_lists.parse_serialized(F.col("text")).alias("found")).collect()
    known = df.filter(F.length("text") < 1000).select("text", slow.alias("found")).collect()
    assert [tuple(r) for r in rows[:-1]] == [tuple(r) for r in known]
    assert rows[-1]["found"] == [str(i) for i in range(9999)]
    assert sum(r["found"] is not None for r in rows) == 8
    usual = df.select(F.col("text").rlike(item_lists.USUAL_LIST).alias("usual")).collect()
    assert [r["usual"] for r in usual] == [i in (0, 1, 2, 5, 8, 14) for i in range(15)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_large_dimension_is_repeated_only_where_spark_does_not_split(spark, adaptive):
    facts, dim = spark.range(100).selectExpr("id", "1 as k"), spark.createDataFrame([(1, "v")], "k int, v string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        joined = join_dimension(facts, dim, ["k"], "id", broadcast_limit=0)
        assert ("_salt" in optimized(joined)) == (adaptive == "false")
        assert joined.filter("v = 'v'").count() == 100 and joined.columns == ["k", "id", "v"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_hot_key_is_split_by_spark(spark):
    """Nearly all facts have one key; its partition is read by several tasks."""
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in small}
    users = spark.range(5000).selectExpr("id", "concat('u', id) as username")
    log = spark.range(0, 60000, 1, 8).selectExpr(
        "id", "if(id % 20 > 0, 1, id % 7000) as user_id", "sha2(string(id), 256) as post")
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        named = enrich.with_username(log, users, broadcast_limit=0)
        assert len(named.collect()) == 60000
        assert "skew=true" in named._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_each_gram_of_a_file_goes_to_its_bitmap_once(spark, folder):
    log = new_log(spark, folder)
    rows = [{"id": i, "page": "p.php", "post": "alpha" if i % 2 else "beta"} for i in range(50)]
    log.append(log_of(spark, rows), "all", sign=True)
    text = optimized(signatures.file_signatures(log.read()))
    assert text.count("Aggregate [") == 2
    assert log.search(EventFilter(search="alpha")).count() == 25


def test_a_micro_batch_is_parsed_once(spark, folder, monkeypatch):
    """What is cached are the parsed rows and the lines put aside."""
    from changetrail.streaming import ingest as streaming
    fx.json_lines(spark, SF_DIR).write.text(folder + "/raw")
    raw, cached = read_json_lines(spark, folder + "/raw"), []
    log = new_log(spark, folder + "/log")
    real = streaming.with_snapshots

    def seen(rows, tables):
        cached.append(optimized(rows))
        return real(rows, tables)

    monkeypatch.setattr(streaming, "with_snapshots", seen)
    routed_batch_writer(log, lambda: fx.entity_tables(spark, SF_DIR), streaming.Settings(), "raw")(raw, 0)
    assert "InMemoryRelation" in cached[0] and "from_json" not in cached[0].split("InMemoryRelation")[0]
    whole, broken = split_broken(raw)
    assert log.read().count() == ingest.routed_rows(whole).count() > 0
    assert sorted(log.quarantined().select("line").collect()) == sorted(broken.collect()) != []
