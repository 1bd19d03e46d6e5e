"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetrail.schemas import RAW_SCHEMA, WEB_REQUEST_SCHEMA

SCRIPTS = ("host.php", "automation_devices.php", "user_admin.php", "plugins.php",
           "graph_view.php", "index.php", "auth_profile.php", "data_templates.php",
           "auth_changepassword.php", "utilities.php")
COMMANDS = ("/a/cli/add.php", "/a/poller.php", "/a/cmd.php", "/a/scripts/x.php",
            "/a/script_server.php", "/a/q_process.php")
ITEM_PAGES = ("host.php", "host_templates.php", "templates_export.php",
              "automation_devices.php", "graph_templates.php", "thold.php", "data_sources.php",
              "data_templates.php", "aggregate_templates.php", "thold_templates.php",
              "user_admin.php", "user_group_admin.php", "links.php")


# The dimensions are whole, so events that miss them get keys beyond all of theirs.
UNKNOWN_USER = "case when {} % 7 = 3 then 1000000000 else 0 end"
UNKNOWN_ITEM = "case when ({}) % 10 = 0 then 1000000000 else 0 end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: str, values: tuple[str, ...]) -> str:
    """The value at a zero-based index, out of a constant array."""
    constants = ", ".join(f"'{value}'" for value in values)
    return f"get(array({constants}), cast({index} as int))"


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "concat(event_type, '.php') as page",
        f"user_id + {UNKNOWN_USER.format('user_id')} as user_id",
        "case when user_id = 0 then 'cli' else event_type end as action",
        "concat('10.0.0.', user_id % 256) as ip_address",
        "concat('agent-', user_id % 7) as user_agent",
        "ts as event_time",
        "props as post")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_name as username")


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as req_id",
        f"""case when o_custkey % 11 <> 0
                 then o_custkey + {UNKNOWN_USER.format('o_custkey')} end as user_id""",
        """timestamp_ntz '2024-01-01 00:00:00'
           + make_dt_interval(cast(o_orderkey % 28 as int), 0, 0, o_orderkey % 86400)
           as event_time""",
        f"concat('/srv/app/', {_pick('o_orderkey % 10', SCRIPTS)}) as script_name",
        "o_totalprice < 300000 as has_post",
        "case when o_custkey % 5 = 0 then '1.1.1.1' end as xff",
        "case when o_custkey % 4 = 0 then '2.2.2.2' end as http_xff",
        "case when o_custkey % 3 = 0 then '3.3.3.3' end as remote_addr",
        "concat('agent-', o_custkey % 7) as user_agent",
        """concat('{"id":"', o_orderkey, '","items":["', o_custkey,
                  '","7"],"login_password":"x","PassPhrase":"y","header":"false",',
                  '"__csrf_magic":"z","status":"', o_orderstatus, '"}') as params""",
        "case o_orderstatus when 'F' then 'checkpass' when 'O' then 'save' end as req_action",
        "case when o_custkey % 2 = 0 then 'install' end as mode_arg",
        """case when (o_orderkey div 10) % 6 <> 0
                then cast((o_orderkey div 10) % 6 - 1 as string) end as drp_action""",
        "o_custkey % 3 = 0 as purge_continue",
        "(o_orderkey div 60) % 4 <> 0 as has_items",
        f"{ITEMS} as selected_items")


# Selected items of an event, zero to seven, with repeats and out of order. They come from the
# event's own row: a list gathered over a group could grow with the data.
KEYS = [f"o_custkey + (o_orderkey + {place * place}) % 5" for place in range(7)]
PLACES = ", ".join(f"{key} + {UNKNOWN_ITEM.format(key)}" for key in KEYS)
ITEMS = f"slice(array({PLACES}), 1, cast(o_orderkey % 8 as int))"


def selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as event_id",
        """case o_orderstatus when 'F' then 'host.php' when 'O' then 'data_templates.php'
                              else 'user_admin.php' end as page""",
        f"{ITEMS} as items")


def selected_items_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as event_id", f"{_pick('o_orderkey % 13', ITEM_PAGES)} as page",
        f"{ITEMS} as items")


def raw_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"array({_pick('event_id % 6', COMMANDS)}, concat('--id=', user_id), event_type) as argv",
        "concat('10.1.0.', user_id % 256) as host_ip",
        "concat('os-', user_id % 5) as os_user",
        "ts as event_time")


# What the item list of a form looks like: most are serialized, some are not readable as a list of ids.
NESTED_LIST = 'a:2:{i:0;s:1:"5";i:1;a:1:{i:0;i:7;}}'
TEXT_LIKE_ENTRIES = 'a:1:{i:0;s:20:"x";i:0;s:1:"9";i:0;"";}'
MIXED_JSON = '["5","x"]'
ITEM_KIND = "(o_orderkey div 8) % 10"


def _form_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as web requests whose steering parameters are all inside ``params``."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as req_id", "o_custkey", f"{ITEM_KIND} as kind",
        "o_orderkey % 4 = 0 as from_command", "o_orderkey % 6 as command_no")
    requests = raw_requests(spark, sf_dir).join(orders, "req_id")
    entries = F.transform(
        "selected_items",
        lambda item, i: F.concat(F.lit("i:"), i, F.lit(";s:"), F.length(item.cast("string")),
                                 F.lit(':"'), item, F.lit('";')))
    serialized = F.concat(F.lit("a:"), F.size(entries), F.lit(":{"), F.array_join(entries, ""), F.lit("}"))
    listed = F.to_json(F.transform("selected_items", lambda item: item.cast("string")))
    text = (F.when(F.col("kind") == 0, NESTED_LIST).when(F.col("kind") == 1, TEXT_LIKE_ENTRIES)
            .when(F.col("kind") == 2, MIXED_JSON)
            .when(F.col("kind") == 3, F.concat(F.lit('a:1:{s:3:"é1";i:'), "o_custkey", F.lit(";}")))
            .when(F.col("kind") == 4, listed).otherwise(serialized))
    given = F.from_json("params", "id string, items array<string>, status string")
    params = F.to_json(F.struct(
        F.col("req_id").cast("string").alias("id"), F.col("req_action").alias("action"),
        F.col("mode_arg").alias("mode"), "drp_action",
        F.when(F.col("purge_continue"), "1").alias("purge_continue"),
        F.when(F.col("has_items"), text).alias("selected_items"),
        F.lit("x").alias("login_password"), F.lit("y").alias("PassPhrase"),
        F.lit("false").alias("header"), F.lit("z").alias("__csrf_magic"),
        given["items"].alias("items"), given["status"].alias("status")))
    return requests.withColumn("params", params)


def web_form_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web requests as they come: what steers admission is in ``params`` only."""
    return _form_records(spark, sf_dir).select(*[
        F.col(f.name).cast(f.dataType) for f in WEB_REQUEST_SCHEMA])


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web requests, every fourth of which also carries a command line."""
    script = F.element_at(F.array(*map(F.lit, COMMANDS)), F.col("command_no").cast("int") + 1)
    argv = F.when(F.col("from_command"), F.array(script, F.concat(F.lit("--id="), "o_custkey")))
    return _form_records(spark, sf_dir).withColumns({
        "argv": argv, "host_ip": F.when(F.col("from_command"), "10.3.0.1"),
        "os_user": F.when(F.col("from_command"), F.concat(F.lit("os-"), F.col("o_custkey") % 5)),
    }).select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as lines of JSON, of which every fiftieth or so ends behind its first value."""
    line = F.to_json(F.struct(*[f.name for f in RAW_SCHEMA]))
    short = F.concat(F.lit('{"req_id":'), "req_id")
    return raw_records(spark, sf_dir).select(
        F.when(F.col("req_id") % 50 == 7, short).otherwise(line).alias("value"))


# Names of attributes, in the order in which a detail view shows them.
ORDERED_KEYS = ("", "#", "-x", "9", "10", "A", "b")
MORE_KEYS = tuple(f"k{i:02}" for i in range(10))


def odd_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web events whose attributes stand in changing orders; every fifth one has more than 16."""
    names = ORDERED_KEYS + MORE_KEYS
    pair = "concat('\"{0}\":\"{0}', o_orderkey, '\"')"
    few, many = (f"array({', '.join(pair.format(name) for name in part)})"
                 for part in (ORDERED_KEYS, names))
    pairs = f"case when o_orderkey % 5 = 0 then {many} else {few} end"
    return (table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", f"{pairs} as pairs")
            .selectExpr("id", "'save' as action",
                        "cast(id % size(pairs) as int) as turn", "pairs")
            .selectExpr("id", "action", "concat('{', array_join(concat(slice(pairs, turn + 1, size(pairs)),"
                        " slice(pairs, 1, turn)), ','), '}') as post"))


def entity_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Entity dimensions, over whole tables."""
    part, supplier, customer = (table(spark, sf_dir, name) for name in ("part", "supplier", "customer"))
    part_names = part.selectExpr("p_partkey as id", "p_name as name")
    return {
        "host": part.selectExpr(
            "p_partkey as id", "p_size as site_id", "p_name as description",
            "p_brand as hostname", "p_partkey % 4 as status",
            "case when p_partkey % 3 <> 0 then '2024-01-02 03:04:05' end as status_fail_date",
            "'0000-00-00 00:00:00' as status_rec_date"),
        "host_template": part_names,
        "graph_templates": part.selectExpr("p_partkey as id", "p_type as name"),
        "automation_devices": part.selectExpr(
            "p_partkey as id", "p_size as network_id", "p_brand as hostname",
            "concat('10.2.0.', p_partkey % 256) as ip", "p_name as sysName",
            "case when p_partkey % 5 <> 0 then p_type end as syslocation",
            "case p_partkey % 3 when 0 then 0 when 1 then 1 end as snmp", "p_partkey % 2 as up"),
        "thold_data": part.selectExpr(
            "p_partkey as id", "p_name as name_cache", "p_brand as data_source_name"),
        # The only key that may repeat: odd parts have two rows.
        "data_template_data": part.selectExpr(
            "p_partkey as local_data_id", "p_name as name_cache", "'on' as active").unionByName(
                part.filter("p_partkey % 2 = 1").selectExpr(
                    "p_partkey as local_data_id", "p_brand as name_cache", "'' as active")),
        "data_template": supplier.selectExpr("s_suppkey as id", "s_name as name"),
        "aggregate_graph_template": part_names,
        "thold_template": part.selectExpr("p_partkey as id", "p_brand as name"),
        "user_auth": customer.selectExpr("c_custkey as id", "c_name as username"),
        "user_auth_group": customer.selectExpr("c_custkey as id", "c_mktsegment as name"),
    }
