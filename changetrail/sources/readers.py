"""Raw event sources and dimension scans, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changetrail.functions.binding import with_computed
from changetrail.functions.params import STRICT_JSON
from changetrail.functions.item_lists import decode_item_list
from changetrail.schemas import CLI_SCHEMA, RAW_SCHEMA, USER_SCHEMA, WEB_REQUEST_SCHEMA

BROKEN = "broken_line"


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, stream: bool,
          **options: str) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).options(**options).load(path)


def read_requests(spark: SparkSession, path: str, schema: T.StructType = WEB_REQUEST_SCHEMA,
                  fmt: str = "parquet", stream: bool = False, **options: str) -> DataFrame:
    """Raw web requests. Pass ``REQUEST_SCHEMA`` if the steering parameters are columns already.

    Options go to the reader, for example ``maxFilesPerTrigger`` for a stream.
    """
    return _read(spark, path, schema, fmt, stream, **options)


def read_commands(spark: SparkSession, path: str, schema: T.StructType = CLI_SCHEMA,
                  fmt: str = "parquet", stream: bool = False, **options: str) -> DataFrame:
    """Raw command runs."""
    return _read(spark, path, schema, fmt, stream, **options)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                    stream: bool = False, **options: str) -> DataFrame:
    """Raw records as JSON lines, in batch or as a stream. Blank lines are passed over.

    A line that is no JSON, is cut off, or has a value of another type than ``schema`` says is kept
    whole in ``broken_line``, which is NULL for all others. What could be read of it is there too.
    """
    reader = spark.readStream if stream else spark.read
    lines = reader.options(**options).text(path)
    record = F.from_json("value", T.StructType(list(schema.fields)).add(BROKEN, T.StringType()),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return lines.filter(F.trim("value") != "").select(record.alias("record")).select("record.*")


def split_broken(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that were read in full, and the lines that were not."""
    whole = records.filter(F.col(BROKEN).isNull()).drop(BROKEN)
    return whole, records.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def read_users(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """User dimension: ``id`` and ``username`` only."""
    return _read(spark, path, USER_SCHEMA, fmt, stream=False)


def read_entity_tables(spark: SparkSession, paths: dict[str, str],
                       fmt: str = "parquet") -> dict[str, DataFrame]:
    """Entity dimensions by table name. Only the columns a page shows are read later on."""
    return {table: spark.read.format(fmt).load(path) for table, path in paths.items()}


STEERING = "action string, mode string, drp_action string, purge_continue string, " \
           "selected_items string"


def with_request_fields(requests: DataFrame) -> DataFrame:
    """Lift the parameters that steer admission and classification out of the ``params`` JSON.

    A column that the source already has is left as it is.
    """
    items = F.col("_items")
    fields = {
        "req_action": F.col("_steering.action"),
        "mode_arg": F.col("_steering.mode"),
        "drp_action": F.col("_steering.drp_action"),
        "purge_continue": F.col("_steering.purge_continue").isNotNull(),
        # Text that is no list of either form counts as no items.
        "has_items": items.isNotNull(),
        "selected_items": items,
    }
    missing = {name: column for name, column in fields.items() if name not in requests.columns}
    # Admission filters by these fields: parsed below the filters, not in them.
    steered = requests.withColumn("_steering", F.from_json("params", STEERING, STRICT_JSON))
    if missing.keys() & {"has_items", "selected_items"}:
        steered = steered.withColumn("_items", decode_item_list(F.col("_steering.selected_items")))
    return with_computed(steered, missing).drop("_steering", "_items")
