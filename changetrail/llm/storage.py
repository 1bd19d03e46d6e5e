"""Intermediate tables that survive lost executors: written once to the shared folder, then read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only on a local master without it."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="changetrail-llm-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """The folders of intermediate tables made while it is open, to be deleted when no longer read.

    A result is lazy and reads them when it is written, so only a caller that has written it can
    say when that is. Tables made while none is open stay until the caller clears the folder.
    """

    opened: Scratch | None = None

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before, Scratch.opened = Scratch.opened, self
        return self

    def __exit__(self, *_) -> None:
        Scratch.opened = self.before

    def delete(self) -> None:
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths.clear()


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table: the plan ends here, and lost tasks re-read finished files."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if Scratch.opened is not None:
        Scratch.opened.paths.append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(frame: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, to be broadcast if its counted rows fit ``BROADCAST_BYTES``."""
    return F.broadcast(frame) if frame.count() * row_bytes <= BROADCAST_BYTES else frame
