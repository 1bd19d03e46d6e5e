"""Folders of any file system that Spark can write."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def make_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).mkdirs(_path(spark, path))


def delete_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark has finished writing a folder."""
    return folder_exists(spark, f"{path}/_SUCCESS")
