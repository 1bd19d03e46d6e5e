"""Fixtures of the subpackage's tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import CLASHES, DOCS, make_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def unique_rows(rows):
    """Rows with ids of their own, for comparisons by id."""
    seen, out = set(), []
    for row in rows:
        if row[0] is not None and row[0] not in seen:
            seen.add(row[0])
            out.append(row)
    return out


@pytest.fixture(scope="session")
def unique_docs(spark, unique_rows):
    return spark.createDataFrame(unique_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit(name) for name in CLASHES})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
