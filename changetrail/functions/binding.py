"""Computing an expensive value once: inside one expression, as input of an explode, or below filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Catalyst does not share repeated parts below a higher-order function; JSON text would be
    parsed once per mention.
    """
    return F.transform(F.array(value), body)[0]


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once a row, however many filters and columns mention them.

    Catalyst moves a filter below the projection that makes its columns and repeats their expressions
    there, once per mention. It does not move one below a generator: this one gives one row for one.
    """
    if not columns:
        return df
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [name for name in df.columns if name not in columns]
    return df.select(*kept, F.inline_outer(F.array(values)))


def explode_positions(df: DataFrame, keep: list[str | Column], items: Column,
                      name: str) -> DataFrame:
    """``keep`` columns, zero-based ``position`` and ``name``: one row per element of ``items``.

    A plain explode makes Catalyst infer ``size(items) > 0 AND items IS NOT NULL`` and push it
    to the scan, where an expensive ``items`` is computed twice more. The outer form does not.
    """
    return (df.select(*keep, F.posexplode_outer(items).alias("position", name))
            .filter(F.col("position").isNotNull()))
