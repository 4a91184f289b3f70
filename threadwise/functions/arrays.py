"""Generators: computed arrays as rows, and computed columns as a unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_computed(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """(keep..., name): one row per element of a computed array; empty arrays give no row.

    For a plain explode Spark infers a filter on the array's size and pushes it to the scan, which
    computes the array once more. The outer form followed by a null check avoids that.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Evaluate ``columns`` once per row, before anything that is built on them.

    A later filter on a derived column would otherwise be pushed below its definition and repeat
    the rules behind it many times over. Spark pushes nothing through a generator.
    """
    others = [name for name in df.columns if name not in columns]
    return df.select(*others, F.inline_outer(F.array(F.struct(*columns))))
