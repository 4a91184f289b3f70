"""What several operators share: table access, word classes and let-bindings for columns."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space. Words are what lies between.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def whole_text(text: str) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that an operator is about to write make way for its own."""
    return df.drop(*[name for name in df.columns if name.lower() in names])


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """Rename input columns whose names an operator needs, and the columns that restore them."""
    taken = {column.lower() for column in df.columns}
    renames = {}
    for column in df.columns:
        if column.lower() in names:
            renames[column] = f"input_{column}"
            while renames[column].lower() in taken:
                renames[column] = f"input_{renames[column]}"
    restored = [
        F.col(f"`{renames[c]}`").alias(c) if c in renames else F.col(f"`{c}`") for c in df.columns
    ]
    return df.withColumnsRenamed(renames), restored


def kept_by_worker(name: str, make: Callable):
    """An object that a Python worker keeps from one task to the next, made when first asked for.

    Functions travel to the workers whole, so their own modules start empty in every task.
    """
    store = sys.modules.setdefault("threadwise_kept", types.ModuleType("threadwise_kept"))
    if name not in vars(store):
        setattr(store, name, make())
    return getattr(store, name)
