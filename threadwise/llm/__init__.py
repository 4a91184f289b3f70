"""Operators of a training-data pipeline, their registered queries and check SQL."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from threadwise.llm.check_sql import SQL
from threadwise.llm.queries import QUERIES, Query

# Functions travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
