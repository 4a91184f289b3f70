"""Compare a registered query with its check SQL, as rows in any order."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((value is None, str(type(value)), str(value)) for value in row)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    rows = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    return columns, sorted(rows, key=_sortable)


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=_sortable)


def differences(df, connection, sql: str) -> list[str]:
    """Human-readable differences; empty when both sides agree."""
    columns, left = spark_rows(df)
    names, right = sql_rows(connection, sql)
    if columns != names:
        return [f"columns {columns} != {names}"]
    found = []
    if len(left) != len(right):
        found.append(f"{len(left)} rows != {len(right)} rows")
    for a, b in zip(left, right):
        if a != b:
            found.append(f"{a}\n   != {b}")
        if len(found) > 3:
            break
    return found
