"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from threadwise.registry.catalog import QUERIES, SQL, Query


def _load() -> None:
    from threadwise.registry import (  # noqa: F401
        answer_queries,
        evaluation_queries,
        retrieval_queries,
        rule_queries,
        text_queries,
    )


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
