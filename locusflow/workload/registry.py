"""Registered queries with their independent SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, statement: str | None = None):
    """Register a query; ``statement`` is its SQL over the names of the oracle steps."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if statement is not None:
            STATEMENTS[name] = statement
        return build

    return register
