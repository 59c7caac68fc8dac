"""All registered queries and statements."""

from __future__ import annotations

from locusflow.workload import call_queries, report_queries, source_queries  # noqa: F401
from locusflow.workload.oracle_steps import statement
from locusflow.workload.registry import QUERIES, STATEMENTS, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_statements() -> dict[str, str]:
    return {name: statement(sql) for name, sql in STATEMENTS.items()}
