"""All registered queries of the ledger engine and their SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import the plan modules, which register themselves."""
    from ledgerflow.plans import bank_queries, chain_queries, classify_queries, discovery_queries, header_queries, layout_queries, print_queries, scalar_queries, source_queries, summary_queries  # noqa: F401
