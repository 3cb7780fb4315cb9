"""All queries of the library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import call_queries, draft_queries, html_queries, page_queries, project_queries, saving_queries, stream_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {**page_queries.QUERIES, **text_queries.QUERIES, **html_queries.QUERIES, **stream_queries.QUERIES, **saving_queries.QUERIES, **project_queries.QUERIES, **draft_queries.QUERIES, **call_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB. Queries without any are held against plain Python in the tests."""
    return {name: sql for name, (_, sql) in ALL.items() if sql}
