"""Every operator as a query over the given tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    """Registers a query under its name, with its SQL."""
    def add(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def load_all() -> None:
    from pressline.catalog import (  # noqa: F401
        answers, article_text, dates, ingestion_run, link_lists, map_rows, place_lookup, runs, streams,
    )
