"""All registered core queries: name -> (Spark query, DuckDB SQL with the same rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Registry(dict):
    def add(self, name: str, sql: str | None = None):
        def keep(query):
            self[name] = Query(query, sql)
            return query

        return keep


CORE = Registry()

from vintage_jobs.jobs import queries_backtest, queries_fits, queries_panel, queries_vintage  # noqa: E402, F401
