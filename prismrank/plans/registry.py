"""Queries are registered where they are defined, with their SQL if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registrar(queries: dict[str, Query], oracles: dict[str, str]) -> Callable:
    def register(sql: str | None = None, name: str | None = None):
        def add(fn: Query) -> Query:
            queries[name or fn.__name__] = fn
            if sql:
                oracles[name or fn.__name__] = sql
            return fn

        return add

    return register
