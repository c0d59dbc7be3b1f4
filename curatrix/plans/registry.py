"""Collects the queries of the modules in this folder. A query is a function (spark, sf_dir) -> DataFrame, with or without SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.found: dict[str, tuple[Query, str | None]] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.found[f.__name__] = (f, sql)
            return f

        return add

    def queries(self) -> dict[str, Query]:
        return {name: f for name, (f, _) in self.found.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {name: sql for name, (_, sql) in self.found.items() if sql}


def _registries() -> list[Registry]:
    from . import curation, dedup, evaluation, files, loading, tables

    return [m.registry for m in (dedup, tables, loading, curation, files, evaluation)]


def queries() -> dict[str, Query]:
    return {name: f for r in _registries() for name, f in r.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.oracle_sql().items()}
