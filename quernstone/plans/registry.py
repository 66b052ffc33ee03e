"""All named queries of the operators and, where SQL can express them, their oracles.

A query is registered together with its oracle by `query(name, sql)`; each module of plans adds its own."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
#: Modules of quernstone.plans that register queries.
MODULES: tuple[str, ...] = ("dedup", "filters", "aggregates", "windows", "sampling", "joins", "scalars", "domain", "streams", "files", "gates", "sft", "validators")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"quernstone.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
