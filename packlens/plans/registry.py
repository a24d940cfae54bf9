"""Named queries and their SQL oracles, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``oracle`` is the equivalent DuckDB SQL."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


#: Modules that register queries when they are imported.
MODULES = ("operators.analytics", "operators.relational", "functions.scalars", "operators.matching", "operators.rules", "operators.chain", "operators.retrieval", "operators.extraction", "operators.imperative", "sources.readers", "streaming.events")


def _load() -> None:
    for m in MODULES:
        import_module(f"packlens.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a8_by_brand"](spark, sf_dir)
