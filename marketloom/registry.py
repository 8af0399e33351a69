"""Registry of the library's queries: each is a function (spark, sf_dir) -> DataFrame with a SQL twin where one exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("features", "store", "learning", "portfolios", "cashflow", "altdata", "text", "stores_io", "streams", "models", "markets", "feeds", "rules", "training", "volatility", "sentiment", "backtests", "cycle", "matrix", "listings")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"marketloom.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
