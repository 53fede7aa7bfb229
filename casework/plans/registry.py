"""Every registered query and its SQL, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casework.sources.tables import SQL_VIEWS, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query by its function's name. ``sql`` is the same in SQL over the same views: it starts with SELECT,
    or with a comma and further named parts of the WITH clause."""

    def keep(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _ORACLES[function.__name__] = SQL_VIEWS + sql
        return function

    return keep


def _load() -> None:
    import casework.plans as here

    for module in pkgutil.iter_modules(here.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{here.__name__}.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
