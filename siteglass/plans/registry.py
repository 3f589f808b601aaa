"""What the driver can run: query functions by name, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
_MODULES = ("relational", "scalars", "writes", "texts", "sites", "speed", "published")


def query(name: str, sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    """Registers a query; sql follows the prelude of the model's relations unless it needs none."""
    from siteglass.plans.model import PRELUDE

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = PRELUDE + sql if prelude else sql
        return f

    return keep


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"siteglass.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["worst_first_pages"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
