"""Query catalogue: each checked query is a Spark callable plus, where the
semantics are SQL-expressible, the equivalent DuckDB SQL over the test views.

Modules under ``clientele.plans`` register with ``@register(key, sql)``;
``__spark_entry__`` exposes the catalogue to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}

# Characters stripped by the name keys, as DuckDB SQL text.
WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise KeyError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def name_key_sql(x: str) -> str:
    """SQL twin of ``text.name_key``."""
    return f"lower({strip_sql(f'coalesce({x}, {chr(39)}{chr(39)})')})"


def load_all() -> None:
    """Import every catalogue module so their ``@register`` calls run."""
    import importlib
    import pkgutil

    import clientele.plans as plans
    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if m.name.startswith("checks_"):
            importlib.import_module(f"clientele.plans.{m.name}")


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(_SQL)


def name_key_nan_sql(x: str) -> str:
    """SQL twin of ``text.name_key_nan``."""
    return f"lower({strip_sql(f'coalesce(CAST({x} AS VARCHAR), {chr(39)}nan{chr(39)})')})"
