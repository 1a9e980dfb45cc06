"""Query registry.

A registered query is a plain ``(spark, sf_dir) -> DataFrame`` function over
the input tables, together with the survey ids it covers and, where the
semantics are SQL-expressible, an equivalent DuckDB SQL string used as an
independent oracle.  ``__spark_entry__`` and ``bench.py`` read this registry.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    run: QueryFn
    ids: tuple[str, ...]
    sql: str | None = None
    bench: bool = False
    doc: str = field(default="")


REGISTRY: dict[str, Query] = {}

_MODULES = ("traffic", "mapping", "toppick", "catalog", "search", "basket", "checkout")
_loaded = False


def _prepared(fn: QueryFn) -> QueryFn:
    """Before a query builds its plan: ship the package to the Python
    workers (once per session), and pin the session zone to UTC - event
    times are UTC wall clock, and window bounds render in that zone."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from shoplytics.session import ship_package
        ship_package(spark)
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def register(name: str, ids: tuple[str, ...] | list[str], sql: str | None = None,
             bench: bool = False):
    """Decorator: add a query function to the registry."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, _prepared(fn), tuple(ids), sql.strip() if sql else None,
                               bench, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"shoplytics.plans.{m}")
        _loaded = True
    return REGISTRY
