"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from earlog.plans.sqltext import compose

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_MODULES = ["statistics", "catalogue", "listening", "mixing", "ingest", "textual", "similarity"]


def query(name: str, sql: str | None = None, *needs: str):
    """Register a query; `needs` names the derivations its SQL reads."""
    def wrap(fn):
        if name in _REGISTRY:
            raise ValueError(f"query {name} registered twice")
        _REGISTRY[name] = (fn, None if sql is None else compose(sql, *needs))
        return fn
    return wrap


def load() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    for m in _MODULES:
        importlib.import_module(f"earlog.plans.{m}")
    return dict(_REGISTRY)
