"""Registered queries: a Spark plan over the driver tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .clinical import Clinic
from .oracle_base import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(clinic)`` under a name, with an optional SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Clinic(spark, folder))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracle_texts() -> dict[str, str]:
    """Self-contained SQL of every query that has a twin."""
    return {name: with_ctes(sql) for name, sql in ORACLES.items()}
