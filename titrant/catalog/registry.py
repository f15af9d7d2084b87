"""Registered queries: a Spark function and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from titrant.catalog import chain
from titrant.catalog.stages import Stages, stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_RAW: dict[str, tuple[str, bool]] = {}


def sql_checks() -> dict[str, str]:
    return {n: chain.with_for(s) if chained else s for n, (s, chained) in _RAW.items()}


def query(name: str, sql: str | None = None, chained: bool = True):
    """Register a function of the stage tables under a name.  A chained check
    may refer to the fragments of the SQL chain."""
    def wrap(fn: Callable[[Stages], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(stages(spark, sf_dir))
        if sql is not None:
            _RAW[name] = (sql, chained)
        return fn
    return wrap


def columns(name: str, stage: str, cols: str, where: str = "", alias: dict[str, str] | None = None):
    """Register a query whose check is a plain selection from a SQL stage."""
    names = {c.strip(): (alias or {}).get(c.strip(), c.strip()) for c in cols.split(",")}
    picked = ", ".join(f"{src} AS {out}" if src != out else out for out, src in names.items())
    return query(name, f"SELECT {picked} FROM {stage} {where}")
