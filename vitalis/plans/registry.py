"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB
oracle text for each. Every query reads the driver tables (through the
derived inputs of ``sources.fixtures``) in full. The fixtures route events by
kind: weights and sleep sessions are made of some kinds each, as FIXTURES.md says.

Output convention: DATE columns leave as ISO ``yyyy-MM-dd`` text (the
original stores dates as text), so results compare across engines.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import dims
from ..sources import fixtures as fx
from . import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: Callable[[], str] | str | None = None):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql if isinstance(sql, str) else sql()
        return fn
    return deco


def dates_as_text(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries, saves  # noqa: F401


__all__ = ["QUERIES", "ORACLE", "register", "load_all", "fx", "dims", "oracle"]
