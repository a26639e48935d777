"""Registration helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import fast_round

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a query builder ``f(spark, sf_dir) -> DataFrame`` and its oracle SQL."""
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def ts_text(c) -> Column:
    """Timestamp as fixed-width text so engines compare equal values equally."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(c) -> Column:
    """Doubles rounded to 6 dp at the output boundary only (summation order differs by engine)."""
    return fast_round(c, 6)
