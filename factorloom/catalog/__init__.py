"""Named queries over the provided tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def day(c="date"):
    return F.col(c).cast("string").alias(c) if isinstance(c, str) else c


# Nudges values off exact half-way points, where the two engines round differently.
NUDGE = 0.0314159


def show(df: DataFrame, keys: list[str], values: list[str], digits: int = 6, other: dict[str, int] | None = None) -> DataFrame:
    """Keys as text where they are dates, values rounded for comparison; ``other`` has the columns of other digits."""
    places = dict.fromkeys(values, digits) | (other or {})
    kinds = dict(df.dtypes)
    heads = [F.col(k).cast("string").alias(k) if kinds[k] == "date" else F.col(k) for k in keys]
    return df.select(*heads, *[rounded(F.col(v) + NUDGE * 10.0**-n, n).alias(v) for v, n in places.items()])


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE * 10.0**-digits!r}, {digits}) + 0.0 AS {name}"


def load_all() -> None:
    from . import (  # noqa: F401
        dsl,
        evaluation,
        research,
        book,
        data,
        texts,
        prepare,
    )
