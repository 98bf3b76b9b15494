"""User factors: a named function from panel to (date, asset, factor_value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    _FACTORS[name] = fn


def names() -> list[str]:
    return sorted(_FACTORS)


def evaluate(panel: DataFrame, factors: Sequence[str], keep: Sequence[str] = ("label",)) -> DataFrame:
    """Long factor rows joined with columns of the panel, ready for the IC kernel."""
    rows = None
    for name in factors:
        made = _FACTORS[name](panel)
        missing = {"date", "asset", "factor_value"} - set(made.columns)
        if missing:
            raise ValueError(f"user factor {name} lacks {sorted(missing)}")
        part = made.select(F.lit(name).alias("factor_id"), "date", "asset", F.col("factor_value").cast("double").alias("factor_value"))
        rows = part if rows is None else rows.unionByName(part)
    return panel.select("date", "asset", *keep).join(rows, ["date", "asset"])
