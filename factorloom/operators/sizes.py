"""How large is the largest group?  One cheap aggregate decides the physical plan.

A cross-sectional window puts one date into one task.  That is the best plan while
a date fits a task comfortably, and the wrong one on a billion-asset date.  Callers
measure once per panel and pass ``wide=True`` to the operators beyond the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONF = "spark.factorloom.maxGroupRows"
DEFAULT_MAX_GROUP_ROWS = 2_000_000


def max_group_rows(spark) -> int:
    return int(spark.conf.get(CONF, str(DEFAULT_MAX_GROUP_ROWS)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(row["n"] or 0)


def is_wide(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some group is too large for one task."""
    return largest_group(df, keys) > max_group_rows(df.sparkSession)
