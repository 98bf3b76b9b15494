"""Exact order statistics per group, for groups of any size.

``order_stats`` gives every row its group's count of values (n), the number of
smaller values (lt), the number of equal values including itself (eq) and, on
request, its row number (rn).  All rank-like operators are arithmetic on these.

* group fits a task: window functions over the group;
* ``wide``: range partitions by value with a table of offsets (``ranges.py``). A value
  shared by many rows is split over several ranges too, because ranges are cut on
  (value, tie-break).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import steady
from .ranges import attach, group_ranks


def order_stats(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    out: str,
    tie: Sequence[str] = ("asset",),
    descending: bool = False,
    row_number: bool = False,
    wide: bool = False,
) -> DataFrame:
    """Add ``{out}_n``, ``{out}_lt``, ``{out}_eq`` (and ``{out}_rn``); NULL ``x`` gets NULLs but n."""
    if wide:
        return _wide(df, list(keys), x, out, list(tie), descending)
    group = Window.partitionBy(*keys)
    value = steady(x)
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ranked = group.orderBy(order)
    present = F.col(x).isNotNull()
    cols = {
        f"{out}_n": F.count(x).over(group),
        f"{out}_lt": F.when(present, F.rank().over(ranked) - 1),
        f"{out}_eq": F.when(present, F.count(F.lit(1)).over(ranked.rangeBetween(0, 0))),
    }
    if row_number:
        cols[f"{out}_rn"] = F.when(present, F.row_number().over(group.orderBy(order, *tie)))
    return df.withColumns(cols)


def _wide(df, keys, x, out, tie, descending) -> DataFrame:
    value = steady(x)
    base = df.withColumn("_v", -value if descending else value)
    done = group_ranks(base.filter(F.col("_v").isNotNull()), keys, "_v", tie, out).drop("_v")
    totals = base.groupBy(*keys).agg(F.count("_v").alias(f"{out}_n"))
    gaps = attach(base.filter(F.col("_v").isNull()).drop("_v"), totals, keys, [f"{out}_n"])
    gaps = gaps.withColumns({f"{out}_{s}": F.lit(None).cast("bigint") for s in ("lt", "eq", "rn")})
    return done.unionByName(gaps)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row (a broadcast of exactly one row)."""
    left, right = df.withColumn("_one", F.lit(1)), one_row.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")


def average_rank(out: str) -> Column:
    return F.col(f"{out}_lt") + (F.col(f"{out}_eq") + 1) / 2.0


def drop_stats(df: DataFrame, out: str) -> DataFrame:
    return df.drop(*[f"{out}_{s}" for s in ("n", "lt", "eq", "rn")])


def group_stats(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], wide: bool = False) -> DataFrame:
    """Per-group aggregates on every row.

    A window while groups are small (the panel is then already partitioned by date);
    partial aggregation and a join back when a group is too large for one task.
    """
    if not wide:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
    side = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return attach(df, side, keys, list(aggs))


def group_quantiles(
    df: DataFrame, keys: Sequence[str], x: str, probs: dict[str, float], tie: Sequence[str] = ("asset",), wide: bool = False
) -> DataFrame:
    """One row per group: exact linearly interpolated quantiles of ``x``."""
    if not wide:
        return df.groupBy(*keys).agg(*[F.percentile(x, F.lit(p)).alias(n) for n, p in probs.items()])
    stats = order_stats(df.select(*keys, *tie, x), keys, x, "_q", tie, wide=True).filter(F.col(x).isNotNull())
    aggs = []
    for name, p in probs.items():
        place = (F.col("_q_n") - 1) * F.lit(float(p))
        lower = F.max(F.when(F.col("_q_rn") == F.floor(place) + 1, F.col(x)))
        upper = F.max(F.when(F.col("_q_rn") == F.ceil(place) + 1, F.col(x)))
        share = F.max(place - F.floor(place))
        aggs.append((lower + (upper - lower) * share).alias(name))
    return stats.groupBy(*keys).agg(*aggs)


def with_quantiles(df, keys, x, probs: dict[str, float], tie=("asset",), wide: bool = False) -> DataFrame:
    """``group_quantiles`` on every row."""
    if not wide:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: F.percentile(x, F.lit(p)).over(w) for n, p in probs.items()})
    return attach(df, group_quantiles(df, keys, x, probs, tie, True), keys, list(probs))
