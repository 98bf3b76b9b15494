"""Cross-sectional and grouped operators: one value per (date[, group], asset)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import TINY, col, holds, steady
from .ordered import average_rank, drop_stats, group_stats, order_stats, with_quantiles

DATE = ("date",)

# -- expressions for groups that fit a task ---------------------------------------------------


def _order(keys, x, descending):
    return Window.partitionBy(*keys).orderBy(x.desc_nulls_last() if descending else x.asc_nulls_last())


def rank_expr(x, keys=DATE, descending=False, share=True) -> Column:
    """Average rank of ``x`` in its group, over the number of values unless ``share`` is off."""
    x = steady(x)
    w = _order(keys, x, descending)
    place = F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0
    return F.when(x.isNotNull(), place / F.count(x).over(Window.partitionBy(*keys)) if share else place)


def hit_expr(x, n, keys=DATE, descending=False) -> Column:
    return holds(rank_expr(x, keys, descending, share=False) <= n).cast("double")


def quantile_expr(x, n, keys=DATE, tie=("asset",)) -> Column:
    x = steady(x)
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_last(), *tie)) - 1) * n
    last = F.count(x).over(Window.partitionBy(*keys)) - 1
    return F.when(x.isNotNull(), _bucket(place, last) / (n - 1))


def _bucket(place, last) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.ceil(F.try_divide(place, last)) - 1), F.lit(0.0))


MOMENTS = {
    # name: (aggregates, value from x and the aggregates)
    "zscore": (lambda x: {"m": F.avg(x), "s": F.stddev_samp(x)}, lambda x, a: (x - a["m"]) / (a["s"] + TINY)),
    "zscore_pop": (
        lambda x: {"m": F.avg(x), "s": F.stddev_pop(x)},
        lambda x, a: F.when(a["s"] > 0, (x - a["m"]) / a["s"]).otherwise(0.0),
    ),
    "scale": (lambda x: {"lo": F.min(x), "hi": F.max(x)}, lambda x, a: (x - a["lo"]) / (a["hi"] - a["lo"] + TINY)),
    "demean": (lambda x: {"m": F.avg(x)}, lambda x, a: x - a["m"]),
    "mean": (lambda x: {"m": F.avg(x)}, lambda x, a: a["m"]),
    "median": (lambda x: {"m": F.percentile(x, F.lit(0.5))}, lambda x, a: a["m"]),
    "sum": (lambda x: {"m": F.sum(x)}, lambda x, a: F.coalesce(a["m"], F.lit(0.0))),
    "min": (lambda x: {"m": F.min(x)}, lambda x, a: a["m"]),
    "max": (lambda x: {"m": F.max(x)}, lambda x, a: a["m"]),
    "std": (lambda x: {"m": F.stddev_samp(x)}, lambda x, a: a["m"]),
    "count": (lambda x: {"m": F.count(x).cast("double")}, lambda x, a: a["m"]),
}


def moment_expr(kind: str, x, keys=DATE) -> Column:
    x, w = col(x), Window.partitionBy(*keys)
    aggs, value = MOMENTS[kind]
    return value(x, {k: a.over(w) for k, a in aggs(x).items()})


# -- operators on frames, for groups of any size ---------------------------------------------


def _ranked(df, x, out, keys, expr, **kw) -> DataFrame:
    tagged = order_stats(df, keys, x, "_o", wide=True, **kw)
    return drop_stats(tagged.withColumn(out, expr), "_o")


def rank(df, x, out, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    """Average rank over the number of values, in (0, 1]."""
    if not wide:
        return df.withColumn(out, rank_expr(x, keys))
    return _ranked(df, x, out, keys, average_rank("_o") / F.col("_o_n"))


def top_n(df, x, out, n: int = 10, keys: Sequence[str] = DATE, wide=False, descending=True) -> DataFrame:
    """1.0 for the n largest (average rank), else 0.0."""
    if not wide:
        return df.withColumn(out, hit_expr(x, n, keys, descending))
    return _ranked(df, x, out, keys, holds(average_rank("_o") <= n).cast("double"), descending=descending)


def bottom_n(df, x, out, n: int = 10, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    return top_n(df, x, out, n, keys, wide, descending=False)


def quantile(df, x, out, n: int = 5, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    """Equal-frequency bucket of the row number, scaled to [0, 1]."""
    if not wide:
        return df.withColumn(out, quantile_expr(x, n, keys))
    bucket = F.when(F.col("_o_rn").isNotNull(), _bucket((F.col("_o_rn") - 1) * n, F.col("_o_n") - 1))
    return _ranked(df, x, out, keys, bucket / (n - 1), row_number=True)


def moment(df, kind: str, x, out, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    """A value computed from the row and its group's moments."""
    if not wide:
        return df.withColumn(out, moment_expr(kind, x, keys))
    if kind == "median":
        return with_quantiles(df, keys, x, {out: 0.5}, wide=True)
    aggs, value = MOMENTS[kind]
    made = {f"_m_{k}": a for k, a in aggs(F.col(x)).items()}
    tagged = group_stats(df, keys, made, wide=True)
    return tagged.withColumn(out, value(F.col(x), {k[3:]: F.col(k) for k in made})).drop(*made)


def zscore(df, x, out, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    return moment(df, "zscore", x, out, keys, wide)


def zscore_pop(df, x, out, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    """Population z-score; 0 where the spread is 0 or there is no value."""
    return moment(df, "zscore_pop", x, out, keys, wide)


def demean(df, x, out, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    return moment(df, "demean", x, out, keys, wide)


def group_keys(df: DataFrame, group: str = "industry") -> list[str]:
    """(date, group), or the date alone where the group column is absent."""
    return ["date", group] if group in df.columns else ["date"]


def group_neutralize(df, x, out, group: str = "industry", wide=False) -> DataFrame:
    if group not in df.columns:
        return df.withColumn(out, F.col(x))
    return demean(df, x, out, ["date", group], wide)


def fill_missing(df, x, out, method: str = "cross_section_median", wide=False) -> DataFrame:
    if method == "zero":
        return df.withColumn(out, F.coalesce(F.col(x), F.lit(0.0)))
    if method == "cross_section_median":
        filled = with_quantiles(df, DATE, x, {"_med": 0.5}, wide=wide)
        return filled.withColumn(out, F.coalesce(F.col(x), F.col("_med"))).drop("_med")
    from .ts import series

    back = series().rowsBetween(Window.unboundedPreceding, 0)
    ahead = series().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(
        out, F.coalesce(F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead))
    )


def winsorize_mad(df, x, out, limit: float = 3.0, keys: Sequence[str] = DATE, wide=False) -> DataFrame:
    """Clip to median +- limit * 1.4826 * MAD per date; untouched where the MAD is 0."""
    d = with_quantiles(df, keys, x, {"_med": 0.5}, wide=wide)
    d = d.withColumn("_dev", F.abs(F.col(x) - F.col("_med")))
    d = with_quantiles(d, keys, "_dev", {"_mad": 0.5}, wide=wide)
    span = F.lit(limit * 1.4826) * F.col("_mad")
    cut = F.least(F.greatest(F.col(x), F.col("_med") - span), F.col("_med") + span)
    expr = F.when(F.col(x).isNotNull() & (F.col("_mad") > 0), cut).otherwise(F.col(x))
    return d.withColumn(out, expr).drop("_med", "_dev", "_mad")


def preprocess(df, x, out, fill="cross_section_median", limit=3.0, wide=False) -> DataFrame:
    """Fill, winsorize, z-score, industry demean, size tilt - the fixed post-processing chain."""
    d = fill_missing(df, x, "_p", fill, wide)
    d = winsorize_mad(d, "_p", "_p", limit, wide=wide)
    d = zscore_pop(d, "_p", "_p", wide=wide)
    if "industry" in d.columns:
        d = group_neutralize(d, "_p", "_p", wide=wide)
    if "market_cap" in d.columns:
        d = zscore_pop(d, "market_cap", "_cap", wide=wide)
        d = d.withColumn("_p", F.col("_p") - 0.05 * F.coalesce(F.col("_cap"), F.lit(0.0))).drop("_cap")
    return d.withColumn(out, F.col("_p")).drop("_p")
