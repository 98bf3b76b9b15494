"""Time-series operators: windows over one asset's rows in date order.

(date, asset) is a key, so an asset has at most one row per date and a series is as
long as the calendar, however many assets there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, ratio
from ..functions.stats import complete_pair, safe_corr



def series(asset: str = "asset", date: str = "date"):
    return Window.partitionBy(asset).orderBy(date)


def rolling(w: int):
    return series().rowsBetween(-(int(w) - 1), 0)


def delta(x, w: int = 1) -> Column:
    return col(x) - F.lag(col(x), w).over(series())


def lag(x, w: int = 1) -> Column:
    return F.lag(col(x), w).over(series())


def ts_mean(x, w: int = 20) -> Column:
    return F.avg(col(x)).over(rolling(w))


def ts_std(x, w: int = 20) -> Column:
    return F.stddev_samp(col(x)).over(rolling(w))


def ts_max(x, w: int = 20) -> Column:
    return F.max(col(x)).over(rolling(w))


def ts_min(x, w: int = 20) -> Column:
    return F.min(col(x)).over(rolling(w))


def ts_sum(x, w: int = 20) -> Column:
    return F.sum(col(x)).over(rolling(w))


def ts_rank(x, w: int = 20) -> Column:
    """Percent rank of the current value among the window's values, ties averaged."""
    x = col(x)
    seen = F.collect_list(x).over(rolling(w))
    below = F.size(F.filter(seen, lambda v: v < x))
    equal = F.size(F.filter(seen, lambda v: v == x))
    return F.when(x.isNotNull(), (below + (equal + 1) / 2.0) / F.size(seen))


def _arg_extreme(x, w: int, gap: float, pick) -> Column:
    """Window position (from 0) of the first extreme over w; a gap counts as the extreme."""
    x = col(x)
    frame = rolling(w)
    held = F.collect_list(F.coalesce(x, F.lit(gap))).over(frame)
    return F.when(F.count(x).over(frame) > 0, (F.array_position(held, pick(held)) - 1) / float(w))


def ts_argmax(x, w: int = 20) -> Column:
    return _arg_extreme(x, w, float("inf"), F.array_max)


def ts_argmin(x, w: int = 20) -> Column:
    return _arg_extreme(x, w, float("-inf"), F.array_min)


def ts_corr(x, y=None, w: int = 20) -> Column:
    """Correlation of the window's pairs, bounded and rounded: that of two rows is +-1 and must tie with its like."""
    c = safe_corr(x, x if y is None else y, rolling(w))
    return F.when(c.isNotNull(), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)), 12))


def ts_cov(x, y=None, w: int = 20) -> Column:
    a, b = complete_pair(x, x if y is None else y)
    return F.covar_samp(a, b).over(rolling(w))


def ts_skew(x, w: int = 20) -> Column:
    x, frame = col(x), rolling(w)
    n = F.count(x).over(frame)
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    raw = F.skewness(x).over(frame)
    fixed = F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)) * raw
    return F.when((n >= w // 2) & (n >= 3), F.when(flat, F.lit(0.0)).otherwise(fixed))


def ts_kurt(x, w: int = 20) -> Column:
    x, frame = col(x), rolling(w)
    n = F.count(x).over(frame)
    flat = F.min(x).over(frame) == F.max(x).over(frame)
    raw = F.kurtosis(x).over(frame)
    fixed = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * raw + 6)
    return F.when((n >= w // 2) & (n >= 4), F.when(flat, F.lit(-3.0)).otherwise(fixed))


def event_filter(x, event, w: int = 5) -> Column:
    hit = F.coalesce(F.max(col(event)).over(rolling(w)) > 0, F.lit(False))
    return col(x) * hit.cast("double")


def pct_change(x="close", n: int = 1) -> Column:
    return ratio(col(x), F.lag(col(x), n).over(series())) - 1


def forward_return(horizon: int, shift: int = 0, x="close") -> Column:
    """Return from ``shift`` rows ahead over ``horizon`` rows.

    With a shift s the label is close[t+h+s-1] / close[t+s] - 1, so h = 1 is always 0.
    """
    x, w = col(x), series()
    if not shift:
        return ratio(F.lead(x, horizon).over(w), x) - 1
    return ratio(F.lead(x, horizon + shift - 1).over(w), F.lead(x, shift).over(w)) - 1


def previous_extremes(df: DataFrame, x: str, spans: Sequence[int]) -> DataFrame:
    """Add ``_u{k}`` and ``_d{k}``: the largest and smallest ``x`` of the k rows before this one, NULL unless all k have a value.

    Extremes over 1, 2, 4, ... rows are built once, each from two of the half length; any
    span is two overlapping ones of them, so a grid of spans costs about log2 of the largest.
    """
    w = series()
    pick = {"_u": F.greatest, "_d": F.least}

    def both(kind: str, a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), pick[kind](a, b))

    d = df.withColumns({f"{kind}p0": F.col(x) for kind in pick})
    top = max(spans).bit_length() - 1
    for j in range(top):
        d = d.withColumns({f"{kind}p{j + 1}": both(kind, F.col(f"{kind}p{j}"), F.lag(f"{kind}p{j}", 2**j).over(w)) for kind in pick})
    made = {}
    for k in sorted(set(spans)):
        j = k.bit_length() - 1
        made |= {f"{kind}{k}": both(kind, F.lag(f"{kind}p{j}", 1).over(w), F.lag(f"{kind}p{j}", 1 + k - 2**j).over(w)) for kind in pick}
    return d.withColumns(made).drop(*[f"{kind}p{j}" for kind in pick for j in range(top + 1)])


BLOCK = 32  # rows of an asset whose maps are composed at once


def _compose(maps: Column) -> Column:
    """The affine map of a list of maps y -> a y + b, applied in order."""
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return F.aggregate(maps, start, lambda acc, m: F.struct((m["a"] * acc["a"]).alias("a"), (m["a"] * acc["b"] + m["b"]).alias("b")))


def ema(df: DataFrame, x: str, out: str, alpha: float = 0.1) -> DataFrame:
    """Exponential mean seeded with the first value; old weight keeps decaying over gaps.

    Every row is an affine map of the mean before it, and maps compose. A row composes the
    maps of its block of dates and, once for each block, those of all blocks before it, so a
    series of T dates costs about BLOCK + T / BLOCK steps a row, all over one partitioning.
    """
    v, w = F.col(x).cast("double"), series()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_pos", F.row_number().over(w))
    d = d.withColumn("_seen", F.last(F.when(v.isNotNull(), F.col("_pos")), ignorenulls=True).over(before))
    old = F.pow(F.lit(1.0 - alpha), (F.col("_pos") - F.col("_seen")).cast("double"))
    a = F.when(v.isNull(), 1.0).when(F.col("_seen").isNull(), 0.0).otherwise(old / (old + alpha))
    b = F.when(v.isNull(), 0.0).when(F.col("_seen").isNull(), v).otherwise(alpha * v / (old + alpha))
    d = d.withColumns({"_map": F.struct(a.alias("a"), b.alias("b")), "_block": F.floor((F.col("_pos") - 1) / BLOCK)})
    block = Window.partitionBy("asset", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_map", _compose(F.collect_list("_map").over(block)))
    whole = F.collect_list(F.when(F.col("_pos") % BLOCK == 0, F.col("_map"))).over(before)
    d = d.withColumn("_start", F.when(F.col("_pos") % BLOCK == 1, _compose(whole)["b"]))
    start = F.first("_start").over(block)
    known = v.isNotNull() | F.col("_seen").isNotNull()
    return d.withColumn(out, F.when(known, F.col("_map.a") * start + F.col("_map.b"))).drop("_pos", "_seen", "_map", "_block", "_start")


def rolling_ols_residual(df: DataFrame, x: str, out: str, w: int = 60, wide=False) -> DataFrame:
    """Rolling mean of the date-demeaned value."""
    from .xsec import demean

    return demean(df, x, "_res", wide=wide).withColumn(out, ts_mean("_res", w)).drop("_res")


def compound(r) -> Column:
    """Aggregate: product of (1 + r); a return of -100 % or worse is kept exact."""
    g = 1.0 + F.coalesce(col(r), F.lit(0.0))
    logs = F.sum(F.when(g != 0, F.log(F.abs(g))))
    sign = F.when(F.sum((g < 0).cast("int")) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(F.sum((g == 0).cast("int")) > 0, 0.0).otherwise(sign * F.exp(F.coalesce(logs, F.lit(0.0))))


def running_product(r, over) -> Column:
    """Cumulative product of (1 + r) over an ordered window."""
    w = over.rowsBetween(Window.unboundedPreceding, 0)
    g = 1.0 + F.coalesce(col(r), F.lit(0.0))
    logs = F.sum(F.when(g != 0, F.log(F.abs(g)))).over(w)
    sign = F.when(F.sum((g < 0).cast("int")).over(w) % 2 == 1, -1.0).otherwise(1.0)
    zero = F.sum((g == 0).cast("int")).over(w) > 0
    return F.when(zero, 0.0).otherwise(sign * F.exp(F.coalesce(logs, F.lit(0.0))))


def nav_and_drawdown(df: DataFrame, r: str, by: list[str] | None = None, order: str = "date") -> DataFrame:
    """Add nav, its running peak and the drawdown of a return series."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    d = df.withColumn("nav", running_product(r, w))
    d = d.withColumn("peak", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("drawdown", ratio("nav", "peak") - 1)


def trend_features(df: DataFrame, trend_window: int = 60, vol_window: int = 20) -> DataFrame:
    """Trend mean, return, volatility and an up / down state per asset."""
    d = df.withColumns({"trend_ma": ts_mean("close", trend_window), "returns": F.coalesce(pct_change("close"), F.lit(0.0))})
    d = d.withColumn("volatility", F.coalesce(F.stddev_samp("returns").over(rolling(vol_window)), F.lit(0.0)))
    up = F.coalesce(F.col("close") > F.col("trend_ma"), F.lit(False))
    return d.withColumn("trend_state", F.when(up, "uptrend").otherwise("downtrend"))


def longest_run(df: DataFrame, flag: Column, min_length: int = 5) -> DataFrame:
    """Runs of consecutive flagged rows per asset (gaps and islands) of at least ``min_length``."""
    w = series()
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    d = d.withColumn(
        "_island", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = d.filter("_f").groupBy("asset", "_island").agg(
        F.count(F.lit(1)).alias("run_length"), F.min("date").alias("start"), F.max("date").alias("end")
    )
    return runs.filter(F.col("run_length") >= min_length).drop("_island")
