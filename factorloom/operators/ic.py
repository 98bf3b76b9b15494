"""Rank IC for any number of factors in one job.

Input is long: (factor_id, date, asset, factor_value, label).  Each date of each factor
is ranked on its complete pairs, correlated, and averaged per factor.  The conventions
used by different reports are presets of one kernel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, steady
from ..functions.stats import complete_pair, safe_corr
from .ordered import average_rank, drop_stats, order_stats, with_quantiles
from .ranges import attach, group_ranks
from .together import bucket_columns, score_columns, top_columns
from .ts import forward_return
from .xsec import rank_expr


@dataclass(frozen=True)
class Convention:
    """How an IC report counts dates: horizon, minimum pairs, degenerate dates, spread."""

    horizon: int = 5
    min_n: int = 20
    ranked: bool = True
    zero_degenerate: bool = False
    sample_std: bool = False


STANDARD = Convention()
DECAY = Convention(horizon=1, min_n=5)
SCORECARD_RANK = Convention(horizon=5, min_n=3, zero_degenerate=True)
SCORECARD_LINEAR = Convention(horizon=5, min_n=3, ranked=False, zero_degenerate=True)
REPORT = Convention(horizon=1, min_n=5, sample_std=True)


def with_label(panel: DataFrame, horizon: int = 5, shift: int = 0, out: str = "label") -> DataFrame:
    return panel.withColumn(out, forward_return(horizon, shift))


def date_scores(
    long: DataFrame, how: Convention = STANDARD, by: Sequence[str] = ("factor_id",), label: str = "label", wide=False
) -> DataFrame:
    """(by..., date, n, rank_ic, n_rows, n_values); rank_ic is NULL on dates that do not count.

    One pass: both sides are blanked on incomplete pairs, ranked and correlated, so that
    coverage comes from the same aggregation.
    """
    keys = [*by, "date"]
    x, y = complete_pair("factor_value", label)
    d = long.select(*keys, "asset", "factor_value", x.alias("_x"), y.alias("_y"))
    a, b = F.col("_x"), F.col("_y")
    if how.ranked and wide:
        for src, out in (("_x", "_rx"), ("_y", "_ry")):
            d = drop_stats(order_stats(d, keys, src, "_o", wide=True).withColumn(out, average_rank("_o")), "_o")
        a, b = F.col("_rx"), F.col("_ry")
    elif how.ranked:
        d = d.withColumns({"_rx": rank_expr("_x", keys, share=False), "_ry": rank_expr("_y", keys, share=False)})
        a, b = F.col("_rx"), F.col("_ry")
    daily = d.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        safe_corr(a, b).alias("rank_ic"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("factor_value").alias("n_values"),
    )
    return counted(daily, how)


def counted(daily: DataFrame, how: Convention) -> DataFrame:
    """``rank_ic`` kept only on dates that count."""
    enough = F.col("n") >= how.min_n
    if how.zero_degenerate:
        scored = F.when(enough, F.coalesce("rank_ic", F.lit(0.0))).when(F.col("n") > 0, 0.0)
    else:
        scored = F.when(enough, F.col("rank_ic"))
    return daily.withColumn("rank_ic", scored)


def frame_scores(df: DataFrame, factors: Sequence[str], how: Convention = STANDARD, label: str = "label", wide=False) -> DataFrame:
    """``date_scores`` of factor columns of a frame, without a row for each factor while dates fit a task."""
    if wide or not how.ranked:
        return date_scores(df.unpivot(["date", "asset", label], [F.col(f"`{f}`") for f in factors], "factor_id", "factor_value"), how, label=label, wide=wide)
    return counted(score_columns(df, factors, F.col(label)), how)


def daily_ic(
    long: DataFrame, how: Convention = STANDARD, by: Sequence[str] = ("factor_id",), label: str = "label", wide=False
) -> DataFrame:
    """(by..., date, n, rank_ic), dates below the minimum or without spread left out or kept as 0."""
    scored = date_scores(long, how, by, label, wide).filter(F.col("rank_ic").isNotNull())
    return scored.select(*by, "date", "n", "rank_ic")


def ic_aggregates(how: Convention) -> dict[str, Column]:
    """Mean, spread, ICIR, share of positive dates and number of dates."""
    spread = F.stddev_samp("rank_ic") if how.sample_std else F.stddev_pop("rank_ic")
    zero = F.lit(0.0)
    return {
        "n_dates": F.count("rank_ic"),
        "ic_mean": F.coalesce(F.avg("rank_ic"), zero),
        "ic_std": F.coalesce(spread, zero),
        "ic_ir": F.coalesce(ratio(F.avg("rank_ic"), spread), zero),
        "positive_ratio": F.coalesce(F.avg((F.col("rank_ic") > 0).cast("double")), zero),
    }


def summarize_ic(daily: DataFrame, how: Convention = STANDARD, by: Sequence[str] = ("factor_id",)) -> DataFrame:
    return daily.groupBy(*by).agg(*[c.alias(n) for n, c in ic_aggregates(how).items()])


def batch_rank_ic(
    long: DataFrame, how: Convention = STANDARD, by: Sequence[str] = ("factor_id",), label: str = "label", wide=False
) -> DataFrame:
    """One row per factor; a factor without a usable date scores zero everywhere."""
    return factor_scores(date_scores(long, how, by, label, wide), how, by)


def frame_rank_ic(df: DataFrame, factors: Sequence[str], how: Convention = STANDARD, label: str = "label", wide=False) -> DataFrame:
    """``batch_rank_ic`` of factor columns of a frame."""
    return factor_scores(frame_scores(df, factors, how, label, wide), how)


def factor_scores(scored: DataFrame, how: Convention = STANDARD, by: Sequence[str] = ("factor_id",)) -> DataFrame:
    """One row per factor from its dates."""
    share = ratio(F.sum("n_values").cast("double"), F.sum("n_rows"))
    return scored.groupBy(*by).agg(
        *[c.alias(n) for n, c in ic_aggregates(how).items()],
        F.when(F.count("rank_ic") > 0, share).otherwise(0.0).alias("coverage"),
    )


def ic_by_horizon(panel_long: DataFrame, labels: dict[int, str], how: Convention = STANDARD, wide=False) -> DataFrame:
    """Daily IC per (factor, horizon) from several label columns, in one pass."""
    ids = ["factor_id", "date", "asset", "factor_value"]
    stacked = panel_long.unpivot(ids, list(labels.values()), "_h", "label")
    horizon = F.create_map(*[F.lit(v) for h, name in labels.items() for v in (name, h)])
    stacked = stacked.withColumn("horizon", horizon[F.col("_h")]).drop("_h")
    return daily_ic(stacked, how, by=("factor_id", "horizon"), wide=wide)


def decay_curve(panel_long: DataFrame, labels: dict[int, str], how: Convention = STANDARD, wide=False) -> DataFrame:
    """Mean IC per window, the window of the largest absolute IC, and the half-life.

    The half-life is the shortest window whose absolute IC is below half of the peak (0 if none).
    """
    return curve_of(ic_by_horizon(panel_long, labels, how, wide), labels)


def curve_of(daily: DataFrame, labels: dict[int, str]) -> DataFrame:
    """``decay_curve`` from the daily IC of each (factor, horizon)."""
    per = daily.groupBy("factor_id", "horizon").agg(F.avg("rank_ic").alias("ic_mean"), F.count(F.lit(1)).alias("n_dates"))
    # A window without a usable date counts as an IC of 0.
    found = per.groupBy("factor_id").agg(F.map_from_entries(F.collect_list(F.struct("horizon", F.struct("ic_mean", "n_dates")))).alias("_m"))
    per = found.select("factor_id", F.explode(F.array(*map(F.lit, sorted(labels)))).alias("horizon"), "_m").withColumn("_v", F.col("_m")[F.col("horizon")])
    per = per.select("factor_id", "horizon", F.coalesce("_v.ic_mean", F.lit(0.0)).alias("ic_mean"), F.coalesce("_v.n_dates", F.lit(0)).alias("n_dates"))
    w = Window.partitionBy("factor_id")
    per = per.withColumns(
        {
            "best_window": F.max_by("horizon", F.struct(F.abs("ic_mean"), -F.col("horizon"))).over(w),
            "peak": F.max(F.abs("ic_mean")).over(w),
        }
    )
    fallen = (F.col("peak") > 0.001) & (F.abs("ic_mean") < F.col("peak") * 0.5)
    return per.withColumn("half_life", F.coalesce(F.min(F.when(fallen, F.col("horizon"))).over(w), F.lit(0)))


def ic_autocorrelation(daily: DataFrame, lags: int = 5) -> DataFrame:
    """Lag-1..k autocorrelation of each factor's IC series and their mean."""
    w = Window.partitionBy("factor_id").orderBy("date")
    d = daily.withColumns({f"_l{k}": F.lag("rank_ic", k).over(w) for k in range(1, lags + 1)})
    out = d.groupBy("factor_id").agg(*[safe_corr("rank_ic", f"_l{k}").alias(f"lag_{k}") for k in range(1, lags + 1)])
    total = sum((F.coalesce(f"lag_{k}", F.lit(0.0)) for k in range(1, lags + 1)), F.lit(0.0))
    return out.withColumn("stability", total / lags)


def sample_check(long: DataFrame, by: Sequence[str] = ("factor_id",), label: str = "label", min_rows: int = 50) -> DataFrame:
    """Rank IC of a selected sample: (by..., oos_rank_ic, oos_ic_ir, oos_positive_ratio, oos_n_days).

    A sample without gaps is correlated by date. One with gaps has no dates that fit its pairs: all its
    pairs are ranked together, whatever their number, and count as one day without a spread. Fewer
    than ``min_rows`` pairs give zeros.
    """
    by = list(by)
    x, y = complete_pair("factor_value", label)
    rows = long.select(*by, "date", "asset", x.alias("_x"), y.alias("_y"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.count("_x").alias("_pairs"))
    kind = F.when(F.col("_pairs") < min_rows, "few").when(F.col("_pairs") == F.col("_rows"), "dated").otherwise("whole")
    sizes = sizes.select(*by, kind.alias("_kind"))
    rows = attach(rows.filter(F.col("_x").isNotNull()), sizes, by, ["_kind"])

    keys = [*by, "date"]
    dated = rows.filter("_kind = 'dated'").withColumns({"_rx": rank_expr("_x", keys, share=False), "_ry": rank_expr("_y", keys, share=False)})
    days = dated.groupBy(*keys).agg(safe_corr("_rx", "_ry").alias("ic"))
    whole = rows.filter("_kind = 'whole'").withColumns({"_x": steady("_x"), "_y": steady("_y")})
    for side in ("_x", "_y"):
        whole = group_ranks(whole, by, side, ["date", "asset"], "_o")
        whole = drop_stats(whole.withColumn(f"_r{side}", average_rank("_o")), "_o")
    once = whole.groupBy(*by).agg(safe_corr("_r_x", "_r_y").alias("ic"))
    ics = days.select(*by, "ic").filter(F.col("ic").isNotNull()).unionByName(once)
    zero = F.lit(0.0)
    found = ics.groupBy(*by).agg(
        F.coalesce(F.avg("ic"), zero).alias("oos_rank_ic"),
        F.coalesce(F.avg("ic") / (F.stddev_samp("ic") + 1e-10), zero).alias("oos_ic_ir"),
        F.avg(F.coalesce((F.col("ic") > 0).cast("double"), zero)).alias("oos_positive_ratio"),
        F.count(F.lit(1)).alias("oos_n_days"),
    )
    cols = ["oos_rank_ic", "oos_ic_ir", "oos_positive_ratio", "oos_n_days"]
    return attach(sizes.drop("_kind"), found, by, cols).fillna(0, cols)


# -- quantiles, turnover, exposure ---------------------------------------------------------


def bucket_returns(long: DataFrame, n: int = 5, by: Sequence[str] = ("factor_id",), label: str = "label", wide=False) -> DataFrame:
    """Mean label per value bucket and date; dates with fewer distinct values than buckets are left out."""
    keys = [*by, "date"]
    pairs = long.filter(F.col("factor_value").isNotNull() & F.col(label).isNotNull())
    names = [f"_e{i}" for i in range(n)]
    d = with_quantiles(pairs, keys, "factor_value", {e: i / n for i, e in enumerate(names)}, wide=wide)
    steps = [
        ((F.col("factor_value") > F.col(e)) & (F.col(e) > F.col(before))).cast("int")
        for before, e in zip(names, names[1:])
    ]
    means = d.withColumn("bucket", sum(steps, F.lit(1))).groupBy(*keys, "bucket").agg(F.avg(label).alias("bucket_return"))
    return means.join(varied_dates(pairs, n, by), keys, "left_semi")


def varied_dates(long: DataFrame, n: int, by: Sequence[str] = ("factor_id",)) -> DataFrame:
    """Dates with at least ``n`` distinct factor values."""
    keys = [*by, "date"]
    values = long.filter(F.col("factor_value").isNotNull()).groupBy(*keys, "factor_value").agg(F.count(F.lit(1)).alias("_c"))
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd")).filter(F.col("_nd") >= n).drop("_nd")


def quantile_returns(long: DataFrame, n: int = 5, label: str = "label", wide=False) -> DataFrame:
    """Per factor: average return of each bucket (0 on dates without it), top minus bottom, share of rising steps."""
    return bucket_summary(bucket_returns(long, n, label=label, wide=wide), n)


def frame_quantile_returns(df: DataFrame, factors: Sequence[str], n: int = 5, label: str = "label", wide=False) -> DataFrame:
    """``quantile_returns`` of factor columns of a frame, all buckets of a date in one grouped pass while dates fit a task."""
    if wide:
        return quantile_returns(df.unpivot(["date", "asset", label], [F.col(f"`{f}`") for f in factors], "factor_id", "factor_value"), n, label, wide)
    return bucket_summary(bucket_columns(df, factors, n, label), n)


def bucket_summary(means: DataFrame, n: int = 5) -> DataFrame:
    """One row per factor from the mean label of its buckets."""
    per_date = means.groupBy("factor_id", "date").agg(
        *[F.coalesce(F.max(F.when(F.col("bucket") == i, F.col("bucket_return"))), F.lit(0.0)).alias(f"q{i}") for i in range(1, n + 1)]
    )
    row = per_date.groupBy("factor_id").agg(*[F.avg(f"q{i}").alias(f"q{i}") for i in range(1, n + 1)])
    steps = [(F.col(f"q{i + 1}") >= F.col(f"q{i}")).cast("double") for i in range(1, n)]
    return row.withColumns(
        {"long_short": F.col(f"q{n}") - F.col("q1"), "monotonicity": sum(steps, F.lit(0.0)) / (n - 1)}
    )


def long_short(long: DataFrame, by: Sequence[str] = ("factor_id",), label: str = "label", share: float = 0.2, min_n: int = 20, wide=False) -> DataFrame:
    """Per date: mean label of values at or above the top quantile minus at or below the bottom one."""
    keys = [*by, "date"]
    pairs = long.filter(F.col("factor_value").isNotNull() & F.col(label).isNotNull())
    d = with_quantiles(pairs, keys, "factor_value", {"_lo": share, "_hi": 1 - share}, wide=wide)
    return (
        d.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(F.col("factor_value") >= F.col("_hi"), F.col(label))).alias("_top"),
            F.avg(F.when(F.col("factor_value") <= F.col("_lo"), F.col(label))).alias("_bottom"),
        )
        .filter(F.col("n") >= min_n)
        .select(*keys, (F.col("_top") - F.col("_bottom")).alias("ls_return"))
    )


def date_sequence(df: DataFrame, by: Sequence[str], every: int = 1) -> DataFrame:
    """(by..., date, seq): distinct dates numbered in order, optionally each k-th only."""
    days = df.select(*by, "date").distinct()
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")
    numbered = days.withColumn("_p", F.row_number().over(w) - 1)
    kept = numbered.filter(F.col("_p") % every == 0)
    return kept.select(*by, "date", (F.col("_p") / every).cast("int").alias("seq"))


def top_members(long: DataFrame, share: float = 0.2, by: Sequence[str] = ("factor_id",), wide=False) -> DataFrame:
    """The top ``share`` of names per date (at least one), ties broken by asset."""
    keys = [*by, "date"]
    ranked = order_stats(
        long.filter(F.col("factor_value").isNotNull()), keys, "factor_value", "_o", descending=True, row_number=True, wide=wide
    )
    size = F.greatest(F.lit(1), F.floor(F.col("_o_n") * share))
    return drop_stats(ranked.filter(F.col("_o_rn") <= size).withColumn("members", size), "_o")


def frame_top_members(
    df: DataFrame, factors: Sequence[str], share: float = 0.2, keep: Sequence[str] = (), label: str | None = None, distinct: int = 0, wide=False
) -> DataFrame:
    """``top_members`` of factor columns of a frame: (factor_id, date, asset, keep...), found a date at a time while dates fit a task.

    With ``label`` only rows that have one take part; with ``distinct`` only dates of so many distinct values.
    """
    if not wide:
        return top_columns(df, factors, share, keep, label, distinct)
    cols = list(dict.fromkeys(["date", "asset", *keep, *([label] if label else [])]))
    long = df.unpivot(cols, [F.col(f"`{f}`") for f in factors], "factor_id", "factor_value")
    long = long.filter(F.col(label).isNotNull()) if label else long
    if distinct:
        long = long.join(varied_dates(long, distinct), ["factor_id", "date"], "left_semi")
    return top_members(long, share, wide=True).select("factor_id", "date", "asset", *keep)


def member_turnover(members: DataFrame, by: Sequence[str] = ("factor_id",), every: int = 1) -> DataFrame:
    """Share of a (k-th) date's members that are gone on the next one; dated by the next one."""
    seq = date_sequence(members, by, every)
    held = members.join(seq, [*by, "date"]).select(*by, "date", "seq", "asset")
    nxt = held.select(*by, (F.col("seq") - 1).alias("seq"), "asset", F.lit(1).alias("kept"))
    both = held.join(nxt, [*by, "seq", "asset"], "left")
    per = both.groupBy(*by, "seq").agg((1 - F.count("kept") / F.count(F.lit(1))).alias("turnover"))
    dates = seq.select(*by, (F.col("seq") - 1).alias("seq"), "date")
    return per.join(dates, [*by, "seq"]).select(*by, "date", "turnover")


def exposure(long: DataFrame, cap: str = "market_cap", group: str = "industry") -> DataFrame:
    """Per factor: |corr(value, ln cap)|, largest |industry mean| and the three largest industries."""
    d = long.withColumn("_lncap", F.log(F.greatest(F.col(cap), F.lit(1.0))))
    # Factors and their industries from one pass over the rows; the table behind it has a row for each.
    sets = d.groupingSets([["factor_id"], ["factor_id", group]], "factor_id", group).agg(
        F.grouping(group).alias("_all"), F.abs(safe_corr("factor_value", "_lncap")).alias("_c"), F.avg("factor_value").alias("m")
    )
    means = sets.withColumn("m", F.when(F.col("_all") == 0, F.col("m")))
    place = Window.partitionBy("factor_id").orderBy(F.abs("m").desc(), group)
    named = (F.col("_p") <= 3) & F.col("m").isNotNull()
    top = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.when(named, F.struct("_p", F.col(group).alias("g"))))), lambda s: s["g"]), ","
    )
    return (
        means.withColumn("_p", F.row_number().over(place))
        .groupBy("factor_id")
        .agg(
            F.coalesce(F.max(F.when(F.col("_all") == 1, F.col("_c"))), F.lit(0.0)).alias("cap_exposure"),
            F.max(F.abs("m")).alias("industry_exposure"),
            F.when(F.count("m") > 0, top).alias("top_industries"),
        )
    )


def pooled_corr(long: DataFrame, labels: dict[int, str]) -> DataFrame:
    """Pearson correlation over all rows at each horizon, one column per horizon."""
    return long.groupBy("factor_id").agg(
        *[F.coalesce(safe_corr("factor_value", c), F.lit(0.0)).alias(f"corr_{h}") for h, c in labels.items()]
    )
