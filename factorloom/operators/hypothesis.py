"""Multiple-testing corrections and t-tests over one-row-per-factor tables.

A family may hold any number of tests: places come from range partitions by p with a
table of offsets, the step-up minimum is carried back from range to range, and what a
family has in common is one aggregate joined to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bounded, col, ratio
from ..functions.stats import slope_p_value, t_two_sided_p
from .ranges import attach, step_up


def clean_p(p) -> Column:
    p = col(p)
    return F.coalesce(F.nanvl(p, F.lit(1.0)), F.lit(1.0))


def _family(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of each row's family on the row."""
    side = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return attach(df, side, by, list(aggs))


def benjamini_hochberg(df: DataFrame, p: str, key: str = "factor_id", alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Add rejected, adjusted_p, threshold, n_rejected, n_total."""
    rows = df.withColumn("_p", clean_p(p))
    d = step_up(rows, by, "_p", [key], lambda k, n: F.least(F.lit(1.0), F.col("_p") * n / k))
    passed = F.col("_p") <= alpha * F.col("_k") / F.col("_n")
    d = _family(d, by, {"n_rejected": F.coalesce(F.max(F.when(passed, F.col("_k"))), F.lit(0)).cast("bigint")})
    d = d.withColumn("rejected", F.col("_k") <= F.col("n_rejected"))
    d = _family(d, by, {"threshold": F.coalesce(F.max(F.when(F.col("rejected"), F.col("_p"))), F.lit(0.0))})
    kept = [c for c in df.columns if c not in ("n_total", "adjusted_p", "rejected", "threshold", "n_rejected")]
    return d.select(*kept, F.col("_n").alias("n_total"), F.col("_least").alias("adjusted_p"), "rejected", "threshold", "n_rejected")


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    d = _family(df.withColumn("_p", clean_p(p)), by, {"n_total": F.count(F.lit(1))})
    d = d.withColumns(
        {
            "threshold": alpha / F.col("n_total"),
            "adjusted_p": F.least(F.lit(1.0), F.col("_p") * F.col("n_total")),
            "rejected": F.col("_p") < alpha / F.col("n_total"),
        }
    )
    return _family(d, by, {"n_rejected": F.sum(F.col("rejected").cast("bigint"))}).drop("_p")


def apply_fdr(df: DataFrame, p: str, method: str = "bh", alpha: float = 0.05) -> DataFrame:
    if method == "bh":
        return benjamini_hochberg(df, p, alpha=alpha)
    if method == "bonferroni":
        return bonferroni(df, p, alpha)
    raise ValueError(f"unknown method {method}: use bh or bonferroni")


def mean_t(mean, std, n) -> Column:
    return col(mean) / F.greatest(col(std), F.lit(1e-10)) * F.sqrt(col(n).cast("double"))


def ic_p_value(daily: DataFrame) -> DataFrame:
    """Two-sided p of each factor's mean IC against zero."""
    d = daily.groupBy("factor_id").agg(
        F.avg("rank_ic").alias("ic_mean"), F.stddev_samp("rank_ic").alias("ic_std"), F.count("rank_ic").alias("n_dates")
    )
    t = mean_t("ic_mean", F.coalesce("ic_std", F.lit(0.0)), "n_dates")
    return d.withColumn("t_stat", t).withColumn(
        "p_value", t_two_sided_p("t_stat", F.greatest(F.col("n_dates") - 1, F.lit(1)))
    )


def screen_with_fdr(means: DataFrame, n_dates: int = 100, alpha: float = 0.05, method: str = "bh", std: float = 0.02) -> DataFrame:
    """Screen factors by the significance of their mean IC (fixed spread where none is known)."""
    spread = F.coalesce("ic_std", F.lit(std)) if "ic_std" in means.columns else F.lit(std)
    d = means.withColumn("raw_p", t_two_sided_p(mean_t("ic_mean", spread, F.lit(n_dates)), F.lit(max(n_dates - 1, 1))))
    return apply_fdr(d, "raw_p", method, alpha).withColumnRenamed("rejected", "significant")


def trend_fit(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """One-regressor least squares per group: slope, intercept, r2, p and n."""
    pair = F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    fit = df.groupBy(*by).agg(
        F.count(F.when(pair, 1)).alias("n"),
        F.covar_pop(a, b).alias("_c"),
        F.var_pop(a).alias("_vx"),
        F.var_pop(b).alias("_vy"),
        F.avg(a).alias("_mx"),
        F.avg(b).alias("_my"),
    )
    fit = fit.withColumn("slope", ratio("_c", "_vx"))
    r = bounded(ratio("_c", F.sqrt(F.col("_vx") * F.col("_vy"))), -1.0, 1.0)
    fit = fit.withColumn("_r", F.when(F.col("_vx") * F.col("_vy") > 0, r))
    return fit.select(
        *by,
        "n",
        "slope",
        (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"),
        (F.col("_r") * F.col("_r")).alias("r2"),
        slope_p_value("_r", "n").alias("p_value"),
    )
