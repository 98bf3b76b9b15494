"""Performance of return series: one row per series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .regime import market_return
from .ts import compound, running_product


def performance(returns: DataFrame, r: str, by: Sequence[str], order: str = "date", per_year: float = 252.0) -> DataFrame:
    """Total and annual return, volatility, Sharpe, drawdown, Calmar, information ratio, batting average."""
    w = Window.partitionBy(*by).orderBy(order)
    d = returns.withColumn("_nav", running_product(r, w))
    d = d.withColumn("_peak", F.max("_nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        (compound(r) - 1).alias("total_return"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_std"),
        F.avg(r).alias("_mean"),
        F.min(ratio("_nav", "_peak") - 1).alias("max_drawdown"),
        F.avg((F.col(r) > 0).cast("double")).alias("batting_average"),
    )
    growth = F.pow(1 + F.col("total_return"), F.lit(per_year) / F.col("n_periods")) - 1
    out = out.withColumns(
        {
            "annual_return": F.when(F.col("total_return") > -1, growth).otherwise(-1.0),
            "annual_volatility": F.col("_std") * per_year**0.5,
        }
    )
    zero = F.lit(0.0)
    return out.withColumns(
        {
            "sharpe": F.coalesce(ratio("annual_return", "annual_volatility"), zero),
            "calmar": F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).otherwise(0.0),
            "information_ratio": F.coalesce(ratio("_mean", "_std") * per_year**0.5, zero),
        }
    ).drop("_std", "_mean")


def net_of_cost(periods: DataFrame, notional: float) -> DataFrame:
    """Gross and net return and the cost drag of period returns with period costs against a fixed notional."""
    net = F.col("period_return") - F.coalesce("cost", F.lit(0.0)) / notional
    d = periods.withColumn("_net", net)
    out = d.agg(
        (compound("period_return") - 1).alias("gross_return"),
        (compound("_net") - 1).alias("net_return"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    return out.withColumns(
        {"cost_ratio": F.col("total_cost") / notional, "cost_drag": F.greatest(F.lit(0.0), F.col("gross_return") - F.col("net_return"))}
    )


def top_book(
    long: DataFrame, share: float = 0.2, label: str = "label", by: Sequence[str] = ("factor_id",), rate: Column | float = 0.002, wide=False, members: DataFrame | None = None
) -> DataFrame:
    """Per factor the equal-weight book of its top names, held for one label each: gross and net return, net Sharpe, mean number of names.

    What a date's turnover costs at a round-trip rate is taken off that date's return. ``members``
    are the top names with their label where they are known.
    """
    from .ic import member_turnover, top_members

    keys = [*by, "date"]
    members = top_members(long, share, by, wide) if members is None else members
    held = members.groupBy(*keys).agg(F.avg(label).alias("_r"), F.count(F.lit(1)).alias("_k")).filter(F.col("_r").isNotNull())
    d = held.join(member_turnover(members, by), keys, "left")
    d = d.withColumn("_net", F.col("_r") - F.coalesce("turnover", F.lit(0.0)) * rate)
    return d.groupBy(*by).agg(
        (compound("_r") - 1).alias("gross_return"),
        (compound("_net") - 1).alias("net_return"),
        (ratio(F.avg("_net"), F.stddev_samp("_net")) * math.sqrt(252.0)).alias("sharpe"),
        F.avg("_k").alias("n_positions"),
    )


def ic_vs_return(scores: DataFrame) -> DataFrame:
    """Sharpe predicted from IC and breadth against the realised one.

    Reads ic_mean, coverage, n_positions and sharpe.
    """
    predicted = F.col("ic_mean") * F.sqrt(F.greatest("n_positions", F.lit(1.0)) * 12.0)
    on = F.col("ic_mean") > 0
    d = scores.withColumn("predicted_sharpe", F.when(on, predicted).otherwise(0.0))
    p, a = F.col("predicted_sharpe"), F.col("sharpe")
    verdict = (
        F.when(~on, "no_signal")
        .when(a > p * 1.2, "ic_understates")
        .when(a < p * 0.5, "ic_overstates")
        .when(a < p * 0.8, "ic_mildly_overstates")
        .otherwise("consistent")
    )
    lost = F.when(on & (F.col("coverage") > 0), 1.0 - F.least(ratio(a, p), F.lit(1.0))).otherwise(1.0)
    return d.withColumns(
        {"correlation_bias": F.when(on, ratio(p - a, p)).otherwise(0.0), "ic_inefficiency": lost, "verdict": verdict}
    )


def market_periods(panel: DataFrame, periods: DataFrame) -> DataFrame:
    """Equal-weight return of all names with a close on both ends of each period."""
    ends = periods.filter(F.col("next_date").isNotNull())
    a = panel.join(ends.select("date", "period"), "date").select("period", "asset", F.col("close").alias("_s"))
    b = panel.join(ends.select(F.col("next_date").alias("date"), "period"), "date").select("period", "asset", F.col("close").alias("_e"))
    r = a.join(b, ["period", "asset"]).groupBy("period").agg(F.avg(ratio("_e", "_s") - 1).alias("market_return"))
    return ends.select("period").join(r, "period", "left").fillna(0.0, ["market_return"])


def attribution(periods: DataFrame) -> DataFrame:
    """Alpha, beta and unexplained share of period_return on market_return."""
    d = periods.agg(
        F.covar_pop("period_return", "market_return").alias("_c"),
        F.var_pop("market_return").alias("_v"),
        F.var_pop("period_return").alias("_vy"),
        F.avg("period_return").alias("_my"),
        F.avg("market_return").alias("_mx"),
    )
    beta = F.coalesce(ratio("_c", "_v"), F.lit(0.0))
    d = d.withColumn("market_beta", beta)
    return d.select(
        "market_beta",
        (F.col("_my") - F.col("market_beta") * F.col("_mx")).alias("alpha"),
        (1.0 - F.coalesce(ratio(F.col("_c") * F.col("_c"), F.col("_v") * F.col("_vy")), F.lit(0.0))).alias("residual"),
    )


def equal_weight_nav(panel: DataFrame) -> DataFrame:
    """The equal-weight market as one price series (asset = 'market')."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    m = market_return(panel).withColumn("close", 100.0 * running_product("market_return", w))
    return m.select("date", F.lit("market").alias("asset"), "close")
