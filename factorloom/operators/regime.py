"""Market regimes and regime-aware IC.  Works on one row per date after the first aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .ts import pct_change, running_product

def calendar():
    """One row per date is a calendar, so a single ordered window is bounded."""
    return Window.partitionBy(F.lit(0)).orderBy("date")


def market_return(panel: DataFrame) -> DataFrame:
    """Equal-weight mean of the assets' one-row returns per date."""
    r = panel.select("date", pct_change("close").alias("_r"))
    return r.groupBy("date").agg(F.avg("_r").alias("market_return")).filter(F.col("market_return").isNotNull())


def detect(market: DataFrame, fast: int = 20, slow: int = 60, band: float = 0.02) -> DataFrame:
    """(date, market_return, nav, regime, switched) by the spread of two means of the cumulative return."""
    d = market.withColumn("nav", running_product("market_return", calendar()))
    d = d.withColumns(
        {
            "_f": F.avg("nav").over(calendar().rowsBetween(-(fast - 1), 0)),
            "_s": F.avg("nav").over(calendar().rowsBetween(-(slow - 1), 0)),
            "_i": F.row_number().over(calendar()) - 1,
        }
    )
    spread = ratio("_f", F.col("_s") + 1e-10) - 1
    regime = (
        F.when(F.col("_i") < slow, "sideways").when(spread > band, "bull").when(spread < -band, "bear").otherwise("sideways")
    )
    d = d.withColumn("regime", regime)
    before = F.when(F.col("_i") > slow, F.lag("regime").over(calendar()))
    d = d.withColumn("switched", F.coalesce(F.col("regime") != before, F.lit(False)))
    return d.drop("_f", "_s", "_i")


def regime_stats(regimes: DataFrame) -> DataFrame:
    """Share of dates, mean return and volatility per regime, absent regimes included."""
    total = regimes.agg(F.count(F.lit(1)).alias("_t"), F.max_by("regime", "date").alias("current_regime"))
    per = regimes.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("market_return").alias("avg_return"),
        F.stddev_samp("market_return").alias("volatility"),
    )
    names = total.select("_t", "current_regime", F.explode(F.array(*[F.lit(r) for r in ("bear", "bull", "sideways")])).alias("regime"))
    d = names.join(per, "regime", "left").fillna(0, ["n_days", "avg_return", "volatility"])
    return d.withColumn("pct_days", F.col("n_days") / F.greatest("_t", F.lit(1))).drop("_t")


def last_transitions(regimes: DataFrame, n: int = 10) -> DataFrame:
    return regimes.filter("switched").orderBy(F.col("date").desc()).limit(n).select("date", "regime")


def regime_ic(daily: DataFrame, regimes: DataFrame) -> DataFrame:
    """IC by regime per factor, their frequency-weighted mean and the ratio to the overall spread."""
    labels = regimes.select("date", "regime")
    d = daily.join(labels, "date", "left").withColumn("regime", F.coalesce("regime", F.lit("sideways")))

    def only(r: str):
        return F.coalesce(F.avg(F.when(F.col("regime") == r, F.col("rank_ic"))), F.lit(0.0)).alias(f"{r}_ic")

    return d.groupBy("factor_id").agg(
        F.avg("rank_ic").alias("regime_adj_ic"),
        (F.avg("rank_ic") / (F.stddev_pop("rank_ic") + 1e-10)).alias("regime_adj_icir"),
        *[only(r) for r in ("bull", "bear", "sideways")],
    )
