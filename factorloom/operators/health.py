"""Decay, drift, crowding trend and rolling Sharpe of factors; screening and risk flags.

Inputs are one row per (factor, date) or per factor: a factor's history is as long as
the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from . import ic
from .hypothesis import trend_fit


def by_factor_in_time():
    return Window.partitionBy("factor_id").orderBy("date")


def by_factor():
    return Window.partitionBy("factor_id")


def listed(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, comma separated."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs])), ",")


def ic_drift(daily: DataFrame, window: int = 60) -> DataFrame:
    """Mean of the last window against the best rolling mean."""
    least = max(5, window // 2)
    frame = by_factor_in_time().rowsBetween(-(window - 1), 0)
    d = daily.filter(F.col("rank_ic").isNotNull()).withColumns(
        {
            "_roll": F.when(F.count("rank_ic").over(frame) >= least, F.avg("rank_ic").over(frame)),
            "_back": F.row_number().over(by_factor().orderBy(F.col("date").desc())),
        }
    )
    out = d.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.avg(F.when(F.col("_back") <= window, F.col("rank_ic"))).alias("current_ic"),
        F.max("_roll").alias("_peak"),
    )
    out = out.filter(F.col("n_dates") >= window)
    out = out.withColumn("peak_ic", F.when(F.col("n_dates") <= window, F.col("current_ic")).otherwise(F.col("_peak")))
    cur, peak = F.col("current_ic"), F.col("peak_ic")
    decline = (
        F.when((peak > 0) & (cur > 0), (peak - cur) / peak * 100.0).when((peak <= 0) & (cur <= 0), 0.0).otherwise(100.0)
    )
    out = out.withColumn("decline_pct", decline)
    severity = F.when(F.col("decline_pct") > 70, "critical").when(F.col("decline_pct") > 50, "warning").otherwise("normal")
    return out.withColumns(
        {"drift_flagged": (F.col("decline_pct") > 50) & (cur > 0), "drift_severity": severity}
    ).drop("_peak")


def crowding_trend(history: DataFrame, score: str = "crowding_score", recent: int = 5) -> DataFrame:
    """Slope of the last five scores, and how many times in a row the score has risen up to now."""
    back = by_factor().orderBy(F.col("date").desc())
    d = history.filter(F.col(score).isNotNull()).withColumns(
        {"_b": F.row_number().over(back), "_up": F.col(score) > F.lag(score).over(by_factor_in_time())}
    )
    d = d.withColumn("_stop", F.min(F.when(~F.coalesce("_up", F.lit(False)), F.col("_b"))).over(by_factor()))
    out = d.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("n_scores"),
        F.max_by(score, "date").alias("current_crowding"),
        (F.min("_stop") - 1).alias("consecutive_increases"),
    )
    last = d.filter(F.col("_b") <= recent).withColumn("_t", -F.col("_b").cast("double"))
    slopes = trend_fit(last, score, "_t", ["factor_id"]).select("factor_id", "slope")
    out = out.join(slopes, "factor_id", "left")
    enough = F.col("n_scores") >= 3
    direction = (
        F.when(enough & (F.col("slope") > 0.005), "increasing").when(enough & (F.col("slope") < -0.005), "decreasing").otherwise("stable")
    )
    return out.withColumns({"trend_direction": direction, "crowding_flagged": F.col("consecutive_increases") >= 5})


def rolling_sharpe(nav: DataFrame, window: int = 60) -> DataFrame:
    """Current and best rolling Sharpe of a nav series per factor."""
    least = max(5, window // 2)
    d = nav.withColumn("_r", ratio("nav", F.lag("nav").over(by_factor_in_time())) - 1).filter(F.col("_r").isNotNull())
    frame = by_factor_in_time().rowsBetween(-(window - 1), 0)
    sharpe = ratio(F.avg("_r").over(frame), F.stddev_samp("_r").over(frame)) * (252.0**0.5)
    d = d.withColumn("_s", F.when(F.count("_r").over(frame) >= least, sharpe))
    out = d.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("n_returns"),
        F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("date"))).alias("current_sharpe"),
        F.max("_s").alias("peak_sharpe"),
    )
    out = out.filter(F.col("n_returns") >= window)
    fall = F.greatest(F.lit(0.0), (F.col("peak_sharpe") - F.col("current_sharpe")) / F.col("peak_sharpe") * 100.0)
    return out.withColumns(
        {
            "sharpe_decline_pct": F.when(F.col("peak_sharpe") > 0, fall).otherwise(0.0),
            "sharpe_flagged": F.col("current_sharpe") < 0,
        }
    )


def factor_health(drift: DataFrame, crowding: DataFrame, sharpe: DataFrame) -> DataFrame:
    """healthy / warning / critical from the three monitors."""
    d = drift.join(crowding, "factor_id", "full").join(sharpe, "factor_id", "full")

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    ic_bad = F.col("drift_severity") == "critical"
    ic_weak = F.col("drift_flagged") & ~ic_bad
    crowd_bad = F.col("crowding_flagged") & (F.col("consecutive_increases") >= 8)
    crowd_weak = F.col("crowding_flagged") & (F.col("consecutive_increases") < 8)
    sharpe_weak = ~F.col("sharpe_flagged") & (F.col("sharpe_decline_pct") > 50)
    d = d.withColumns(
        {
            "critical_count": yes(ic_bad) + yes(crowd_bad) + yes(F.col("sharpe_flagged")),
            "warning_count": yes(ic_weak) + yes(crowd_weak) + yes(sharpe_weak),
            "findings": listed(
                (ic_bad, "ic_collapse"),
                (ic_weak, "ic_decline"),
                (F.col("crowding_flagged"), "crowding_rising"),
                (F.col("sharpe_flagged"), "sharpe_negative"),
                (sharpe_weak, "sharpe_decline"),
            ),
        }
    )
    health = (
        F.when(F.col("critical_count") >= 2, "critical")
        .when((F.col("critical_count") >= 1) | (F.col("warning_count") >= 2), "warning")
        .otherwise("healthy")
    )
    return d.withColumn("overall_health", health)


def ic_trend(daily: DataFrame, min_dates: int = 20) -> DataFrame:
    """Slope and p of IC on its position; decaying / stable / insufficient."""
    d = daily.withColumn("_t", F.row_number().over(by_factor_in_time()).cast("double"))
    fit = trend_fit(d, "rank_ic", "_t", ["factor_id"])
    falling = (F.round("slope", 6) < -0.001) & (F.round("p_value", 6) < 0.05)
    status = F.when(F.col("n") < min_dates, "insufficient").when(falling, "decaying").otherwise("stable")
    return fit.withColumn("trend_status", status)


def decay_check(
    scored: DataFrame,
    trend: DataFrame,
    recent_dates: int = 20,
    decay_limit: float = 0.5,
    ic_floor: float = 0.01,
    icir_floor: float = 0.2,
    positive_floor: float = 0.45,
) -> DataFrame:
    """Full-sample against recent IC per factor, with status and action.

    ``scored`` is ``ic.date_scores`` under the decay convention; ``trend`` gives trend_status.
    """
    place = F.dense_rank().over(by_factor().orderBy(F.col("date").desc()))
    d = scored.withColumn("_recent", place <= recent_dates)

    def part(name: str, only: Column) -> list[Column]:
        v = F.when(only, F.col("rank_ic"))
        std = F.stddev_pop(v)
        return [
            F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias(f"{name}_ic"),
            F.round(F.coalesce(ratio(F.avg(v), std), F.lit(0.0)), 4).alias(f"{name}_icir"),
            F.round(F.coalesce(F.avg((v > 0).cast("double")), F.lit(0.0)), 4).alias(f"{name}_positive"),
        ]

    o = d.groupBy("factor_id").agg(
        *part("full", F.lit(True)), *part("recent", F.col("_recent")), F.sum(F.when(F.col("_recent"), F.col("n"))).alias("_rows")
    )
    thin = F.coalesce(F.col("_rows"), F.lit(0)) <= 50
    for m in ("ic", "icir", "positive"):
        o = o.withColumn(f"recent_{m}", F.when(thin, F.col(f"full_{m}")).otherwise(F.col(f"recent_{m}")))

    def fallen(m: str, floor: float) -> Column:
        full, recent = F.abs(f"full_{m}"), F.abs(f"recent_{m}")
        return F.when(full > floor, F.greatest(F.lit(0.0), 1.0 - F.try_divide(recent, full))).otherwise(0.0)

    o = o.withColumns({"ic_decay": fallen("ic", 0.001), "icir_decay": fallen("icir", 0.01)})
    o = o.join(trend.select("factor_id", "trend_status"), "factor_id", "left")
    state = F.coalesce("trend_status", F.lit("insufficient"))
    dead = (state == "decaying") | ((state == "insufficient") & (F.col("ic_decay") > decay_limit))
    weak = (
        (F.abs("recent_ic") < ic_floor)
        | ((F.abs("recent_icir") < icir_floor) & (F.abs("full_icir") >= icir_floor))
        | (F.col("recent_positive") < positive_floor)
    )
    o = o.withColumns(
        {
            "status": F.when(dead, "decayed").when(weak, "warning").otherwise("healthy"),
            "action": F.when(dead, "re_discover").when(weak, "re_evaluate").otherwise("monitor"),
            "reasons": listed(
                (state == "decaying", "trend"),
                ((state == "insufficient") & (F.col("ic_decay") > decay_limit), "ic_decay"),
                (~dead & (F.abs("recent_ic") < ic_floor), "ic_floor"),
                (~dead & (F.abs("recent_icir") < icir_floor) & (F.abs("full_icir") >= icir_floor), "icir_floor"),
                (~dead & (F.col("recent_positive") < positive_floor), "positive_ratio"),
            ),
        }
    )
    return o.drop("_rows")


def record_daily_ic(long: DataFrame, run_date, wide=False) -> DataFrame:
    """Rows to append to the IC log: each factor's mean IC under the decay convention."""
    scored = ic.batch_rank_ic(long, ic.DECAY, wide=wide)
    return scored.select("factor_id", F.lit(run_date).alias("date"), F.round("ic_mean", 6).alias("rank_ic"))


# The delivery thresholds.
DELIVERY = {
    "icir": 1.0,
    "rank_ic": 0.02,
    "positive_ratio": 0.55,
    "library_corr": 0.3,
    "turnover": 0.5,
    "cap_exposure": 0.3,
    "capacity": 5_000_000.0,
    "decay": 0.3,
}


def delivery_screen(scores: DataFrame, limits: dict[str, float] = DELIVERY) -> DataFrame:
    """Pass or fail against the delivery thresholds, with the names of the failed ones.

    Reads ic_mean, ic_ir, positive_ratio, stability_score, max_corr, turnover, cap_exposure,
    capacity, decay_ratio.
    """
    fallback = F.least(F.lit(1.0), 0.5 + F.coalesce("stability_score", F.lit(0.0)) * 0.3)
    positive = F.when(F.col("positive_ratio") == 0, fallback).otherwise(F.col("positive_ratio"))
    d = scores.withColumn("positive_ratio", positive)
    capacity, decay = F.col("capacity"), F.col("decay_ratio")
    failed = listed(
        (F.abs("ic_ir") < limits["icir"], "icir"),
        (F.abs("ic_mean") < limits["rank_ic"], "rank_ic"),
        (F.col("positive_ratio") < limits["positive_ratio"], "positive_ratio"),
        (F.col("max_corr") > limits["library_corr"], "library_corr"),
        (F.col("turnover") > limits["turnover"], "turnover"),
        (F.col("cap_exposure") > limits["cap_exposure"], "cap_exposure"),
        ((capacity > 0) & (capacity < limits["capacity"]), "capacity"),
        ((decay > 0) & (decay < limits["decay"]), "decay"),
    )
    return d.withColumn("fail_reasons", failed).withColumn("deliverable", F.col("fail_reasons") == "")


def risk_flags(report: DataFrame) -> DataFrame:
    """Report flags and strength bands."""
    short, long = F.abs("ic_1"), F.abs("ic_20")
    flags = listed(
        (F.col("ic_mean") < 0.02, "weak_ic"),
        (F.col("ic_ir") < 0.3, "low_icir"),
        (F.col("positive_ratio") < 0.55, "unstable_sign"),
        ((short > 0.01) & (long < short * 0.3), "fast_decay"),
        (F.col("turnover") > 0.5, "high_turnover"),
        (F.abs("cap_exposure") > 0.3, "size_exposure"),
        (F.col("capacity") < 5_000_000, "small_capacity"),
        (F.col("net_return") < F.col("gross_return") * 0.5, "cost_erosion"),
    )
    ic_, ir = F.abs("ic_mean"), F.abs("ic_ir")
    return report.withColumns(
        {
            "risk_flags": F.when(flags == "", "none").otherwise(flags),
            "ic_strength": F.when(ic_ > 0.05, "strong").when(ic_ > 0.02, "medium").otherwise("weak"),
            "icir_strength": F.when(ir > 2, "excellent").when(ir > 1, "good").when(ir > 0.5, "fair").otherwise("low"),
            "strengths": listed((ic_ > 0.03, "ic"), (ir > 1.0, "icir"), (F.col("sharpe") > 1.0, "sharpe")),
        }
    )


def governance_severity(crowded: Column, risk: Column) -> tuple[Column, Column]:
    """Bands for the number of crowded factors and for the risk score."""
    return (
        F.when(crowded > 5, "high").when(crowded > 2, "moderate").otherwise("low"),
        F.when(risk > 0.7, "high").when(risk > 0.4, "moderate").otherwise("low"),
    )
