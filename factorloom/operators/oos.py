"""Sample splits, walk-forward folds and out-of-sample validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bounded, col, ratio
from . import ic


def oos_split(df: DataFrame, months: int = 6, days: int | None = None) -> DataFrame:
    """Add ``is_test``: dates after the last date minus N months (or a fixed number of days)."""
    last = df.agg(F.max("date").alias("_last"))
    cutoff = F.date_sub("_last", days) if days else F.add_months("_last", -months)
    side = F.broadcast(last.select(cutoff.alias("cutoff"), F.lit(1).alias("_one")))
    d = df.withColumn("_one", F.lit(1)).join(side, "_one").drop("_one")
    return d.withColumn("is_test", F.col("date") > F.col("cutoff"))


def split_summary(split: DataFrame, min_train: int = 120, min_test: int = 40) -> DataFrame:
    """Rows, dates and assets on each side, and whether there is enough of both."""
    def side(test: bool, c: str) -> Column:
        return F.count_distinct(F.when(F.col("is_test") == test, F.col(c)))

    out = split.agg(
        F.max("cutoff").alias("cutoff"),
        F.min("date").alias("train_start"),
        F.max("date").alias("test_end"),
        side(False, "date").alias("train_dates"),
        side(True, "date").alias("test_dates"),
        side(False, "asset").alias("train_assets"),
        side(True, "asset").alias("test_assets"),
        F.count_if(~F.col("is_test")).alias("train_rows"),
        F.count_if("is_test").alias("test_rows"),
    )
    enough = (F.col("train_dates") >= min_train) & (F.col("test_dates") >= min_test)
    return out.withColumn("sufficient", enough)


def positional_split(df: DataFrame, ratio_: float = 0.7, min_side: int = 30) -> DataFrame:
    """Per-asset split by position: the first share of rows trains, at least ``min_side`` on each side.

    Assets with fewer than two full sides are dropped.
    """
    share = min(max(ratio_, 0.3), 0.9)
    w = Window.partitionBy("asset")
    d = df.withColumns({"_i": F.row_number().over(w.orderBy("date")), "_n": F.count(F.lit(1)).over(w)})
    at = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(min_side)), F.col("_n") - min_side)
    return d.filter(F.col("_n") >= 2 * min_side).withColumn("is_test", F.col("_i") > at).drop("_i", "_n")


def walk_forward_folds(dates: DataFrame, train: int, test: int, step: int, min_folds: int = 2) -> DataFrame:
    """(fold, date, part): each date of each rolling window, from a table of distinct dates.

    The number of dates is a calendar, not a panel; its numbering is the only global window.
    """
    numbered = dates.select("date").distinct().withColumn("_p", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    total = numbered.agg(F.count(F.lit(1)).alias("_t"))
    n_folds = F.greatest(F.floor((F.col("_t") - train - test) / step) + 1, F.lit(0)).cast("int")
    folds = total.select(n_folds.alias("_k")).filter(F.col("_k") >= min_folds).select(
        F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("fold")
    )
    spans = folds.select("fold", F.explode(F.sequence(F.col("fold") * step, F.col("fold") * step + train + test - 1)).alias("_p"))
    part = F.when(F.col("_p") - F.col("fold") * step < train, "train").otherwise("test")
    return spans.join(numbered, "_p").select("fold", "date", part.alias("part"))


def fold_sizes(panel: DataFrame, parts: DataFrame, min_train: int = 100, min_test: int = 40) -> DataFrame:
    """(fold, train_rows, test_rows, usable): panel rows on each side of every fold."""
    rows = panel.select("date").join(parts, "date").groupBy("fold").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"), F.count_if(F.col("part") == "test").alias("test_rows")
    )
    return rows.withColumn("usable", (F.col("train_rows") >= min_train) & (F.col("test_rows") >= min_test))


def usable_folds(panel: DataFrame, parts: DataFrame, min_train: int = 100, min_test: int = 40) -> DataFrame:
    """The (fold, date, part) rows of folds with enough panel rows on both sides."""
    return parts.join(fold_sizes(panel, parts, min_train, min_test).filter("usable").select("fold"), "fold", "left_semi")


def with_cost(checks: DataFrame, impact: DataFrame) -> DataFrame:
    """Checks with turnover, cost in basis points and test IC less the cost's share; no turnover costs nothing."""
    d = checks.join(impact.select("factor_id", "turnover", "cost_impact_bps", "ic_penalty"), "factor_id", "left")
    d = d.fillna(0.0, ["turnover", "cost_impact_bps", "ic_penalty"])
    return d.withColumn("cost_adj_ic", F.col("test_ic") - F.col("ic_penalty")).drop("ic_penalty")


def with_stability_ratio(summary: DataFrame) -> DataFrame:
    """Each factor's walk-forward row with the share of factors that are stable."""
    everyone = Window.partitionBy(F.lit(0))  # one row per factor
    return summary.withColumn("stability_ratio", F.avg(F.col("stable").cast("double")).over(everyone))


def passed_rule(train="train_ic", test="test_ic") -> Column:
    train, test = col(train), col(test)
    return (test > 0) & ((train <= 0) | (ratio(test, train + 1e-10) > 0.5))


def validate(ics: DataFrame) -> DataFrame:
    """Decay from train to test and the pass rule."""
    decay = F.when(F.col("train_ic") > 0, 1.0 - ratio("test_ic", F.col("train_ic") + 1e-10)).otherwise(0.0)
    return ics.withColumns({"oos_decay": decay, "passed": passed_rule()})


def diagnose(checks: DataFrame) -> DataFrame:
    """Diagnosis, robustness and recommendation per factor."""
    train, test, decay = F.col("train_ic"), F.col("test_ic"), F.col("oos_decay")
    better, steady = test > train * 1.1, (decay < 0.3) & F.col("passed")
    diagnosis = (
        F.when(better | steady, "healthy")
        .when(F.col("passed") & (decay > 0.5), "overfit")
        .when((test < 0) & (train > 0.02), "structural_break")
        .otherwise("weak_signal")
    )
    robustness = F.when(better, "strong").when(steady, "solid").otherwise("marginal")
    d = checks.withColumns({"diagnosis": diagnosis, "robustness": robustness})
    advice = (
        F.when(F.col("robustness") == "strong", "promote")
        .when(F.col("diagnosis") == "overfit", "iterate")
        .otherwise("observe")
    )
    return d.withColumn("recommendation", advice)


def family_summary(checks: DataFrame, top: int = 3) -> DataFrame:
    """Pass rate and the families that pass or fail most (family: id up to the first underscore, else the whole id)."""
    fam = F.substring_index("factor_id", "_", 1)
    per = checks.withColumn("family", fam).groupBy("family").agg(
        F.count_if("passed").alias("good"), F.count_if(~F.col("passed")).alias("bad")
    )

    def best(c: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("o"), "family"))))
        return F.array_join(F.transform(F.slice(rows, 1, top), lambda r: r["family"]), ",")

    return per.agg(
        (F.sum("good") / F.greatest(F.sum(F.col("good") + F.col("bad")), F.lit(1))).alias("pass_rate"),
        best("good").alias("top_families"),
        best("bad").alias("worst_families"),
    )


def walk_forward_summary(fold_ics: DataFrame) -> DataFrame:
    """Stability of test IC over folds, per factor (at least two folds)."""
    w = Window.partitionBy("factor_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    d = fold_ics.withColumn("_cum", F.sum("test_ic").over(w)).withColumn("_peak", F.max("_cum").over(w))
    out = d.groupBy("factor_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("test_ic").alias("mean_oos_ic"),
        F.stddev_samp("test_ic").alias("std_oos_ic"),
        F.avg((F.col("test_ic") > 0).cast("double")).alias("win_rate"),
        F.max(F.col("_peak") - F.col("_cum")).alias("max_ic_drawdown"),
    )
    return out.filter("n_windows >= 2").withColumns(
        {
            "oos_ic_ir": F.col("mean_oos_ic") / F.greatest("std_oos_ic", F.lit(1e-10)),
            "stable": (F.col("win_rate") >= 0.6) & (F.col("mean_oos_ic") > 0),
        }
    )


def bounded_score(value, worst: float) -> Column:
    return bounded(1.0 - col(value) / worst, 0.0, 1.0)


def stability_score(folds: DataFrame, params: Sequence[str]) -> DataFrame:
    """Score of walk-forward folds from returns, drawdowns and how often one parameter set wins."""
    pick = F.concat_ws("|", *[F.col(p).cast("string") for p in params])
    d = folds.withColumn("_params", pick)
    modes = d.groupBy("_params").agg(F.count(F.lit(1)).alias("_c")).agg(
        F.max("_c").alias("_top"), F.count(F.lit(1)).alias("parameter_regime_count"), F.sum("_c").alias("_all")
    )
    core = d.agg(
        F.avg((F.col("test_annual_return") > 0).cast("double")).alias("positive_test_ratio"),
        F.avg((F.col("test_annual_return") > F.col("baseline_test_annual_return")).cast("double")).alias("beat_baseline_ratio"),
        F.stddev_pop("test_annual_return").alias("test_annual_return_std"),
        F.stddev_pop("test_max_drawdown").alias("test_max_drawdown_std"),
        F.avg("test_annual_return").alias("avg_test_annual_return"),
        F.avg("test_sharpe").alias("avg_test_sharpe"),
        F.avg("test_max_drawdown").alias("avg_test_max_drawdown"),
        F.avg("baseline_test_annual_return").alias("avg_baseline_annual_return"),
    )
    one = core.withColumn("_one", F.lit(1)).join(modes.withColumn("_one", F.lit(1)), "_one").drop("_one")
    one = one.withColumn("dominant_parameter_ratio", F.col("_top") / F.col("_all")).drop("_top", "_all")
    score = (
        F.col("positive_test_ratio") * 0.28
        + F.col("beat_baseline_ratio") * 0.28
        + bounded_score("test_annual_return_std", 0.30) * 0.18
        + bounded_score(F.abs("test_max_drawdown_std"), 0.20) * 0.14
        + F.col("dominant_parameter_ratio") * 0.12
    )
    one = one.withColumn("stability_score", score)
    label = F.when(score >= 0.75, "strong").when(score >= 0.55, "medium").otherwise("weak")
    return one.withColumn("stability_label", label)


def research_score(stability: DataFrame) -> DataFrame:
    """Five bounded components of a walk-forward study in one score."""
    excess = F.col("avg_test_annual_return") - F.col("avg_baseline_annual_return")
    score = (
        bounded(F.col("avg_test_annual_return") / 0.25, 0, 1) * 0.30
        + bounded(F.col("avg_test_sharpe") / 1.5, 0, 1) * 0.22
        + bounded_score(F.abs("avg_test_max_drawdown"), 0.25) * 0.16
        + bounded(excess / 0.15, 0, 1) * 0.12
        + F.col("stability_score") * 0.20
    )
    label = F.when(score >= 0.78, "strong").when(score >= 0.58, "medium").otherwise("weak")
    return stability.withColumns({"excess_annual_return": excess, "research_score": score, "research_label": label})
