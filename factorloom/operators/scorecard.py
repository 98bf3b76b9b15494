"""One scorecard row per factor: linear and rank IC, buckets, turnover, exposure, composite, decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bounded, ratio
from ..session import settle
from . import ic


def tradability(turnover="turnover") -> Column:
    return F.greatest(F.lit(0.0), 1.0 - F.least(F.col(turnover), F.lit(1.2)) / 1.2)


def stability(positive: Column, rank_positive: Column, first: Column, last: Column) -> Column:
    """Shares of positive IC dates and the clipped ratio of the longest to the shortest horizon."""
    kept = F.when(first != 0, bounded(F.try_divide(last, first), -1.0, 1.0)).otherwise(0.0)
    return bounded(0.45 * positive + 0.35 * rank_positive + 0.2 * F.greatest(kept, F.lit(0.0)), 0.0, 1.0)


def composite(originality: Column | float = 1.0) -> Column:
    """Seven-term weighted score, capped at 1."""
    def part(w: float, c, times: float = 1.0) -> Column:
        return w * F.greatest(F.coalesce(c, F.lit(0.0)) * times, F.lit(0.0))

    originality = F.lit(originality) if not isinstance(originality, Column) else originality
    total = (
        part(0.2, F.col("ic_mean"), 10)
        + part(0.2, F.col("rank_ic_mean"), 10)
        + part(0.15, F.col("ic_ir"))
        + part(0.15, F.col("monotonicity"))
        + part(0.1, F.col("stability_score"))
        + part(0.1, F.col("tradability_score"))
        + part(0.1, originality)
    )
    return F.least(total, F.lit(1.0))


def evaluate_metrics(
    long: DataFrame, labels: dict[int, str], label: str = "label", wide=False, overlap: DataFrame | None = None, frame: DataFrame | None = None
) -> DataFrame:
    """All scorecard numbers of every factor; only rows with a value and a label count.

    ``overlap`` has (factor_id, max_corr), the largest |corr| with another factor of the library; without one a factor is original.
    ``frame`` has the same rows with a column for each factor and no others than ``long``; buckets and top names are
    then found a date at a time.
    """
    pairs = long.filter(F.col("factor_value").isNotNull() & F.col(label).isNotNull())
    linear = ic.batch_rank_ic(pairs, ic.SCORECARD_LINEAR, label=label, wide=wide).select(
        "factor_id", "ic_mean", "ic_ir", F.col("positive_ratio").alias("_pos"), "coverage"
    )
    ranked = ic.batch_rank_ic(pairs, ic.SCORECARD_RANK, label=label, wide=wide).select(
        "factor_id", F.col("ic_mean").alias("rank_ic_mean"), F.col("positive_ratio").alias("_rpos")
    )
    if frame is not None:
        factors = sorted(set(frame.columns) - set(long.columns))
        members = ic.frame_top_members(frame, factors, 0.2, label=label, distinct=5, wide=wide)
        buckets = ic.frame_quantile_returns(frame, factors, label=label, wide=wide)
    else:
        members = ic.top_members(pairs.join(ic.varied_dates(pairs, 5), ["factor_id", "date"], "left_semi"), 0.2, wide=wide)
        buckets = ic.quantile_returns(pairs, label=label, wide=wide)
    turnover = ic.member_turnover(settle(members)).groupBy("factor_id").agg(F.avg("turnover").alias("turnover"))
    horizons = sorted(labels)
    decay = ic.pooled_corr(pairs, labels)
    out = linear.join(ranked, "factor_id")
    for side in (buckets, turnover, decay, ic.exposure(pairs)):
        out = out.join(side, "factor_id", "left")
    if overlap is not None:
        out = out.join(overlap.select("factor_id", "max_corr"), "factor_id", "left")
    else:
        out = out.withColumn("max_corr", F.lit(0.0))
    out = out.fillna(0.0, ["turnover", "long_short", "monotonicity", "max_corr"])
    out = out.withColumn("originality_score", F.greatest(F.lit(0.0), 1.0 - F.col("max_corr")))
    first, last = F.col(f"corr_{horizons[0]}"), F.col(f"corr_{horizons[-1]}")
    out = out.withColumns(
        {"stability_score": stability(F.col("_pos"), F.col("_rpos"), first, last), "tradability_score": tradability()}
    )
    return out.withColumn("composite_score", composite(F.col("originality_score"))).drop("_pos", "_rpos")


def constraint_scores(specs: DataFrame, max_depth: int = 6) -> DataFrame:
    """Originality, hypothesis alignment, complexity and safety from a table of factor specs.

    Reads max_corr, hypothesis, family, monotonicity and tree_depth.
    """
    aligned = (
        0.6
        + F.when((F.col("family") != "") & F.contains(F.lower("hypothesis"), F.lower("family")), 0.2).otherwise(0.0)
        + F.least(F.lit(0.2), F.greatest(F.coalesce("monotonicity", F.lit(0.0)), F.lit(0.0)) * 0.2)
    )
    empty = F.coalesce(F.col("hypothesis"), F.lit("")) == ""
    return specs.withColumns(
        {
            "originality_score": F.greatest(F.lit(0.0), 1.0 - F.coalesce("max_corr", F.lit(0.0))),
            "alignment_score": F.when(empty, 0.45).otherwise(F.least(aligned, F.lit(1.0))),
            "complexity_score": 1.0 - F.least(F.col("tree_depth") / max(max_depth, 1), F.lit(1.0)) * 0.55,
            "safety_score": F.when(F.col("tree_depth") > 0, 0.95).otherwise(0.0),
        }
    )


def decide(scores: DataFrame) -> DataFrame:
    """approved / observe / rejected from coverage, originality, ICIR and monotonicity."""
    def weak(c: str, least: float) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0)) < least

    verdict = (
        F.when(F.col("coverage") < 0.7, "rejected")
        .when(weak("originality_score", 0.45) | weak("ic_ir", 0.25) | weak("monotonicity", 0.55), "observe")
        .otherwise("approved")
    )
    return scores.withColumn("decision", verdict)


def checks(scores: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Named validation checks, one row per factor and check."""
    curve = [F.col(f"corr_{h}") for h in horizons]
    rows = {
        "coverage_check": F.col("coverage") >= 0.7,
        "monotonicity_check": F.col("monotonicity") >= 0.55,
        "decay_profile": F.greatest(*curve) >= F.least(*curve),
        "neutralization_check": F.greatest(F.abs("cap_exposure"), F.abs("industry_exposure")) < 0.35,
    }
    table = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in rows.items()])
    return scores.select("factor_id", F.explode(table).alias("c")).select("factor_id", "c.check", "c.passed")


def verdict(scores: DataFrame) -> DataFrame:
    """useful / marginal / useless from absolute IC, ICIR and coverage."""
    mean, info = F.abs("ic_mean"), F.abs("ic_ir")
    v = F.when((mean >= 0.03) & (info >= 0.5) & (F.col("coverage") >= 0.7), "useful").when(mean >= 0.015, "marginal")
    return scores.withColumn("verdict", v.otherwise("useless"))


def library_correlation(pairs: DataFrame, library: Sequence[str]) -> DataFrame:
    """Largest |corr| of each factor with the library panels, and the closest member."""
    from .gram import both_ways

    near = both_ways(pairs).filter(F.col("f2").isin(list(library)) & F.col("corr").isNotNull())
    order = F.struct(F.abs("corr").alias("a"), F.col("f2"))
    return near.groupBy(F.col("f1").alias("factor_id")).agg(
        F.max(F.abs("corr")).alias("max_corr"), F.max_by("f2", order).alias("closest"), F.count(F.lit(1)).alias("n_compared")
    )


def novelty(
    candidates: DataFrame, library: DataFrame, penalty: float = 0.3, bonus: float | str = 0.3, top: int = 10, excluded: DataFrame | None = None
) -> DataFrame:
    """Rank hypotheses (key, family) by how rare their family is in the library, plus an exploration bonus.

    ``bonus`` is a number or a column name of the candidates; families in ``excluded`` are left out.
    """
    if excluded is not None:
        candidates = candidates.join(excluded.select("family").distinct(), "family", "left_anti")
    everyone = Window.partitionBy(F.lit(0))
    share = library.groupBy("family").agg(F.count(F.lit(1)).alias("_f"))
    share = share.withColumn("share", F.col("_f") / F.sum("_f").over(everyone)).drop("_f")
    d = candidates.join(share, "family", "left").fillna(0.0, ["share"])
    fresh = F.greatest(F.lit(0.1), 1.0 - F.col("share"))
    extra = F.col(bonus) if isinstance(bonus, str) else F.lit(bonus)
    d = d.withColumns({"novelty_score": F.greatest(F.lit(0.0), fresh - penalty * F.col("share")), "bonus": extra})
    return d.orderBy((F.col("novelty_score") + F.col("bonus")).desc(), "key").limit(top)


def exploration_bonus(failed, findings):
    """Bonus of a little-explored family from its failed patterns and findings."""
    none = (failed == 0) & (findings == 0)
    return F.when(none, 0.3).otherwise(F.least(F.lit(0.5), 0.1 * failed + 0.05 * findings))
