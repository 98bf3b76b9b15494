"""Neutralisation, combination and crowding of factors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..functions.stats import complete_pair
from ..session import settle
from . import ic
from .gram import both_ways, co_moments, pair_corr
from .ordered import group_stats
from .together import rank_columns
from .ts import pct_change
from .xsec import demean, rank

# -- risk neutralisation --------------------------------------------------------------------


def residualize(df: DataFrame, y: str, x: str, out: str, min_n: int = 10, wide=False) -> DataFrame:
    """Per-date least-squares residual of y on x; 0 where a date has too few pairs or a row no pair.

    Also adds ``{out}_slope``, the date's slope (NULL where none was fitted).
    """
    a, b = complete_pair(x, y)
    d = df.withColumns({"_a": a, "_b": b})
    aggs = {
        "_n": F.count("_a"),
        "_cov": F.covar_pop("_a", "_b"),
        "_var": F.var_pop("_a"),
        "_ma": F.avg("_a"),
        "_mb": F.avg("_b"),
    }
    d = group_stats(d, ["date"], aggs, wide)
    slope = F.when(F.col("_n") >= min_n, ratio("_cov", "_var"))
    d = d.withColumn(f"{out}_slope", slope)
    resid = F.col("_b") - F.col("_mb") - F.col(f"{out}_slope") * (F.col("_a") - F.col("_ma"))
    return d.withColumn(out, F.coalesce(resid, F.lit(0.0))).drop("_a", "_b", *aggs)


def cap_column(df: DataFrame) -> str | None:
    """The first capitalisation column present, in order of preference."""
    return next((c for c in ("total_mv", "market_cap", "circ_mv", "float_market_cap") if c in df.columns), None)


def risk_neutralize(df: DataFrame, x: str, out: str, momentum_window: int = 20, wide=False) -> DataFrame:
    """Industry demean, then residual on ln(cap), then residual on past return.

    Keeps the slope columns ``_size_slope`` and ``_mom_slope`` for the exposure report.
    """
    d = df.withColumn("_v", F.col(x))
    if "industry" in df.columns:
        d = demean(d, "_v", "_v", ["date", "industry"], wide)
    cap = cap_column(df)
    if cap:
        d = d.withColumn("_lncap", F.log(F.greatest(F.col(cap), F.lit(1.0))))
        d = residualize(d, "_v", "_lncap", "_size", wide=wide).withColumn("_v", F.col("_size")).drop("_size", "_lncap")
    d = d.withColumn("_past", pct_change("close", momentum_window))
    d = residualize(d, "_v", "_past", "_mom", wide=wide).withColumn("_v", F.col("_mom")).drop("_mom", "_past")
    return d.withColumn(out, F.col("_v")).drop("_v")


def risk_exposures(df: DataFrame, x: str) -> DataFrame:
    """One row: largest |industry mean| of the raw factor and mean |slope| of each regression."""
    means = df.groupBy("industry").agg(F.avg(x).alias("m")).agg(F.max(F.abs("m")).alias("industry"))
    by_date = df.groupBy("date").agg(F.max("_size_slope").alias("s"), F.max("_mom_slope").alias("m"))
    slopes = by_date.agg(
        F.coalesce(F.avg(F.abs("s")), F.lit(0.0)).alias("market_cap"), F.coalesce(F.avg(F.abs("m")), F.lit(0.0)).alias("momentum")
    )
    return _one_row(means, slopes)


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side."""
    first = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        first = first.join(f.withColumn("_one", F.lit(1)), "_one")
    return first.drop("_one")


# -- selection and weights (one row per factor) -----------------------------------------------


def orthogonal_select(pairs: DataFrame, factors: DataFrame, threshold: float = 0.6, key: str = "factor_id") -> DataFrame:
    """(factor_id) of the greedy pass in factor order: a factor stays if its |corr| with all kept ones is within the threshold.

    That is the lexicographically first independent set of the graph of close pairs. It is
    found in rounds on the edge table: a factor without an earlier undecided neighbour is
    kept and its neighbours drop out. Rounds grow with the longest chain of close factors.
    """
    close = pairs.filter(F.abs("corr") > threshold).select(F.least("f1", "f2").alias("a"), F.greatest("f1", "f2").alias("b")).distinct()
    close = settle(close.join(factors.select(F.col(key).alias("a")), "a", "left_semi").join(factors.select(F.col(key).alias("b")), "b", "left_semi"))
    undecided = factors.select(F.col(key).alias("f")).distinct()
    kept = undecided.join(close.select(F.col("a").alias("f")).unionByName(close.select(F.col("b").alias("f"))), "f", "left_anti")
    undecided = undecided.join(kept, "f", "left_anti")
    while not close.isEmpty():
        first = undecided.join(close.select(F.col("b").alias("f")), "f", "left_anti").select("f", F.lit("kept").alias("state"))
        out = close.join(first.select(F.col("f").alias("a")), "a", "left_semi").select(F.col("b").alias("f"), F.lit("out").alias("state"))
        decided = settle(first.unionByName(out.distinct()))
        kept = kept.unionByName(decided.filter("state = 'kept'").select("f"))
        undecided = undecided.join(decided, "f", "left_anti")
        for end in "ab":
            close = close.join(decided.select(F.col("f").alias(end)), end, "left_anti")
        undecided, close = settle(undecided), settle(close)
    return kept.unionByName(undecided).select(F.col("f").alias(key))


def weigh(scores: DataFrame, method: str = "ic_weighted") -> DataFrame:
    """Factor weights from IC statistics: equal, or a floor-bounded share of IC or ICIR."""
    everyone = Window.partitionBy(F.lit(0))
    if method == "equal":
        value = F.lit(1.0)
    else:
        value = F.greatest(F.col("ic_mean" if method == "ic_weighted" else "ic_ir"), F.lit(0.001))
    d = scores.withColumn("_v", value)
    return d.withColumn("weight", F.round(F.col("_v") / F.sum("_v").over(everyone), 4)).drop("_v")


def crowding_penalty(weights: DataFrame, crowding: DataFrame, limit: float = 0.6) -> DataFrame:
    """Halve the weight of crowded factors and share out again; untouched when none is crowded."""
    everyone = Window.partitionBy(F.lit(0))
    d = weights.join(crowding.select("factor_id", "crowding"), "factor_id", "left")
    crowded = F.coalesce(F.col("crowding") > limit, F.lit(False))
    d = d.withColumn("_w", F.when(crowded, F.col("weight") * 0.5).otherwise(F.col("weight")))
    some = F.max(crowded.cast("int")).over(everyone) == 1
    shared = F.round(F.try_divide("_w", F.sum("_w").over(everyone)), 4)
    return d.withColumn("weight", F.when(some, shared).otherwise(F.col("_w"))).drop("_w")


def ridge_weights(returns: DataFrame, factors: Sequence[str], alpha: float = 0.1, min_dates: int = 20) -> dict[str, float] | None:
    """Ridge weights of daily long-short returns against their equal-weight mean.

    ``returns`` is long (factor_id, date, ls_return).  Spark reduces it to the factors x
    factors cross-product sums over dates common to all; the small solve is local.
    """
    factors = sorted(factors)
    if len(factors) < 3:
        return None
    table = returns.groupBy("date").pivot("factor_id", factors).agg(F.first("ls_return")).dropna(subset=factors)
    raw = F.col("cxy") + F.col("n") * F.col("mx") * F.col("my")
    sums = {(r["f1"], r["f2"]): (r["sxy"], r["n"]) for r in co_moments(table, factors).select("f1", "f2", raw.alias("sxy"), "n").collect()}
    if not sums or next(iter(sums.values()))[1] < min_dates:
        return None
    gram = np.array([[sums[min(a, b), max(a, b)][0] for b in factors] for a in factors])
    target = gram.mean(axis=1)
    w = np.abs(np.linalg.solve(gram + alpha * np.eye(len(factors)), target))
    if w.sum() < 1e-10:
        return None
    return {f: round(float(v), 4) for f, v in zip(factors, w / w.sum())}


def weighted_combine(df: DataFrame, weights: Mapping[str, float], out: str = "factor_value") -> DataFrame:
    """Weighted sum of factor columns, a missing value counting as 0."""
    total = sum((F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) * float(w) for f, w in sorted(weights.items())), F.lit(0.0))
    return df.withColumn(out, total)


def combine(df: DataFrame, factors: Sequence[str], method="ic_weighted", threshold=0.6, crowding_limit=0.6, wide=False) -> DataFrame:
    """Select, weigh, penalise and add up factor columns; scores of the combination in one row."""
    from ..plans.tree import long_form

    pairs = settle(pair_corr(df, factors))
    names = df.sparkSession.createDataFrame([(f,) for f in factors], "factor_id string")
    kept = sorted(r["factor_id"] for r in orthogonal_select(pairs, names, threshold).collect())  # names of columns of ``df``
    long = long_form(df, kept, ["label"])
    weights = None
    if method == "ridge":
        weights = ridge_weights(ic.long_short(long, wide=wide), kept)
    if weights is None:
        base = "ic_weighted" if method == "ridge" else method
        scored = weigh(ic.batch_rank_ic(long, wide=wide), base)
        if method != "ridge":
            scored = crowding_penalty(scored, crowding_scores(pairs), crowding_limit)
        weights = {r["factor_id"]: r["weight"] for r in scored.select("factor_id", "weight").collect()}
    total = weighted_combine(df, weights).select(
        F.lit("combined").alias("factor_id"), "date", "asset", "factor_value", "label"
    )
    result = ic.batch_rank_ic(total, wide=wide)
    names = F.lit(",".join(sorted(weights)))
    return result.withColumns({"factor_ids": names, "weights": F.lit(",".join(f"{weights[k]:.4f}" for k in sorted(weights)))})


def combine_rank_mean(long: DataFrame, wide=False) -> DataFrame:
    """Average of each factor's per-date percent rank: (date, asset, score, n_factors)."""
    ranked = rank(long, "factor_value", "_r", ["factor_id", "date"], wide=wide)
    return ranked.groupBy("date", "asset").agg(F.avg("_r").alias("score"), F.count("_r").alias("n_factors"))


def frame_rank_mean(df: DataFrame, factors: Sequence[str], wide=False) -> DataFrame:
    """``combine_rank_mean`` of factor columns of a frame: all ranks of a date in one grouped pass while dates fit a task."""
    if wide:
        return combine_rank_mean(df.unpivot(["date", "asset"], [F.col(f"`{f}`") for f in factors], "factor_id", "factor_value"), wide)
    xs = {f"_r{i}": f"_x{i}" for i in range(len(factors))}
    d = rank_columns(df.select("date", "asset", *[F.col(f"`{f}`").alias(x) for f, x in zip(factors, xs.values(), strict=True)]), xs)
    found = sum((F.col(r).isNotNull().cast("bigint") for r in xs), F.lit(0).cast("bigint"))
    total = sum((F.coalesce(r, F.lit(0.0)) for r in xs), F.lit(0.0))
    d = d.select("date", "asset", total.alias("_t"), found.alias("_k")).groupBy("date", "asset")
    return d.agg(ratio(F.sum("_t"), F.sum("_k")).alias("score"), F.sum("_k").alias("n_factors"))


# -- crowding -------------------------------------------------------------------------------


def crowding_scores(pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Mean and largest |corr| of each factor with the others, and whether it is crowded."""
    return (
        both_ways(pairs)
        .groupBy(F.col("f1").alias("factor_id"))
        .agg(
            F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("crowding"),
            F.coalesce(F.max(F.abs("corr")), F.lit(0.0)).alias("max_corr"),
            F.count("corr").alias("n_pairs"),
        )
        .withColumn("crowded", F.col("crowding") > threshold)
    )


def clusters(edges: DataFrame, min_size: int = 2, max_rounds: int = 50) -> DataFrame:
    """Connected components of an undirected edge list (f1, f2): (cluster, factor_id, size).

    Smallest-label propagation with label jumping, one pair of joins per round, until no
    label moves.  Hot nodes are safe: labels are reduced by a partial ``min``.
    """
    links = settle(both_ways(edges.select("f1", "f2")).distinct())
    labels = links.groupBy(F.col("f1").alias("node")).agg(F.least(F.min("f2"), F.first("f1")).alias("label"))
    labels = settle(labels)
    for _ in range(max_rounds):
        seen = links.join(labels.select(F.col("node").alias("f2"), "label"), "f2").groupBy(F.col("f1").alias("node")).agg(
            F.min("label").alias("near")
        )
        moved = labels.join(seen, "node").select("node", F.least("label", "near").alias("mid"), F.col("label").alias("old"))
        hop = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        nxt = settle(moved.join(hop, "mid", "left").select("node", "old", F.least("mid", "far").alias("label")))
        changed = nxt.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labels.join(sizes, "label").select(F.col("label").alias("cluster"), F.col("node").alias("factor_id"), "size")
