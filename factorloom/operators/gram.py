"""Correlation of many columns at once, without emitting column pairs per row.

Each task folds its rows into one centred F x F state (counts, means, co-moments) and
emits it once; states are merged by the pairwise update, so that nothing cancels where
the mean is far above the spread. The panel itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio

# A mean is kept as an anchor near the values and the offset from it, so that the difference of two means is exact to the last bit of the spread.
STATE = ("n", "hx", "hy", "lx", "ly", "cxx", "cyy", "cxy")
FAN_IN = 64  # states of that many groups of tasks are merged first


def batch_state(x: np.ndarray) -> dict[str, np.ndarray]:
    """n, mean of i where j has a value (anchor h plus offset l), and the centred moments, for all pairs (i, j) of the columns of ``x``."""
    has = ~np.isnan(x)
    m = has.astype(float)
    anchor = np.where(has, x, 0.0).sum(0) / np.maximum(m.sum(0), 1)
    d = np.where(has, x - anchor, 0.0)
    n = m.T @ m
    low = (d.T @ m) / np.maximum(n, 1)
    high = np.broadcast_to(anchor[:, None], n.shape)
    return {"n": n, "h": high, "l": low, "cxx": (d * d).T @ m - n * low**2, "cxy": d.T @ d - n * low * low.T}


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The pairwise update of two states."""
    n = a["n"] + b["n"]
    some, first = np.maximum(n, 1), a["n"] > 0
    apart = np.where(first & (b["n"] > 0), (b["h"] - a["h"]) + (b["l"] - a["l"]), 0.0)
    weight = a["n"] * b["n"] / some
    return {
        "n": n,
        "h": np.where(first, a["h"], b["h"]),
        "l": np.where(first, a["l"] + apart * b["n"] / some, b["l"]),
        "cxx": a["cxx"] + b["cxx"] + apart**2 * weight,
        "cxy": a["cxy"] + b["cxy"] + apart * apart.T * weight,
    }


def _update(acc: Column, s: Column) -> Column:
    """The same for two states of one pair of columns."""
    n, first = acc["n"] + s["n"], acc["n"] > 0
    weight = F.coalesce(ratio(acc["n"] * s["n"], n), F.lit(0.0))
    share = F.coalesce(ratio(s["n"], n), F.lit(0.0))
    dx = F.when(first & (s["n"] > 0), (s["hx"] - acc["hx"]) + (s["lx"] - acc["lx"])).otherwise(0.0)
    dy = F.when(first & (s["n"] > 0), (s["hy"] - acc["hy"]) + (s["ly"] - acc["ly"])).otherwise(0.0)
    return F.struct(
        n.alias("n"),
        F.when(first, acc["hx"]).otherwise(s["hx"]).alias("hx"),
        F.when(first, acc["hy"]).otherwise(s["hy"]).alias("hy"),
        F.when(first, acc["lx"] + dx * share).otherwise(s["lx"]).alias("lx"),
        F.when(first, acc["ly"] + dy * share).otherwise(s["ly"]).alias("ly"),
        (acc["cxx"] + s["cxx"] + dx * dx * weight).alias("cxx"),
        (acc["cyy"] + s["cyy"] + dy * dy * weight).alias("cyy"),
        (acc["cxy"] + s["cxy"] + dx * dy * weight).alias("cxy"),
    )


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    zero = F.struct(*[F.lit(0.0).alias(c) for c in STATE])
    listed = F.sort_array(F.collect_list(F.struct(*STATE)))  # in one order whatever task came first
    return states.groupBy(*by).agg(F.aggregate(listed, zero, _update).alias("s")).select(*by, "s.*")


def pair_names(cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Both names of every pair of sorted columns, and the pair's place in a state."""
    upper, names = np.triu_indices(len(cols)), np.array(cols, dtype=object)
    return names[upper[0]], names[upper[1]], upper


def state_columns(state: dict[str, np.ndarray], upper: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """The values of a state, one for each pair."""
    h, low, cxx = state["h"], state["l"], state["cxx"]
    values = {"n": state["n"], "hx": h, "hy": h.T, "lx": low, "ly": low.T, "cxx": cxx, "cyy": cxx.T, "cxy": state["cxy"]}
    return {k: v[upper] for k, v in values.items()}


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(f1, f2, n, mx, my, cxx, cyy, cxy) over rows where both columns have a value; f1 <= f2."""
    cols = sorted(cols)
    left, right, upper = pair_names(cols)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            s = batch_state(batch[cols].to_numpy(dtype=float))
            state = s if state is None else merged(state, s)
        if state is not None:
            yield pd.DataFrame({"f1": left, "f2": right} | state_columns(state, upper))

    schema = "f1 string, f2 string, " + ", ".join(f"{s} double" for s in STATE)
    return whole_moments(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).mapInPandas(fold, schema))


def whole_moments(partial: DataFrame) -> DataFrame:
    """``co_moments`` from the states of parts of the rows."""
    partial = partial.withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    got = merge_states(merge_states(partial, ["f1", "f2", "_task"]).drop("_task"), ["f1", "f2"])
    means = {"mx": F.col("hx") + F.col("lx"), "my": F.col("hy") + F.col("ly")}
    return got.withColumns(means).select("f1", "f2", "n", "mx", "my", "cxx", "cyy", "cxy")


def pair_corr(df: DataFrame, cols: Sequence[str], min_n: int = 20) -> DataFrame:
    """(f1, f2, n, corr) for f1 < f2; corr is NULL under ``min_n`` pairs or on a constant side."""
    return corr_of(co_moments(df, cols), min_n)


def corr_of(moments: DataFrame, min_n: int = 20) -> DataFrame:
    """``pair_corr`` from co-moments."""
    s = moments.filter(F.col("f1") < F.col("f2"))
    n = F.col("n")
    # what rounding alone leaves of a constant column
    spread = (F.col("cxx") > 1e-26 * n * F.col("mx") ** 2) & (F.col("cyy") > 1e-26 * n * F.col("my") ** 2)
    corr = F.when((n >= min_n) & spread, ratio(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy")))
    return s.select("f1", "f2", n.cast("bigint").alias("n"), corr.alias("corr"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each undirected pair once per direction."""
    flipped = pairs.withColumns({"f1": F.col("f2"), "f2": F.col("f1")})
    return pairs.unionByName(flipped)


def widen(long: DataFrame, factors: Sequence[str], value: str = "factor_value") -> DataFrame:
    """Long factor rows to one row per (date, asset) with a column per factor."""
    return long.groupBy("date", "asset").pivot("factor_id", list(factors)).agg(F.first(value, ignorenulls=True))
