"""Trading signals per asset, their long-only returns, parameter grids and strategy books."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bounded, holds, ratio
from ..functions.stats import safe_corr
from .together import held as values_of
from .ts import previous_extremes, series, trend_features, ts_mean


def _filtered(buy: Column, trend: bool, max_volatility: float | None) -> Column:
    if trend:
        buy = buy & (F.col("close") > F.col("trend_ma"))
    return buy & (F.col("volatility") <= max_volatility) if max_volatility is not None else buy


def _signal(buy: Column, sell: Column) -> Column:
    return F.when(holds(sell), -1).when(holds(buy), 1).otherwise(0)


def ma_cross(df: DataFrame, short: int = 5, long: int = 20, trend=False, max_volatility=None, trend_window=60, vol_window=20) -> DataFrame:
    """+1 when the short mean crosses above the long one, -1 below (no cross on the first row)."""
    d = df.withColumns({"_s": ts_mean("close", short), "_l": ts_mean("close", long)})
    if trend or max_volatility is not None:
        d = trend_features(d, trend_window, vol_window)
    w = series()
    s, l, ps, pl = F.col("_s"), F.col("_l"), F.lag("_s").over(w), F.lag("_l").over(w)
    d = d.withColumns({"_buy": (s > l) & (ps <= pl), "_sell": (s < l) & (ps >= pl)})
    d = d.withColumn("signal", _signal(_filtered(F.col("_buy"), trend, max_volatility), F.col("_sell")))
    return d.select(*df.columns, "signal")


def channel_breakout(df: DataFrame, enter: int = 20, leave: int = 40, trend=False, max_volatility=None, trend_window=60, vol_window=20) -> DataFrame:
    """+1 above the highest close of the previous full window, -1 below the lowest."""
    up, down = series().rowsBetween(-enter, -1), series().rowsBetween(-leave, -1)
    d = df.withColumns(
        {
            "_u": F.when(F.count("close").over(up) == enter, F.max("close").over(up)),
            "_d": F.when(F.count("close").over(down) == leave, F.min("close").over(down)),
        }
    )
    if trend or max_volatility is not None:
        d = trend_features(d, trend_window, vol_window)
    buy = _filtered(F.col("close") > F.col("_u"), trend, max_volatility)
    return d.withColumn("signal", _signal(buy, F.col("close") < F.col("_d"))).select(*df.columns, "signal")


def positions(df: DataFrame, by: Sequence[str] = ("asset",), commission=0.0003, slippage=0.0002) -> DataFrame:
    """Row returns of holding from a buy to the next sell, with entry and exit cost.

    The last non-zero signal decides the position, so no row-by-row state is needed
    (valid without a stop loss and without a minimum holding time).
    """
    w = Window.partitionBy(*by).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(upto)
    d = df.withColumn("position", F.coalesce((state == 1).cast("int"), F.lit(0)))
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    d = d.withColumns(
        {"_before": before, "_move": F.coalesce(ratio("close", F.lag("close").over(w)), F.lit(1.0)), "_base": F.first("close").over(w)}
    )
    d = d.withColumns({"entered": (F.col("position") == 1) & (F.col("_before") == 0), "left": (F.col("position") == 0) & (F.col("_before") == 1)})
    growth = (
        F.when(F.col("_before") == 1, F.col("_move")).otherwise(1.0)
        * F.when(F.col("entered"), 1.0 / (1.0 + commission + slippage)).otherwise(1.0)
        * F.when(F.col("left"), 1.0 - commission - slippage).otherwise(1.0)
    )
    d = d.withColumns(
        {
            "growth": growth,
            "benchmark_return": ratio("close", "_base") - 1,
            "trade_no": F.sum(F.col("entered").cast("int")).over(upto),
        }
    )
    equity = F.exp(F.sum(F.log("growth")).over(upto))
    d = d.withColumn("equity", equity)
    d = d.withColumns(
        {
            "daily_return": F.coalesce(ratio("equity", F.lag("equity").over(w)) - 1, F.lit(0.0)),
            "drawdown": ratio("equity", F.max("equity").over(upto)) - 1,
        }
    )
    return d.drop("_before", "_move", "_base")


def signal_metrics(held: DataFrame, by: Sequence[str] = ("asset",), per_year: float = 252.0) -> DataFrame:
    """Backtest metrics per series from ``positions``."""
    trades = held.filter(F.col("entered") | F.col("left")).groupBy(*by, "trade_no").agg(
        F.max(F.when(F.col("entered"), F.col("close"))).alias("_in"), F.max(F.when(F.col("left"), F.col("close"))).alias("_out")
    )
    wins = trades.groupBy(*by).agg(F.avg(F.when(F.col("_out").isNotNull(), (F.col("_out") > F.col("_in")).cast("double"))).alias("win_rate"))
    out = held.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.max_by("equity", "date") - 1).alias("total_return"),
        F.max_by("benchmark_return", "date").alias("benchmark_return"),
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(ratio(F.avg("daily_return"), F.stddev_samp("daily_return")) * per_year**0.5, F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.stddev_samp("daily_return"), F.lit(0.0)).alias("_sd"),
        F.sum((F.col("entered") | F.col("left")).cast("bigint")).alias("trade_count"),
    )
    return _yearly(out.join(wins, list(by), "left").fillna(0.0, ["win_rate"]), per_year)


def _yearly(out: DataFrame, per_year: float) -> DataFrame:
    return out.withColumns(
        {
            "annual_return": F.pow(1 + F.col("total_return"), F.lit(per_year) / F.col("rows")) - 1,
            "excess_return": F.col("total_return") - F.col("benchmark_return"),
            "realized_volatility": F.col("_sd") * per_year**0.5,
        }
    ).drop("_sd")


def grid(shorts: Sequence[int], longs: Sequence[int]) -> list[tuple[int, int]]:
    return [(s, l) for s, l in product(shorts, longs) if s < l]


def ma_grid(df: DataFrame, combos: Sequence[tuple[int, int]]) -> DataFrame:
    """Signals of every parameter pair: each window's mean once, then one row per pair."""
    w = series()
    spans = sorted({k for pair in combos for k in pair})
    d = df.withColumns({f"_m{k}": ts_mean("close", k) for k in spans})
    d = d.withColumns({f"_p{k}": F.lag(f"_m{k}").over(w) for k in spans})

    def sig(s: int, l: int) -> Column:
        up = (F.col(f"_m{s}") > F.col(f"_m{l}")) & (F.col(f"_p{s}") <= F.col(f"_p{l}"))
        down = (F.col(f"_m{s}") < F.col(f"_m{l}")) & (F.col(f"_p{s}") >= F.col(f"_p{l}"))
        return _signal(up, down)

    rows = F.array(*[F.struct(F.lit(s).alias("short"), F.lit(l).alias("long"), sig(s, l).alias("signal")) for s, l in combos])
    return d.select(*df.columns, F.explode(rows).alias("g")).select(*df.columns, "g.*")


def channel_grid(df: DataFrame, combos: Sequence[tuple[int, int]]) -> DataFrame:
    d = previous_extremes(df, "close", [k for pair in combos for k in pair])
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("short"),
                F.lit(l).alias("long"),
                _signal(F.col("close") > F.col(f"_u{s}"), F.col("close") < F.col(f"_d{l}")).alias("signal"),
            )
            for s, l in combos
        ]
    )
    return d.select(*df.columns, F.explode(rows).alias("g")).select(*df.columns, "g.*")


FILTERS = {"none": (False, False), "trend": (True, False), "volatility": (False, True), "both": (True, True)}


def strategy_signals(
    df: DataFrame, combos: dict[str, Sequence[tuple[int, int]]], max_volatility: float, trend_window: int = 60, vol_window: int = 20
) -> tuple[DataFrame, list[tuple[str, int, int, str]]]:
    """``df`` with ``signals``, an array of the signals of both strategies for all their windows and all filters; and the (strategy, short, long, filters) of its places.

    Means, extremes, trend and volatility are computed once for all of the grid, over one partitioning.
    """
    w, ma, channel = series(), combos.get("ma_cross", ()), combos.get("channel_breakout", ())
    spans = sorted({k for pair in ma for k in pair})
    d = trend_features(df, trend_window, vol_window).withColumns({f"_m{k}": ts_mean("close", k) for k in spans})
    d = d.withColumns({f"_p{k}": F.lag(f"_m{k}").over(w) for k in spans})
    if channel:
        d = previous_extremes(d, "close", [k for pair in channel for k in pair])
    rules = []
    for s, l in ma:
        now, was = (F.col(f"_m{s}"), F.col(f"_m{l}")), (F.col(f"_p{s}"), F.col(f"_p{l}"))
        rules.append(("ma_cross", s, l, (now[0] > now[1]) & (was[0] <= was[1]), (now[0] < now[1]) & (was[0] >= was[1])))
    for s, l in channel:
        rules.append(("channel_breakout", s, l, F.col("close") > F.col(f"_u{s}"), F.col("close") < F.col(f"_d{l}")))
    made = {
        (name, s, l, f): _signal(_filtered(buy, trend, max_volatility if vol else None), sell).cast("tinyint")
        for name, s, l, buy, sell in rules
        for f, (trend, vol) in FILTERS.items()
    }
    return d.select(*df.columns, F.array(*made.values()).alias("signals")), list(made)


def strategy_grid(df: DataFrame, combos: dict[str, Sequence[tuple[int, int]]], max_volatility: float, trend_window: int = 60, vol_window: int = 20) -> DataFrame:
    """``strategy_signals`` in rows: ``df`` with strategy, short, long, filters and signal."""
    d, places = strategy_signals(df, combos, max_volatility, trend_window, vol_window)
    rows = [
        F.struct(
            F.lit(name).alias("strategy"), F.lit(s).alias("short"), F.lit(l).alias("long"), F.lit(f).alias("filters"),
            F.col("signals")[i].cast("int").alias("signal"),
        )
        for i, (name, s, l, f) in enumerate(places)
    ]
    return d.select(*df.columns, F.explode(F.array(*rows)).alias("g")).select(*df.columns, "g.*")


def _backtest(close: np.ndarray, known: np.ndarray, signal: np.ndarray, at: int | None, cost: float) -> dict[str, np.ndarray]:
    """What ``positions`` and ``signal_metrics`` find for the columns of ``signal``, all over the same closes; ``at`` is the row of the last date."""
    n, k = signal.shape
    row = np.arange(n)[:, None]
    ahead = lambda x, first: np.concatenate([np.full((1, k), first), x[:-1]])
    latest = lambda hit: np.maximum.accumulate(np.where(hit, row, -1), axis=0)
    set_at = latest(signal != 0)
    position = (set_at >= 0) & (np.take_along_axis(signal, np.maximum(set_at, 0), 0) == 1)
    before = ahead(position, False)
    entered, left = position & ~before, ~position & before
    move = np.ones(n)
    move[1:] = np.where(known[1:] & known[:-1] & (close[:-1] != 0), close[1:] / close[:-1], 1.0)
    growth = np.where(before, move[:, None], 1.0) * np.where(entered, 1.0 / (1.0 + cost), 1.0) * np.where(left, 1.0 - cost, 1.0)
    counts = ~(growth <= 0)  # a logarithm that is no NULL
    has = np.logical_or.accumulate(counts, axis=0)
    equity = np.exp(np.cumsum(np.where(counts, np.log(growth), 0.0), axis=0))
    was = ahead(equity, 0.0)
    daily = np.where(has & ahead(has, False) & (was != 0), equity / was - 1, 0.0)
    peak = np.maximum.accumulate(np.where(has, equity, -np.inf), axis=0)
    fall = np.fmin.reduce(np.where(has & (peak != 0), equity / peak - 1, np.inf), axis=0)
    spread = daily.std(axis=0, ddof=1) if n > 1 else np.zeros(k)
    bought = np.maximum(latest(entered), 0)
    closed = left & known[:, None] & known[bought]
    won = (closed & (close[:, None] > close[bought])).sum(axis=0)
    none = np.full(k, np.nan)
    total = none if at is None else np.where(has[at], equity[at] - 1, np.nan)
    moved = at is not None and known[at] and known[0] and close[0] != 0
    return {
        "total_return": total,
        "benchmark_return": np.full(k, close[at] / close[0] - 1) if moved else none,
        "max_drawdown": np.where(np.isinf(fall), np.nan, fall),
        "_sharpe": np.where(spread != 0, daily.mean(axis=0) / spread, 0.0),
        "_sd": spread,
        "trade_count": (entered | left).sum(axis=0),
        "win_rate": won / np.maximum(closed.sum(axis=0), 1),
    }


def grid_metrics(df: DataFrame, places: Sequence[tuple[str, int, int, str]], commission=0.0003, slippage=0.0002, per_year: float = 252.0) -> DataFrame:
    """``signal_metrics`` of the ``positions`` of every place of ``signals``, by asset, strategy, short, long and filters.

    An asset's rows (at most one for each date) are taken once for the whole grid and its places are columns of one
    matrix, so there is neither a row nor a sort for each place of the grid.
    """
    heads = [pa.array(c, t) for c, t in zip(zip(*places), (pa.string(), pa.int32(), pa.int32(), pa.string()))]
    reals = ["total_return", "benchmark_return", "max_drawdown", "_sharpe", "_sd", "win_rate"]
    schema = T.StructType([
        df.schema["asset"],
        *(T.StructField(c, t) for c, t in zip(("strategy", "short", "long", "filters"), (T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType()))),
        *(T.StructField(c, T.LongType()) for c in ("rows", "trade_count")),
        *(T.StructField(c, T.DoubleType()) for c in reals),
    ])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.column("date"), null_placement="at_start"))
        close, known = values_of(rows.column("close"))
        signal = rows.column("signals").combine_chunks().flatten().to_numpy().reshape(len(rows), len(places))
        with np.errstate(all="ignore"):
            got = _backtest(close, known, signal, None if rows.column("date")[-1].as_py() is None else len(rows) - 1, commission + slippage)
        same = rows.column("asset").take(pa.array([0] * len(places)))
        cols = [same, *heads, pa.array([len(rows)] * len(places), pa.int64()), pa.array(got["trade_count"], pa.int64())]
        return pa.table(cols + [pa.array(got[c], pa.float64(), from_pandas=True) for c in reals], names=schema.names)

    out = df.groupBy("asset").applyInArrow(run, schema)
    return _yearly(out.withColumn("sharpe", F.col("_sharpe") * per_year**0.5).drop("_sharpe"), per_year)


GRIDS = {"ma_cross": ma_grid, "channel_breakout": channel_grid}


def leaderboard(metrics: DataFrame, by: Sequence[str], n: int | None = None) -> DataFrame:
    d = metrics.orderBy(F.col("annual_return").desc(), F.col("sharpe").desc(), *by)
    return d.limit(n) if n else d


def walk_forward(df: DataFrame, strategy: str, combos, base: tuple[int, int], train: int, test: int, step: int) -> DataFrame:
    """Per asset and fold: the best parameters on the training rows and their result on the test rows.

    Every fold part is its own series (indicators restart), so folds and assets run side
    by side in one job.
    """
    w = Window.partitionBy("asset")
    d = df.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(w)})
    lo = F.greatest(F.lit(0), F.ceil((F.col("_i") - (train + test) + 1) / step)).cast("int")
    hi = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - train - test) / step)).cast("int")
    d = d.filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    part = F.when(F.col("_i") - F.col("fold") * step < train, "train").otherwise("test")
    d = d.withColumn("part", part).select(F.struct("asset", "fold", "part").alias("asset"), "date", "close")
    run = GRIDS[strategy](d, sorted({*combos, base}))
    m = signal_metrics(positions(run, ["asset", "short", "long"]), ["asset", "short", "long"]).select("asset.*", *[
        c for c in ("short", "long", "annual_return", "sharpe", "max_drawdown", "total_return")
    ])
    score = F.struct("annual_return", "sharpe", -F.col("short"), -F.col("long"))
    best = m.filter("part = 'train'").groupBy("asset", "fold").agg(
        F.max_by(F.struct("short", "long"), score).alias("p"), F.max("annual_return").alias("train_annual_return")
    ).select("asset", "fold", "p.*", "train_annual_return")
    tests = m.filter("part = 'test'").drop("part")
    chosen = best.join(tests.select("asset", "fold", "short", "long", *[
        F.col(c).alias(f"test_{c}") for c in ("annual_return", "sharpe", "max_drawdown")
    ]), ["asset", "fold", "short", "long"])
    plain = tests.filter((F.col("short") == base[0]) & (F.col("long") == base[1])).select(
        "asset", "fold", F.col("annual_return").alias("baseline_test_annual_return")
    )
    return chosen.join(plain, ["asset", "fold"])


def strategy_correlation(returns: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Pairwise correlation of daily returns, missing days 0 (one row per strategy pair)."""
    table = returns.groupBy("date").pivot("strategy", list(strategies)).agg(F.first("daily_return")).fillna(0.0)
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1 :]]
    one = table.agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def compare(table: DataFrame) -> DataFrame:
    """Composite strategy score from grid, test, research and stability results."""
    score = 0.2 * F.col("grid_best_sharpe") + 0.25 * F.col("test_sharpe") + 0.35 * F.col("research_score") + 0.2 * F.col("stability_score")
    return table.withColumn("composite_score", score).orderBy(F.col("composite_score").desc(), "strategy")


def constrained_weights(ranking: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score share less correlation, clipped, scaled to a target volatility (one row per strategy).

    ``ranking``: strategy, composite_score, realized_volatility, max_drawdown; ``pairs``:
    s1, s2, corr.  The table has one row per strategy, so global windows are tiny.
    """
    all_ = Window.partitionBy(F.lit(0))
    top = Window.partitionBy(F.lit(0)).orderBy(F.col("composite_score").desc(), "strategy")
    flipped = pairs.unionByName(pairs.withColumns({"s1": F.col("s2"), "s2": F.col("s1")}))
    total = flipped.groupBy(F.col("s1").alias("strategy")).agg(F.sum(F.abs("corr")).alias("_c"))
    d = ranking.join(total, "strategy", "left").withColumns(
        {"_n": F.count(F.lit(1)).over(all_), "_k": F.row_number().over(top)}
    )
    head = F.col("_k") <= 3
    d = d.withColumns(
        {
            "_dd": F.avg(F.when(head, F.abs("max_drawdown"))).over(all_),
            "_vol": F.avg(F.when(head, F.col("realized_volatility"))).over(all_),
            "_score": F.greatest("composite_score", F.lit(0.0001)),
        }
    )
    d = d.withColumns(
        {
            "target_volatility": F.round(bounded(F.when(F.col("_vol") > 0, F.col("_vol") * 0.9).otherwise(0.16), 0.08, 0.25), 4),
            "max_drawdown_limit": F.round(bounded(F.when(F.col("_dd") > 0, F.col("_dd") * 1.15).otherwise(0.18), 0.08, 0.3), 4),
            "max_single_weight": F.round(bounded(1.0 / F.least(F.col("_n"), F.lit(3)) + 0.1, 0.45, 0.7), 4),
        }
    )
    # Mean |corr| over the matrix column, the diagonal included.
    penalty = F.greatest(1.0 - (1.0 + F.coalesce("_c", F.lit(0.0))) / F.col("_n"), F.lit(0.1))
    d = d.withColumn("_a", F.col("_score") / F.sum("_score").over(all_) * penalty)
    d = d.withColumn("_a", F.col("_a") / F.sum("_a").over(all_))
    low = F.when(F.col("_n") >= 2, 0.1).otherwise(1.0)
    d = d.withColumn("_a", F.least(F.greatest(F.col("_a"), low), F.col("max_single_weight")))
    d = d.withColumn("_a", F.col("_a") / F.sum("_a").over(all_))
    d = d.withColumn("_pv", F.sum(F.col("_a") * F.col("realized_volatility")).over(all_))
    over = F.col("_pv") > F.col("target_volatility")
    d = d.withColumn("_a", F.when(over, F.greatest(F.col("_a") * F.col("target_volatility") / F.col("_pv"), F.lit(0.05))).otherwise(F.col("_a")))
    d = d.withColumn("weight", F.col("_a") / F.sum("_a").over(all_))
    d = d.withColumns(
        {
            "portfolio_volatility": F.sum(F.col("weight") * F.col("realized_volatility")).over(all_),
            "expected_drawdown": F.sum(F.col("weight") * F.abs("max_drawdown")).over(all_),
        }
    )
    w = d.select(F.col("strategy").alias("s2"), F.col("weight").alias("_w2"))
    mixed = flipped.join(w, "s2").groupBy(F.col("s1").alias("strategy")).agg(F.sum(F.col("corr") * F.col("_w2")).alias("_x"))
    d = d.join(mixed, "strategy", "left")
    blended = F.sum(F.col("weight") * (F.col("weight") + F.coalesce("_x", F.lit(0.0)))).over(all_)
    d = d.withColumn("diversification_score", bounded(1.0 - F.greatest(F.lit(0.0), blended), 0.0, 1.0))
    eps = 1e-6
    return d.withColumns(
        {
            "within_volatility": F.col("portfolio_volatility") <= F.col("target_volatility") + eps,
            "within_drawdown": F.col("expected_drawdown") <= F.col("max_drawdown_limit") + eps,
            "within_single_weight": F.max("weight").over(all_) <= F.col("max_single_weight") + eps,
        }
    ).drop("_c", "_n", "_k", "_dd", "_vol", "_score", "_a", "_pv", "_x")
