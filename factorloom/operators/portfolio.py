"""Weights, rebalances, period returns, turnover, cost, capacity and risk limits as set operations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bounded, col, ratio
from .ordered import drop_stats, group_quantiles, order_stats
from .ts import running_product, series


def calendar():
    return Window.partitionBy(F.lit(0)).orderBy("date")


# -- weights --------------------------------------------------------------------------------


def select_side(panel: DataFrame, n_long: int, n_short: int = 0, wide=False) -> DataFrame:
    """The n largest (long) and n smallest (short) names per date; thin dates left out."""
    d = order_stats(
        panel.filter(F.col("factor_value").isNotNull()), ["date"], "factor_value", "_o", descending=True, row_number=True, wide=wide
    ).filter(F.col("_o_n") >= max(n_long, 5))
    is_long, is_short = F.col("_o_rn") <= n_long, F.col("_o_rn") > F.col("_o_n") - n_short
    sides = F.array_compact(F.array(F.when(is_long, F.lit("long")), F.when(is_short & F.lit(n_short > 0), F.lit("short"))))
    return drop_stats(d.withColumn("side", F.explode(sides)), "_o")


def recent_ic(daily: DataFrame, last: int = 20, least: int = 5, out: str = "recent_ic") -> DataFrame:
    """One row: the mean of the last daily ICs of one factor, 0 with too few of them. The series is as long as the calendar."""
    ics = daily.agg(F.sort_array(F.collect_list(F.struct("date", "rank_ic")), asc=False).alias("_s"))
    mean = F.aggregate(F.slice("_s", 1, last), F.lit(0.0), lambda acc, x: acc + x["rank_ic"]) / F.least(F.size("_s"), F.lit(last))
    return ics.select(F.when(F.size("_s") >= least, mean).otherwise(0.0).alias(out))


def weigh(
    chosen: DataFrame,
    scheme: str = "equal",
    ic_mean: Column | float | None = None,
    low: float = 0.005,
    high: float = 0.05,
) -> DataFrame:
    """Weights of the chosen names per date and side, clipped and scaled to 1 (shorts negative).

    The chosen lists are bounded by the portfolio size, so per-list windows are small.
    """
    side = Window.partitionBy("date", "side")
    n = F.count(F.lit(1)).over(side)
    even = 1.0 / n
    if scheme == "score":
        raw = F.coalesce(ratio(F.abs("factor_value"), F.sum(F.abs("factor_value")).over(side)), even)
    elif scheme == "ic_rank" and ic_mean is not None:
        against = (ic_mean if isinstance(ic_mean, Column) else F.lit(ic_mean)) < 0
        w = side.orderBy(F.when(against, -F.col("factor_value")).otherwise(F.col("factor_value")).desc())
        place = F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0
        raw = place / (n * (n + 1) / 2.0)
    elif scheme == "sector_neutral" and "industry" in chosen.columns:
        sector = Window.partitionBy("date", "side", "industry")
        chosen = chosen.withColumn("industry", F.coalesce("industry", F.lit("unknown")))
        chosen = chosen.withColumn("_dr", F.dense_rank().over(side.orderBy("industry")))
        raw = 1.0 / F.max("_dr").over(side) / F.count(F.lit(1)).over(sector)
    else:
        raw = even
    d = chosen.withColumn("_w", bounded(raw, low, high))
    scaled = F.col("_w") / F.sum("_w").over(side)
    d = d.withColumn("weight", F.when(F.col("side") == "short", -scaled).otherwise(scaled))
    return d.select("date", "asset", "weight", "side")


def latest_rank_weights(panel: DataFrame, wide=False) -> DataFrame:
    """Percent ranks of the last date scaled to 1."""
    from .xsec import rank

    last = panel.agg(F.max("date").alias("date"))
    d = panel.join(F.broadcast(last), "date", "left_semi").filter(F.col("factor_value").isNotNull())
    d = rank(d, "factor_value", "_r", ["date"], wide=wide)
    total = d.groupBy("date").agg(F.sum("_r").alias("_t"))
    return d.join(total, "date").select("date", "asset", (F.col("_r") / F.col("_t")).alias("weight"))


# -- rebalancing ------------------------------------------------------------------------------


def month_starts(dates: DataFrame) -> DataFrame:
    """First date of each month present, with the next one."""
    d = dates.groupBy(F.trunc("date", "MM").alias("_m")).agg(F.min("date").alias("date"))
    return d.select("date", F.lead("date").over(calendar()).alias("next_date"), F.row_number().over(calendar()).alias("period"))


def every_kth(dates: DataFrame, k: int) -> DataFrame:
    d = dates.select("date").distinct().withColumn("_p", F.row_number().over(calendar()) - 1).filter(F.col("_p") % k == 0)
    return d.select("date", F.lead("date").over(calendar()).alias("next_date"), F.row_number().over(calendar()).alias("period"))


def period_prices(panel: DataFrame, periods: DataFrame, held: DataFrame) -> DataFrame:
    """(period, asset, start_price, end_price) of the held names (period, asset).

    The first close at or after the period start and the last at or before its end, found
    with ordered windows over each asset's closes plus one marker row per boundary; no
    range join.
    """
    spans = periods.filter(F.col("next_date").isNotNull())
    marks = held.select("period", "asset").distinct().join(spans, "period").select(
        "asset",
        "period",
        F.explode(
            F.array(
                F.struct(F.col("date").alias("date"), F.lit("start").alias("kind")),
                F.struct(F.col("next_date").alias("date"), F.lit("end").alias("kind")),
            )
        ).alias("m"),
    )
    none = F.lit(None)
    rows = panel.select("asset", "date", "close", none.cast("string").alias("kind"), none.cast("int").alias("period"))
    asks = marks.select("asset", "m.date", none.cast("double").alias("close"), "m.kind", "period")
    order = Window.partitionBy("asset").orderBy("date")
    ahead = F.first("close", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    back = F.last("close", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    priced = rows.unionByName(asks).withColumns({"_a": ahead, "_b": back}).filter(F.col("kind").isNotNull())
    return priced.groupBy("period", "asset").agg(
        F.max(F.when(F.col("kind") == "start", F.col("_a"))).alias("start_price"),
        F.max(F.when(F.col("kind") == "end", F.col("_b"))).alias("end_price"),
    )


def period_returns(weights: DataFrame, prices: DataFrame) -> DataFrame:
    """Weighted return of each period from period weights (period, asset, weight)."""
    r = F.when(F.col("start_price") > 0, F.col("end_price") / F.col("start_price") - 1).otherwise(0.0)
    priced = prices.filter(F.col("start_price").isNotNull() & F.col("end_price").isNotNull())
    d = weights.join(priced, ["period", "asset"], "left").withColumn("_c", F.when(F.col("start_price").isNotNull(), F.col("weight") * r))
    return d.groupBy("period").agg(F.coalesce(F.sum("_c"), F.lit(0.0)).alias("period_return"), F.count(F.lit(1)).alias("n_held"))


def weight_changes(weights: DataFrame, step: str = "period") -> DataFrame:
    """(step, asset, old_w, new_w) between consecutive steps: a full join of each book with the one before.

    ``step`` is a dense number; the first book is left out.
    """
    new = weights.select(step, "asset", F.col("weight").alias("new_w"))
    old = weights.select((F.col(step) + 1).alias(step), "asset", F.col("weight").alias("old_w"))
    span = weights.agg(F.min(step).alias("_lo"), F.max(step).alias("_hi")).withColumn("_one", F.lit(1))
    both = new.join(old, [step, "asset"], "full").fillna(0.0, ["new_w", "old_w"]).withColumn("_one", F.lit(1))
    kept = both.join(F.broadcast(span), "_one").filter((F.col(step) > F.col("_lo")) & (F.col(step) <= F.col("_hi")))
    return kept.drop("_one", "_lo", "_hi")


def turnover(changes: DataFrame, step: str = "period") -> DataFrame:
    return changes.groupBy(step).agg((F.sum(F.abs(F.col("new_w") - F.col("old_w"))) / 2).alias("turnover"))


# -- cost -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Costs:
    """Rates of the trading cost model (fixed values)."""

    commission: float = 0.0003
    commission_min: float = 5.0
    stamp_tax: float = 0.001
    slippage: float = 0.0002
    impact: float = 0.1
    impact_decay: float = 0.5


def buy_rate(value, participation=0.0, c: Costs = Costs()) -> Column:
    value = col(value) if isinstance(value, (str, Column)) else F.lit(float(value))
    part = col(participation) if isinstance(participation, (str, Column)) else F.lit(float(participation))
    floor = c.commission_min / F.greatest(value, F.lit(1.0))
    return F.greatest(F.lit(c.commission), floor) + c.slippage + c.impact * F.pow(part, F.lit(c.impact_decay))


def sell_rate(value, participation=0.0, c: Costs = Costs()) -> Column:
    return buy_rate(value, participation, c) + c.stamp_tax


def round_trip_rate(value=100000.0, participation=0.0, c: Costs = Costs()) -> Column:
    return buy_rate(value, participation, c) + sell_rate(value, participation, c)


def trade_costs(changes: DataFrame, quotes: DataFrame, notional: float, step: str = "period", c: Costs = Costs()) -> DataFrame:
    """Cost of every weight change against a fixed notional; quotes are (step, asset, close, volume)."""
    d = changes.join(quotes.select(step, "asset", "close", "volume"), [step, "asset"], "left")
    value = F.abs(F.col("new_w") - F.col("old_w")) * notional
    price, volume = F.coalesce("close", F.lit(10.0)), F.coalesce("volume", F.lit(1e6))
    part = F.when(volume > 0, F.least(value / price / F.greatest(volume, F.lit(1.0)), F.lit(0.2))).otherwise(0.0)
    d = d.withColumns({"trade_value": value, "participation": part}).filter(F.col("trade_value") > 0)
    rate = F.when(
        F.col("new_w") > F.col("old_w"), buy_rate("trade_value", "participation", c)
    ).otherwise(sell_rate("trade_value", "participation", c))
    return d.withColumn("cost_rate", rate).withColumn("cost", F.col("trade_value") * F.col("cost_rate"))


def turnover_cost_impact(long: DataFrame, every: int = 20, share: float = 0.2, min_common: int = 20, wide=False) -> DataFrame:
    """Top-share change between each k-th date over names on both dates, and what it costs per year."""
    days = long.select("date").distinct().withColumn("_p", F.row_number().over(calendar()) - 1)
    days = days.filter(F.col("_p") % every == 0).select("date", (F.col("_p") / every).cast("int").alias("seq"))
    held = long.select("factor_id", "date", "asset", "factor_value").join(days, "date")
    cur = held.select("factor_id", "seq", "asset", F.col("factor_value").alias("cur"))
    prev = held.select("factor_id", (F.col("seq") + 1).alias("seq"), "asset", F.col("factor_value").alias("prev"))
    both = cur.join(prev, ["factor_id", "seq", "asset"])
    keys = ["factor_id", "seq"]
    n = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= min_common)
    both = both.join(n, keys).withColumn("_k", F.floor(F.col("common") * share))
    for side in ("prev", "cur"):
        both = order_stats(both, keys, side, "_o", descending=True, row_number=True, wide=wide)
        both = drop_stats(both.withColumn(f"_{side}", F.coalesce(F.col("_o_rn") <= F.col("_k"), F.lit(False))), "_o")
    per = both.groupBy(*keys).agg(
        (1 - F.count_if(F.col("_prev") & F.col("_cur")) / F.greatest(F.count_if("_prev"), F.lit(1))).alias("t")
    )
    yearly = F.col("turnover") * (252 / every)
    rate = round_trip_rate()
    return per.groupBy("factor_id").agg(F.avg("t").alias("turnover")).withColumns(
        {
            "annual_turnover": yearly,
            "cost_impact_bps": yearly * rate * 10000,
            "ic_penalty": yearly * rate / 0.20,
            "round_trip_rate": rate,
        }
    )


def capacity(mean_volume, max_participation: float = 0.05, max_stocks: int = 50) -> dict[str, Column]:
    """Per-stock, daily and monthly capacity from a mean volume and a round price of 20."""
    per = col(mean_volume) * 20.0 * max_participation
    return {"per_stock_capacity": per, "daily_capacity": per * max_stocks, "monthly_capacity": per * max_stocks * 20}


# -- factor nav, orders, limits ---------------------------------------------------------------


def factor_nav(panel: DataFrame, n_long: int = 50, wide=False) -> DataFrame:
    """Daily nav of the equal-weight top names, held from the previous date's close to this one's.

    A name without a close on the previous date adds nothing to the day's return.
    """
    days = panel.select("date").distinct().withColumn("_prev_day", F.lag("date").over(calendar()))
    d = panel.withColumns(
        {"_pc": F.lag("close").over(series()), "_pd": F.lag("date").over(series())}
    ).filter(F.col("factor_value").isNotNull())
    d = order_stats(d, ["date"], "factor_value", "_o", descending=True, row_number=True, wide=wide)
    d = drop_stats(d.filter(F.col("_o_rn") <= n_long), "_o").join(days, "date")
    r = F.when((F.col("_pd") == F.col("_prev_day")) & (F.col("_pc") > 0), F.col("close") / F.col("_pc") - 1)
    per = d.groupBy("date").agg(
        (F.coalesce(F.sum(r), F.lit(0.0)) / F.count(F.lit(1))).alias("period_return"), F.count(F.lit(1)).alias("n_held")
    )
    return per.withColumn("nav", running_product("period_return", calendar()))


def target_orders(targets: DataFrame, held: DataFrame, prices: DataFrame, total_value: float) -> DataFrame:
    """Lots to trade: target lots of 100 from weights less held lots; names without a price are skipped."""
    d = targets.select("asset", "weight").join(held.select("asset", "quantity"), "asset", "full").join(prices, "asset")
    lots = F.floor(F.coalesce("weight", F.lit(0.0)) * total_value / (F.col("price") * 100)).cast("bigint")
    d = d.filter(F.col("price") > 0).withColumn("diff", lots - F.coalesce("quantity", F.lit(0)))
    side = F.when(F.col("diff") > 0, "buy").otherwise("sell")
    return d.filter(F.col("diff") != 0).select("asset", side.alias("side"), F.abs("diff").alias("quantity"))


def risk_check(
    weights: DataFrame,
    combined: DataFrame,
    returns: DataFrame,
    max_weight: float = 0.15,
    max_industry: float = 0.30,
    cap_percentile: float = 0.10,
    min_value: float = 1_000_000.0,
    max_drawdown: float = 0.15,
    wide=False,
) -> DataFrame:
    """One row: concentration, industry, liquidity and drawdown penalties, score and recommendation.

    ``weights`` is (factor_id, weight); ``combined`` has factor_value, industry, market_cap,
    close and volume; ``returns`` is (date, period_return).
    """
    from .ts import nav_and_drawdown

    heavy = weights.agg(
        F.count_if(F.col("weight") > max_weight).alias("heavy_factors"), F.max("weight").alias("max_weight")
    )
    industry = combined.groupBy("industry").agg(F.avg("factor_value").alias("m")).agg(F.max(F.abs("m")).alias("max_industry_exposure"))
    flat = combined.withColumn("_all", F.lit(1))
    cut = group_quantiles(flat, ["_all"], "market_cap", {"_cut": cap_percentile}, ("date", "asset"), wide)
    liquidity = flat.join(F.broadcast(cut), "_all").agg(
        F.count_if(F.col("market_cap") < F.col("_cut")).alias("thin_rows"),
        F.avg(F.col("volume") * F.col("close")).alias("mean_value"),
    )
    fall = nav_and_drawdown(returns, "period_return").agg(F.abs(F.min("drawdown")).alias("max_drawdown"))
    d = heavy.withColumn("_one", F.lit(1))
    for side in (industry, liquidity, fall):
        d = d.join(side.withColumn("_one", F.lit(1)), "_one")
    score = (
        0.15 * F.col("heavy_factors")
        + F.when(F.col("max_industry_exposure") > max_industry, 0.2).otherwise(0.0)
        + F.when(F.col("thin_rows") > 0, 0.05).otherwise(0.0)
        + F.when(F.col("mean_value") < min_value, 0.1).otherwise(0.0)
        + F.when(F.col("max_drawdown") > max_drawdown, 0.3).otherwise(0.0)
    )
    d = d.drop("_one").withColumn("risk_score", F.least(score, F.lit(1.0)))
    advice = F.when(F.col("risk_score") > 0.5, "suspend").when(F.col("risk_score") > 0.25, "reduce").otherwise("approve")
    return d.withColumn("recommendation", advice)
