"""Missing values, winsorizing, post-processing, returns and drawdowns on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, r6, show
from .dsl import A, BASE, D, G, panel_xy
from ..operators import xsec
from ..operators.ts import forward_return, nav_and_drawdown, pct_change
from ..sources.adapters import date_is_wide, weekly_panel

KEYS = "CAST(date AS VARCHAR) AS date, asset"


def _panel_query(name: str, expr: str, run, ctes: str = "", src: str = "t", digits: int = 6) -> None:
    @query(name, f"{BASE}{ctes} SELECT {KEYS}, {r6(expr, 'value', digits)} FROM {src}")
    def made(spark, sf_dir):
        return show(run(panel_xy(spark, sf_dir, False), date_is_wide(spark, sf_dir)), ["date", "asset"], ["value"], digits)


MEDIAN = f"quantile_cont(x, 0.5) OVER ({D})"
FFILL = f", ff AS (SELECT *, last_value(x IGNORE NULLS) OVER ({A} ROWS UNBOUNDED PRECEDING) AS fx FROM t)"
MAD = f""", md AS (SELECT *, {MEDIAN} AS med FROM t), dv AS (SELECT *, abs(x - med) AS dev FROM md),
wz AS (SELECT *, quantile_cont(dev, 0.5) OVER ({D}) AS mad FROM dv)"""
CUT = "CASE WHEN x IS NOT NULL AND mad > 0 THEN least(greatest(x, med - 1.5 * 1.4826 * mad), med + 1.5 * 1.4826 * mad) ELSE x END"

_panel_query("p_fill_median", f"coalesce(x, {MEDIAN})", lambda d, w: xsec.fill_missing(d, "x", "value", wide=w))
_panel_query("p_fill_zero", "coalesce(x, 0)", lambda d, w: xsec.fill_missing(d, "x", "value", "zero"))
_panel_query(
    "p_fill_forward_back",
    f"coalesce(fx, first_value(x IGNORE NULLS) OVER ({A} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
    lambda d, w: xsec.fill_missing(d, "x", "value", "ffill"),
    FFILL,
    "ff",
)
_panel_query("w_winsorize_mad", CUT, lambda d, w: xsec.winsorize_mad(d, "x", "value", 1.5, wide=w), MAD, "wz")
_panel_query(
    "w_zscore_pop",
    f"CASE WHEN stddev_pop(x) OVER ({D}) > 0 THEN (x - avg(x) OVER ({D})) / stddev_pop(x) OVER ({D}) ELSE 0 END",
    lambda d, w: xsec.zscore_pop(d, "x", "value", wide=w),
)
_panel_query("v_forward_return", f"lead(close, 5) OVER ({A}) / close - 1", lambda d, w: d.withColumn("value", forward_return(5)), digits=5)
_panel_query(
    "v_forward_return_shifted",
    f"lead(close, 7) OVER ({A}) / lead(close, 3) OVER ({A}) - 1",
    lambda d, w: d.withColumn("value", forward_return(5, 3)),
    digits=5,
)
_panel_query("v_daily_return", f"close / lag(close) OVER ({A}) - 1", lambda d, w: d.withColumn("value", pct_change("close")), digits=5)


@query(
    "w_preprocess_chain",
    f"""{BASE}, p0 AS (SELECT *, coalesce(x, {MEDIAN}) AS p FROM t), p1 AS (SELECT *, quantile_cont(p, 0.5) OVER ({D}) AS med FROM p0),
p2 AS (SELECT *, quantile_cont(abs(p - med), 0.5) OVER ({D}) AS mad FROM p1),
p3 AS (SELECT *, CASE WHEN p IS NOT NULL AND mad > 0 THEN least(greatest(p, med - 3 * 1.4826 * mad), med + 3 * 1.4826 * mad) ELSE p END AS c FROM p2),
p4 AS (SELECT *, CASE WHEN stddev_pop(c) OVER ({D}) > 0 THEN (c - avg(c) OVER ({D})) / stddev_pop(c) OVER ({D}) ELSE 0 END AS z,
  CASE WHEN stddev_pop(market_cap) OVER ({D}) > 0 THEN (market_cap - avg(market_cap) OVER ({D})) / stddev_pop(market_cap) OVER ({D}) ELSE 0 END AS zc FROM p3)
SELECT {KEYS}, {r6(f'z - avg(z) OVER ({G}) - 0.05 * coalesce(zc, 0)', 'value')} FROM p4""",
)
def preprocess(spark, sf_dir):
    p = weekly_panel(spark, sf_dir, ["industry", "market_cap"]).withColumn("x", F.nullif(F.col("volume"), F.lit(7.0)))
    return show(xsec.preprocess(p, "x", "value", wide=date_is_wide(spark, sf_dir)), ["date", "asset"], ["value"])


@query(
    "v_nav_drawdown",
    f"""{BASE}, r AS (SELECT date, asset, coalesce(least(greatest(close / lag(close) OVER ({A}) - 1, -0.5), 0.5), 0) * 0.1 AS r FROM t),
q AS (SELECT date, asset, CASE WHEN lag(r) OVER ({A}) IS NULL THEN 0 ELSE r END AS r FROM r),
n AS (SELECT *, exp(sum(ln(1 + r)) OVER ({A})) AS nav FROM q)
SELECT {KEYS}, {r6('ln(nav)', 'log_nav')}, {r6(f'nav / max(nav) OVER ({A}) - 1', 'drawdown')} FROM n""",
)
def nav_drawdown(spark, sf_dir):
    from ..functions.scalar import clip

    p = weekly_panel(spark, sf_dir).withColumn("r", F.coalesce(clip(pct_change("close"), -0.5, 0.5), F.lit(0.0)) * 0.1)
    d = nav_and_drawdown(p, "r", ["asset"]).withColumn("log_nav", F.log("nav"))
    return show(d, ["date", "asset"], ["log_nav", "drawdown"])
