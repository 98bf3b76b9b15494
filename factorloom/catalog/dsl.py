"""One query per expression-tree operator, evaluated on the weekly panel.

``x`` has ties and gaps (volume with one value blanked), ``y`` is the close.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, r6, show
from ..plans import tree
from ..plans.factors import E, const, field, op
from ..sources.adapters import PANEL_SQL, date_is_wide, weekly_panel

X, Y = field("x"), field("y")

BASE = f"WITH {PANEL_SQL}, t AS (SELECT *, nullif(volume, 7) AS x, close AS y FROM panel)"
D = "PARTITION BY date"
G = "PARTITION BY date, industry"
A = "PARTITION BY asset ORDER BY date"


def frame(w: int) -> str:
    return f"OVER ({A} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def steady(x: str) -> str:
    """40 significant bits, as ranks compare."""
    return f"(({x}) * CAST(8193 AS DOUBLE) - (({x}) * CAST(8193 AS DOUBLE) - ({x})))"


def avg_rank(part: str, direction: str = "ASC", col: str = "x") -> str:
    col = steady(col)
    return (
        f"(rank() OVER ({part} ORDER BY {col} {direction} NULLS LAST) + (count(*) OVER ({part}, {col}) - 1) / 2.0)"
    )


def pct(part: str, col: str = "x") -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN {avg_rank(part, col=col)} / count({col}) OVER ({part}) END"


def hit(part: str, direction: str, n: int) -> str:
    return f"CASE WHEN x IS NOT NULL AND {avg_rank(part, direction)} <= {n} THEN 1.0 ELSE 0.0 END"


def relational(name: str, **params) -> E:
    return E({"block_type": "relational", "op": name, "params": params, "input_block": X.node, "group_key": "industry"})


def picked(name: str, cond: E) -> E:
    return E({"block_type": "filter", "op": name, "input_block": X.node, "cond_block": cond.node})


def combined(name: str, cond: E | None = None) -> E:
    node = {"block_type": "combine", "op": name, "left": X.node, "right": Y.node}
    return E({**node, "cond": cond.node} if cond else node)


def moment_z(part: str) -> str:
    return f"(x - avg(x) OVER ({part})) / (stddev_samp(x) OVER ({part}) + 1e-10)"


W = 6
LIST = f"list(x) FILTER (WHERE x IS NOT NULL) {frame(W)}"
HELD = f"list(coalesce(x, %s)) {frame(W)}"
XP, YP = "CASE WHEN y IS NOT NULL THEN x END", "CASE WHEN x IS NOT NULL THEN y END"
DEV = Y - const(10.0)

# name -> (tree, SQL expression over t, industry needed)
OPS: dict[str, tuple[E, str]] = {
    "p_data": (X, "x"),
    "p_constant": (const(2.5), "2.5"),
    "p_add": (X + Y, "x + y"),
    "p_sub": (X - Y, "x - y"),
    "p_mul": (X * Y, "x * y"),
    "p_div": (Y / (X - 3.0), "CASE WHEN x - 3 <> 0 THEN y / (greatest(abs(x - 3), 1e-10) * sign(x - 3)) END"),
    "p_max": (combined("max"), "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END"),
    "p_min": (combined("min"), "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END"),
    "p_where": (combined("where"), "CASE WHEN x > y THEN x ELSE y END"),
    "p_where_cond": (combined("where", X - 20.0), "CASE WHEN x - 20 > 0 THEN x ELSE y END"),
    "p_abs": (op("abs", X - 20.0), "abs(x - 20)"),
    "p_sign": (op("sign", X - 20.0), "sign(x - 20)"),
    "p_log": (op("log", X - 5.0), "CASE WHEN x IS NOT NULL THEN ln(greatest(x - 5, 1e-10)) END"),
    "p_sigmoid": (op("sigmoid", (X - 20.0) / 4.0), "CASE WHEN x IS NOT NULL THEN 1.0 / (1.0 + exp(-least(greatest((x - 20) / 4.0, -50.0), 50.0))) END"),
    "p_clip": (op("clip", X, lo=5, hi=30), "CASE WHEN x IS NOT NULL THEN least(greatest(x, 5.0), 30.0) END"),
    "p_piecewise": (op("piecewise", X, threshold=20), "CASE WHEN x > 20 THEN 1.0 ELSE 0.0 END"),
    "p_power": (op("power", X, exponent=1.5), "pow(x, 1.5)"),
    "p_sqrt": (op("sqrt", X - 10.0), "CASE WHEN x IS NOT NULL THEN sqrt(greatest(x - 10, 0.0)) END"),
    "p_where_condition": (picked("where_condition", Y - 1000.0), "CASE WHEN y - 1000 > 0 THEN x END"),
    "p_sample_weight": (picked("sample_weight", const(1000.0) - Y), "x * abs(1000 - y)"),
    "w_rank": (op("rank", X), pct(D)),
    "w_zscore": (op("zscore", X), moment_z(D)),
    "w_quantile": (
        op("quantile", X, n=5),
        f"CASE WHEN x IS NOT NULL THEN coalesce(greatest(0.0, ceil((row_number() OVER ({D} ORDER BY x NULLS LAST, asset) - 1) * 5.0 / "
        f"nullif(count(x) OVER ({D}) - 1, 0)) - 1), 0.0) / 4 END",
    ),
    "w_scale": (op("scale", X), f"(x - min(x) OVER ({D})) / (max(x) OVER ({D}) - min(x) OVER ({D}) + 1e-10)"),
    "w_group_neutralize": (op("group_neutralize", X), f"x - avg(x) OVER ({G})"),
    "w_group_rank": (op("group_rank", X), pct(G)),
    "w_group_zscore": (op("group_zscore", X), moment_z(G)),
    "w_cross_section_ols": (relational("cross_section_ols", factor_cols=["y"]), f"x - avg(x) OVER ({D})"),
    "t_top_n": (op("top_n", X, n=10), hit(D, "DESC", 10)),
    "t_bottom_n": (op("bottom_n", X, n=10), hit(D, "ASC", 10)),
    "t_group_top_n": (op("group_top_n", X, n=2), hit(G, "DESC", 2)),
    "t_group_bottom_n": (op("group_bottom_n", X, n=2), hit(G, "ASC", 2)),
    "g_group_mean": (relational("group_aggregate", func="mean"), f"avg(x) OVER ({G})"),
    "g_group_sum": (relational("group_aggregate", func="sum"), f"coalesce(sum(x) OVER ({G}), 0)"),
    "g_group_median": (relational("group_aggregate", func="median"), f"quantile_cont(x, 0.5) OVER ({G})"),
    "v_delta": (op("delta", X, window=3), f"x - lag(x, 3) OVER ({A})"),
    "v_lag": (op("lag", X, window=3), f"lag(x, 3) OVER ({A})"),
    "v_ts_mean": (op("ts_mean", X, window=W), f"avg(x) {frame(W)}"),
    "v_ts_std": (op("ts_std", X, window=W), f"stddev_samp(x) {frame(W)}"),
    "v_ts_max": (op("ts_max", X, window=W), f"max(x) {frame(W)}"),
    "v_ts_min": (op("ts_min", X, window=W), f"min(x) {frame(W)}"),
    "v_ts_sum": (op("ts_sum", X, window=W), f"sum(x) {frame(W)}"),
    "v_ts_rank": (
        op("ts_rank", X, window=W),
        f"CASE WHEN x IS NOT NULL THEN (len(list_filter({LIST}, lambda v: v < x)) + "
        f"(len(list_filter({LIST}, lambda v: v = x)) + 1) / 2.0) / len({LIST}) END",
    ),
    "v_ts_argmax": (
        op("ts_argmax", X, window=W),
        f"CASE WHEN count(x) {frame(W)} > 0 THEN (list_position({HELD % 1e300}, list_max({HELD % 1e300})) - 1) / {W}.0 END",
    ),
    "v_ts_argmin": (
        op("ts_argmin", X, window=W),
        f"CASE WHEN count(x) {frame(W)} > 0 THEN (list_position({HELD % -1e300}, list_min({HELD % -1e300})) - 1) / {W}.0 END",
    ),
    "v_ts_corr": (
        op("ts_corr", X, Y, window=W),
        f"covar_pop({XP}, {YP}) {frame(W)} / nullif(stddev_pop({XP}) {frame(W)} * stddev_pop({YP}) {frame(W)}, 0)",
    ),
    "v_ts_cov": (op("ts_cov", X, Y, window=W), f"covar_samp({XP}, {YP}) {frame(W)}"),
    "v_ts_skew": (
        op("ts_skew", Y, window=W),
        f"CASE WHEN count(y) {frame(W)} >= 3 THEN CASE WHEN min(y) {frame(W)} = max(y) {frame(W)} THEN 0.0 ELSE skewness(y) {frame(W)} END END",
    ),
    "v_ts_kurt": (
        op("ts_kurt", Y, window=W),
        f"CASE WHEN count(y) {frame(W)} >= 4 THEN CASE WHEN min(y) {frame(W)} = max(y) {frame(W)} THEN -3.0 ELSE kurtosis(y) {frame(W)} END END",
    ),
    "v_event_filter": (
        E({"block_type": "relational", "op": "event_filter", "input_block": X.node, "params": {"event_col": "ev", "window": 3}}),
        f"x * CASE WHEN max(CASE WHEN volume > 45 THEN 1 ELSE 0 END) {frame(3)} > 0 THEN 1.0 ELSE 0.0 END",
    ),
}


def panel_xy(spark, sf_dir, industry: bool):
    p = weekly_panel(spark, sf_dir, ["industry"] if industry else [])
    return p.withColumns(
        {
            "x": F.nullif(F.col("volume"), F.lit(7.0)),
            "y": F.col("close"),
            "ev": (F.col("volume") > 45).cast("double"),
        }
    )


def _register(name: str, node: dict, expr: str) -> None:
    digits = 3 if name in LARGE else 6
    sql = f"{BASE} SELECT CAST(date AS VARCHAR) AS date, asset, {r6(expr, 'value', digits)} FROM t"
    grouped = "industry" in expr

    @query(name, sql)
    def run(spark, sf_dir):
        p = panel_xy(spark, sf_dir, grouped)
        return show(tree.evaluate(p, {"value": node}, wide=tree.crosses(node) and date_is_wide(spark, sf_dir)), ["date", "asset"], ["value"], digits)


LARGE = {"p_mul", "v_ts_cov", "p_sample_weight"}

for _name, (_tree, _sql) in OPS.items():
    _register(_name, _tree.node, _sql)



@query(
    "v_ema",
    f"""WITH RECURSIVE {PANEL_SQL}, t AS (SELECT *, nullif(volume, 7) AS x FROM panel),
 s AS (SELECT date, asset, x, row_number() OVER ({A}) AS k FROM t),
 e(date, asset, k, y, w) AS (
   SELECT date, asset, k, x, 1.0::DOUBLE FROM s WHERE k = 1
   UNION ALL
   SELECT s.date, s.asset, s.k,
     CASE WHEN e.y IS NULL THEN s.x WHEN s.x IS NULL THEN e.y
          ELSE (e.w * 0.8 * e.y + 0.2 * s.x) / (e.w * 0.8 + 0.2) END,
     CASE WHEN s.x IS NOT NULL OR e.y IS NULL THEN 1.0 ELSE e.w * 0.8 END
   FROM e JOIN s ON s.asset = e.asset AND s.k = e.k + 1)
 SELECT CAST(date AS VARCHAR) AS date, asset, {r6('y', 'value')} FROM e""",
)
def v_ema(spark, sf_dir):
    p = panel_xy(spark, sf_dir, False)
    return show(tree.evaluate(p, {"value": op("ema", X, alpha=0.2).node}), ["date", "asset"], ["value"])


@query(
    "v_rolling_ols_residual",
    f"""{BASE}, m AS (SELECT *, x - avg(x) OVER ({D}) AS res FROM t)
 SELECT CAST(date AS VARCHAR) AS date, asset, {r6(f'avg(res) {frame(W)}', 'value')} FROM m""",
)
def v_rolling_ols_residual(spark, sf_dir):
    p = panel_xy(spark, sf_dir, False)
    return show(tree.evaluate(p, {"value": op("rolling_ols_residual", X, window=W).node}, wide=date_is_wide(spark, sf_dir)), ["date", "asset"], ["value"])
