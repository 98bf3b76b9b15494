"""SQL fragments shared by the checks: factor tables, rank IC, correlations."""

from __future__ import annotations

from .dsl import A, D, frame, pct, steady
from ..sources.adapters import PANEL_SQL

# Four named factors that the checks rebuild in SQL.
FOUR = ["A_Share_Limit_Up_Proximity", "Momentum_1m", "Size_Volume", "Turnover_Liquidity"]
RAW = {
    "A_Share_Limit_Up_Proximity": f"close / greatest(abs(max(close) {frame(20)}), 1e-10)",
    "Momentum_1m": f"close - lag(close, 5) OVER ({A})",
    "Size_Volume": "-1 * ln(greatest(volume, 1e-10))",
    "Turnover_Liquidity": "turnover",
}


def wide_factors(extra: str = "") -> str:
    """CTEs up to ``wide``: the panel with the four factors as columns f0..f3 and a 5-row label."""
    raws = ", ".join(f"{RAW[f]} AS r{i}" for i, f in enumerate(FOUR))
    ranks = ", ".join(f"{pct(D, f'r{i}')} AS f{i}" for i in range(4))
    return f"""{PANEL_SQL},
raw AS (SELECT *, {raws}, lead(close, 5) OVER ({A}) / close - 1 AS label {extra} FROM panel),
wide AS (SELECT *, {ranks} FROM raw)"""


def long_factors(extra: str = "", cols: str = "") -> str:
    """CTEs up to ``facs``: the four factors in long form."""
    keep = "date, asset, close, volume, industry, market_cap, label" + cols
    rows = " UNION ALL ".join(f"SELECT '{f}' AS factor_id, f{i} AS factor_value, {keep} FROM wide" for i, f in enumerate(FOUR))
    return f"{wide_factors(extra)}, facs AS ({rows})"


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def ic_daily(
    src: str, min_n: int = 20, label: str = "label", by: str = "factor_id", out: str = "daily", ranked: bool = True, zero: bool = False
) -> str:
    """CTE ``out``: (by, date, n, rank_ic) from a long factor table."""
    def r(c):
        c = steady(c)
        return f"rank() OVER (PARTITION BY {by}, date ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, date, {c}) - 1) / 2.0"

    body = (f"{r('x')} AS rx, {r('y')} AS ry") if ranked else "x AS rx, y AS ry"
    score = corr("rx", "ry")
    if zero:
        score = f"CASE WHEN count(*) >= {min_n} THEN coalesce({score}, 0) ELSE 0 END"
        tail = ""
    else:
        tail = f" HAVING count(*) >= {min_n} AND {score} IS NOT NULL"
    return f"""{out}_v AS (SELECT {by}, date, factor_value AS x, {label} AS y FROM {src} WHERE factor_value IS NOT NULL AND {label} IS NOT NULL),
{out}_r AS (SELECT {by}, date, {body} FROM {out}_v),
{out} AS (SELECT {by}, date, count(*) AS n, {score} AS rank_ic FROM {out}_r GROUP BY {by}, date{tail})"""


def ic_stats(std: str = "stddev_pop") -> str:
    return (
        f"count(*) AS n_dates, avg(rank_ic) AS ic_mean, coalesce({std}(rank_ic), 0) AS ic_std, "
        f"coalesce(avg(rank_ic) / nullif({std}(rank_ic), 0), 0) AS ic_ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio"
    )


def t_tail(t: str, nu: str) -> str:
    """P(|T| >= |t|) for whole degrees of freedom: the two finite sums, their coefficients by gamma functions."""
    a, cos, sin = f"atan(abs({t}) / sqrt({nu}))", f"(1 / sqrt(1 + ({t}) ** 2 / ({nu})))", f"(abs({t}) / sqrt(({nu}) + ({t}) ** 2))"
    odd = f"(SELECT sum(exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({cos}, 2 * k + 1)) FROM (SELECT unnest(range(0, CAST(({nu} - 1) // 2 AS BIGINT))) AS k))"
    even = f"(SELECT sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow({cos}, 2 * k)) FROM (SELECT unnest(range(0, CAST({nu} // 2 AS BIGINT))) AS k))"
    return f"least(1.0, greatest(0.0, 1 - CASE WHEN {nu} % 2 = 1 THEN 2 / pi() * ({a} + {sin} * coalesce({odd}, 0)) ELSE {sin} * {even} END))"


def pairs_of_four(out: str = "pairs", min_n: int = 20) -> str:
    """CTE ``out``: pairwise-complete correlation of the four factor columns."""
    rows = []
    for i in range(4):
        for j in range(i + 1, 4):
            a, b = f"CASE WHEN f{j} IS NOT NULL THEN f{i} END", f"CASE WHEN f{i} IS NOT NULL THEN f{j} END"
            rows.append(
                f"SELECT '{FOUR[i]}' AS f1, '{FOUR[j]}' AS f2, count(f{i} + f{j}) AS n, "
                f"CASE WHEN count(f{i} + f{j}) >= {min_n} THEN {corr(a, b)} END AS corr FROM wide"
            )
    return f"{out} AS ({' UNION ALL '.join(rows)})"


ROLLING_SQL = {"ts_mean": "avg", "ts_std": "stddev_samp", "ts_max": "max", "ts_min": "min", "ts_sum": "sum"}


def named_factors(trees: dict[str, dict], label: str) -> str:
    """CTEs up to ``facs``: the given trees in long form.  Each window layer is one CTE; the rest is inlined."""
    made: dict[str, tuple[str, int]] = {}
    layers: list[list[str]] = []

    def column(expr: str, level: int) -> tuple[str, int]:
        while len(layers) <= level:
            layers.append([])
        name = f"c{sum(map(len, layers))}"
        layers[level].append(f"{expr} AS {name}")
        return name, level + 1

    def build(node: dict) -> tuple[str, int]:
        key = repr(node)
        if key not in made:
            made[key] = fresh(node)
        return made[key]

    def fresh(node: dict) -> tuple[str, int]:
        if node["block_type"] == "data":
            return f"CAST({node['field_name']} AS DOUBLE)", 0
        op, p = node["op"], node.get("params") or {}
        if op == "constant":
            return f"({p['value']!r})", 0
        if node["block_type"] == "combine":
            (a, la), (b, lb) = build(node["left"]), build(node["right"])
            sign = {"add": "+", "sub": "-", "mul": "*"}.get(op)
            expr = f"({a} {sign} {b})" if sign else f"(CASE WHEN {b} <> 0 THEN {a} / (greatest(abs({b}), 1e-10) * sign({b})) END)"
            return expr, max(la, lb)
        x, level = build(node["input_block"])
        w = p.get("window")
        if op in ("abs", "sign"):
            return f"{op}({x})", level
        if op == "log":
            return f"(CASE WHEN {x} IS NOT NULL THEN ln(greatest({x}, 1e-10)) END)", level
        if op == "clip":
            return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {p['lo']!r}), {p['hi']!r}) END)", level
        if op == "piecewise":
            return f"(CASE WHEN {x} > {p['threshold']} THEN 1.0 ELSE 0.0 END)", level
        if op == "rank":
            return column(pct(D, x), level)
        if op == "zscore":
            return column(f"({x} - avg({x}) OVER ({D})) / (stddev_samp({x}) OVER ({D}) + 1e-10)", level)
        if op in ("delta", "lag"):
            back = f"lag({x}, {w}) OVER ({A})"
            return column(f"{x} - {back}" if op == "delta" else back, level)
        if op == "ts_corr":
            y, other = build(p["_right_block"])
            a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
            c = f"covar_pop({a}, {b}) {frame(w)} / nullif(stddev_pop({a}) {frame(w)} * stddev_pop({b}) {frame(w)}, 0)"
            return column(f"CASE WHEN {c} IS NOT NULL THEN round(least(greatest({c}, -1), 1), 12) END", max(level, other))
        return column(f"{ROLLING_SQL[op]}({x}) {frame(w)}", level)

    refs = {name: build(tree)[0] for name, tree in trees.items()}
    text = f"{PANEL_SQL}, s0 AS (SELECT *, {label} AS label FROM panel)"
    for i, cols in enumerate(layers):
        text += f", s{i + 1} AS (SELECT *, {', '.join(cols)} FROM s{i})"
    rows = " UNION ALL ".join(f"SELECT '{n}' AS factor_id, date, asset, {r} AS factor_value, label FROM s{len(layers)}" for n, r in refs.items())
    return f"{text}, facs AS ({rows})"
