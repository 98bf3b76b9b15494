"""Evaluate factor expression trees (nested dicts, as stored in JSON) on a panel.

A tree node is ``{"block_type": "data", "field_name": ...}`` or an operator node with
``op``, ``params``, ``input_block`` / ``left`` / ``right`` / ``cond`` / ``cond_block``.
The trees are folded into DataFrame calls: row-level nodes stay plain expressions, all
time-series nodes that are ready go into one projection over the asset partitioning,
then all cross-sectional nodes over the date partitioning.  Equal subtrees of any
number of factors are computed once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import together, ts, xsec

SCALAR_TRANSFORMS = {
    "abs": lambda x, p: scalar.absolute(x),
    "sign": lambda x, p: scalar.sign(x),
    "log": lambda x, p: scalar.log(x),
    "sigmoid": lambda x, p: scalar.sigmoid(x),
    "clip": lambda x, p: scalar.clip(x, p.get("lo", -3.0), p.get("hi", 3.0)),
    "piecewise": lambda x, p: scalar.piecewise(x, p.get("threshold", 0.0)),
    "power": lambda x, p: scalar.power(x, p.get("exponent", 2.0)),
    "sqrt": lambda x, p: scalar.sqrt(x),
    "constant": lambda x, p: scalar.constant(p.get("value", 0.0)),
}
COMBINES = {
    "add": scalar.add,
    "sub": scalar.sub,
    "mul": scalar.mul,
    "div": scalar.div,
    "max": scalar.maximum,
    "min": scalar.minimum,
    "where": scalar.where,
}
FILTERS = {"where_condition": scalar.where_condition, "sample_weight": scalar.sample_weight}

# Time-series operators with their default window.
TS_WINDOWS = {
    "delta": (ts.delta, 1),
    "lag": (ts.lag, 1),
    "ts_mean": (ts.ts_mean, 20),
    "ts_std": (ts.ts_std, 20),
    "ts_rank": (ts.ts_rank, 20),
    "ts_max": (ts.ts_max, 20),
    "ts_min": (ts.ts_min, 20),
    "ts_sum": (ts.ts_sum, 20),
    "ts_argmax": (ts.ts_argmax, 20),
    "ts_argmin": (ts.ts_argmin, 20),
    "ts_skew": (ts.ts_skew, 20),
    "ts_kurt": (ts.ts_kurt, 20),
}
TS_PAIRS = {"ts_corr": ts.ts_corr, "ts_cov": ts.ts_cov}


# Cross-sectional operators: which keys they work in and what they compute.
DATE_OPS = {"rank", "quantile", "top_n", "bottom_n", "zscore", "scale", "demean", "cross_section_ols"}
GROUP_OPS = {"group_neutralize", "group_rank", "group_zscore", "group_top_n", "group_bottom_n", "group_aggregate"}
CROSS_SECTION = DATE_OPS | GROUP_OPS


def _cross_section(df: DataFrame, node: Mapping, x: str) -> tuple[str, list[str], int]:
    """(kind, keys, n) of a node; kind "same" leaves the value unchanged."""
    op, params = node["op"], node.get("params") or {}
    group = node.get("group_key") or "industry"
    keys = xsec.group_keys(df, group) if op in GROUP_OPS else ["date"]
    kind = op.removeprefix("group_")
    if op == "group_aggregate":
        kind = params.get("func", "mean")
    elif op == "group_neutralize":
        kind = "demean" if group in df.columns else "same"
    elif op == "cross_section_ols":
        kind = "demean" if any(c in df.columns for c in params.get("factor_cols", [])) else "same"
    n = int(params.get("n", {"quantile": 5, "group_top_n": 3, "group_bottom_n": 3}.get(op, 10)))
    return kind, keys, n


def _cross_section_expr(kind: str, keys: list[str], n: int, x: str) -> Column:
    if kind == "same":
        return F.col(x)
    if kind == "rank":
        return xsec.rank_expr(x, keys)
    if kind == "quantile":
        return xsec.quantile_expr(x, n, keys)
    if kind in ("top_n", "bottom_n"):
        return xsec.hit_expr(x, n, keys, descending=kind == "top_n")
    return xsec.moment_expr(kind, x, keys)


def _cross_section_wide(df: DataFrame, kind: str, keys: list[str], n: int, x: str, out: str) -> DataFrame:
    if kind == "same":
        return df.withColumn(out, F.col(x))
    if kind == "rank":
        return xsec.rank(df, x, out, keys, wide=True)
    if kind == "quantile":
        return xsec.quantile(df, x, out, n, keys, wide=True)
    if kind in ("top_n", "bottom_n"):
        return xsec.top_n(df, x, out, n, keys, wide=True, descending=kind == "top_n")
    return xsec.moment(df, kind, x, out, keys, wide=True)


OPERATORS = sorted(
    {*SCALAR_TRANSFORMS, *COMBINES, *FILTERS, *TS_WINDOWS, *TS_PAIRS, *CROSS_SECTION, "ema", "rolling_ols_residual", "event_filter"}
    - {"demean"}
)


def children(node: Mapping) -> list[Mapping]:
    """Input nodes of a node; the second operand of a rolling pair counts too."""
    found = [node[k] for k in ("input_block", "left", "right", "cond", "cond_block") if node.get(k)]
    other = (node.get("params") or {}).get("_right_block")
    return found + ([other] if other else [])


def required_fields(node: Mapping) -> list[str]:
    """Panel columns a tree reads, sorted."""
    if node["block_type"] == "data":
        return [node["field_name"]]
    if node.get("op") == "constant":
        return []
    fields = {f for child in children(node) for f in required_fields(child)}
    params = node.get("params") or {}
    fields |= {params["event_col"]} if params.get("event_col") else set()
    return sorted(fields)


def depth(node: Mapping) -> int:
    return 1 + max((depth(c) for c in children(node)), default=0)


def _key(node: Mapping) -> str:
    return json.dumps(node, sort_keys=True)


def _plain(node: Mapping) -> Mapping:
    """Rewrite a composite operator into simpler nodes."""
    if node.get("op") == "rolling_ols_residual":
        inner = {"block_type": "transform", "op": "demean", "input_block": node["input_block"], "params": {}}
        w = (node.get("params") or {}).get("window", 60)
        return {"block_type": "transform", "op": "ts_mean", "input_block": inner, "params": {"window": w}}
    return node


def _collect(node: Mapping, seen: dict[str, Mapping]) -> None:
    node = _plain(node)
    if node.get("op") != "constant":
        for child in children(node):
            _collect(child, seen)
    seen.setdefault(_key(node), node)


def evaluate(df: DataFrame, trees: Mapping[str, Mapping], wide: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Add one column per named tree to the panel, or to its columns ``keep``."""
    nodes: dict[str, Mapping] = {}
    for tree in trees.values():
        _collect(tree, nodes)
    for node in nodes.values():
        known = node["block_type"] == "data" or node["op"] in OPERATORS or node["op"] == "demean"
        if not known:
            raise ValueError(f"unknown operator: {node['op']}")
    done: dict[str, Column] = {}
    todo = dict(nodes)
    base = list(keep) if keep is not None else df.columns
    feeds = _feeds_series(nodes)
    names = {k: f"_n{i}" for i, k in enumerate(nodes)}

    def value(child: Mapping) -> Column:
        return done[_key(_plain(child))]

    def ready(node: Mapping) -> bool:
        return node.get("op") == "constant" or all(_key(_plain(c)) in done for c in children(node))

    while todo:
        moved = True
        while moved:
            moved = _fold_scalars(df, todo, done, value, ready)
        early = {k: n for k, n in todo.items() if ready(n) and _kind(n) == "date" and k in feeds}
        batch = early or {k: n for k, n in todo.items() if ready(n) and _kind(n) == "asset"}
        if batch and not early:
            df = _asset_stage(df, batch, done, names, value)
        else:
            batch = batch or {k: n for k, n in todo.items() if ready(n)}
            used = {*base, *_columns_used([*trees.values(), *todo.values()], done, names)}
            df = _date_stage(df.select(*[c for c in df.columns if c in used]), batch, done, names, value, wide)
        for k in batch:
            todo.pop(k)
    return df.select(*base, *[value(tree).alias(name) for name, tree in trees.items()])


def _feeds_series(nodes: Mapping[str, Mapping]) -> set[str]:
    """Keys of nodes that a time-series node reads, directly or not: such dates go first, while the panel is narrow."""
    found: set[str] = set()

    def mark(node: Mapping, below: bool) -> None:
        node = _plain(node)
        if below:
            found.add(_key(node))
        for child in [] if node.get("op") == "constant" else children(node):
            mark(child, below or _kind(node) == "asset")

    for node in nodes.values():
        mark(node, False)
    return found


def _columns_used(roots: Iterable[Mapping], done: Mapping, names: Mapping[str, str]) -> set[str]:
    """Columns that the given nodes still read: those of computed windows, else the fields below."""
    used = {"date", "asset"}
    for node in map(_plain, roots):
        key = _key(node)
        if node["block_type"] == "data":
            used.add(node["field_name"])
        elif key in done and _kind(node) != "row":
            used.add(names[key])
        elif node.get("op") != "constant":
            params = node.get("params") or {}
            used |= {node.get("group_key") or "industry", params.get("event_col"), *params.get("factor_cols", [])}
            used |= _columns_used(children(node), done, names)
    return used


def crosses(tree: Mapping) -> bool:
    """Whether a tree has an operator over whole dates."""
    nodes: dict[str, Mapping] = {}
    _collect(tree, nodes)
    return any(_kind(n) == "date" for n in nodes.values())


def _kind(node: Mapping) -> str:
    op = node.get("op")
    if op in TS_WINDOWS or op in TS_PAIRS or op in ("ema", "event_filter"):
        return "asset"
    return "date" if op in CROSS_SECTION else "row"


def _fold_scalars(df, todo, done, value, ready) -> bool:
    moved = False
    for key, node in list(todo.items()):
        if not ready(node) or _kind(node) != "row":
            continue
        if node["block_type"] == "data":
            if node["field_name"] not in df.columns:
                raise ValueError(f"panel lacks field: {node['field_name']}")
            done[key] = scalar.number(F.col(f"`{node['field_name']}`"))
        elif node["op"] in SCALAR_TRANSFORMS:
            x = None if node["op"] == "constant" else value(node["input_block"])
            done[key] = SCALAR_TRANSFORMS[node["op"]](x, node.get("params") or {})
        elif node["op"] == "where":
            cond = value(node["cond"]) if node.get("cond") else None
            done[key] = scalar.where(value(node["left"]), value(node["right"]), cond)
        elif node["op"] in COMBINES:
            done[key] = COMBINES[node["op"]](value(node["left"]), value(node["right"]))
        else:
            x = value(node["input_block"])
            done[key] = FILTERS[node["op"]](x, value(node["cond_block"])) if node.get("cond_block") else x
        todo.pop(key)
        moved = True
    return moved


def _asset_stage(df, batch, done, names, value) -> DataFrame:
    cols: dict[str, Column] = {}
    folds = {}
    for key, node in batch.items():
        op, params, x = node["op"], node.get("params") or {}, value(node["input_block"])
        if op in TS_WINDOWS:
            fn, default = TS_WINDOWS[op]
            cols[names[key]] = fn(x, int(params.get("window", default)))
        elif op in TS_PAIRS:
            other = params.get("_right_block")
            cols[names[key]] = TS_PAIRS[op](x, value(other) if other else None, int(params.get("window", 20)))
        elif op == "event_filter":
            event = params.get("event_col", "")
            w = int(params.get("window", 5))
            cols[names[key]] = ts.event_filter(x, F.col(event).cast("double"), w) if event in df.columns else x
        else:
            folds[key] = (x, float(params.get("alpha", 0.1)))
    df = df.withColumns(cols) if cols else df
    for key, (x, alpha) in folds.items():
        df = ts.ema(df.withColumn("_ema_in", x), "_ema_in", names[key], alpha).drop("_ema_in")
    for key in batch:
        done[key] = F.col(names[key])
    return df


def _date_stage(df, batch, done, names, value, wide) -> DataFrame:
    inputs = {f"{names[k]}_x": value(n["input_block"]) for k, n in batch.items()}
    df = df.withColumns(inputs)
    specs = {names[k]: _cross_section(df, n, f"{names[k]}_x") for k, n in batch.items()}
    ranks = {out: f"{out}_x" for out, (kind, keys, _) in specs.items() if kind == "rank" and keys == ["date"]}
    if wide:
        for out, (kind, keys, n) in specs.items():
            df = _cross_section_wide(df, kind, keys, n, f"{out}_x", out)
    elif len(ranks) >= together.MANY:
        df = df.withColumns({out: _cross_section_expr(*spec, f"{out}_x") for out, spec in specs.items() if out not in ranks})
        df = together.rank_columns(df.drop(*[x for x in inputs if x not in ranks.values()]), ranks)
    else:
        df = df.withColumns({out: _cross_section_expr(*spec, f"{out}_x") for out, spec in specs.items()})
    for key in batch:
        done[key] = F.col(names[key])
    return df.drop(*inputs)


def order_core(node: Mapping) -> Mapping:
    """The tree without outer ranks: same order and ties within each date, hence the same rank IC."""
    while node.get("op") == "rank":
        node = node["input_block"]
    if node.get("op") == "mul" and node["left"].get("op") == "constant" and node["left"]["params"]["value"] == -1.0:
        return {**node, "right": order_core(node["right"])}
    return node


# Older node names and the operators they stand for (fixed values of the format).
OLD_NAMES = {"mean": "ts_mean", "std": "ts_std", "min": "ts_min", "max": "ts_max"}


def from_factor_node(node: Mapping) -> dict:
    """Convert the older ``node_type / value / children / params`` form."""
    kind, kids, params = node["node_type"], node.get("children") or [], dict(node.get("params") or {})
    if kind == "feature":
        return {"block_type": "data", "field_name": str(node.get("value") or "")}
    if kind == "constant":
        return {"block_type": "transform", "op": "constant", "params": {"value": float(node.get("value") or 0.0)}}
    op = OLD_NAMES.get(kind, kind)
    if op in COMBINES:
        sides = [from_factor_node(k) for k in kids]
        return {"block_type": "combine", "op": op, "left": sides[0], "right": sides[-1]}
    return {"block_type": "transform", "op": op, "params": params, "input_block": from_factor_node(kids[0])}


def long_form(df: DataFrame, factors: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """One row per (factor_id, date, asset): factor columns become rows, no shuffle."""
    factors = list(factors)
    return df.unpivot(["date", "asset", *keep], factors, "factor_id", "factor_value")
