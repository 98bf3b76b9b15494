"""Parameter sweeps and template grids: many trees, one evaluation job."""

from __future__ import annotations

import copy
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .factors import E, field, op, over, rank
from .tree import children

# The search space of each parameter name.
SPACES = {
    "window": [3, 5, 10, 20, 40, 60],
    "alpha": [0.05, 0.1, 0.2, 0.3],
    "threshold": [0.0, 0.01, 0.02, 0.05],
    "n": [3, 5, 10],
    "lo": [-3.0, -2.0, -1.5],
    "hi": [1.5, 2.0, 3.0],
}


def key_of(node: Mapping, name: str) -> str:
    """A parameter is searched for each operator by itself."""
    return f"{node['op']}__{name}" if node.get("op") else name


def nodes_of(tree: Mapping) -> list[Mapping]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(children(node))
    return out


def default_space(tree: Mapping) -> dict[str, list]:
    """Known parameters use their listed space, others half / same / one and a half or double; keyed operator__parameter."""
    space = {}
    for node in nodes_of(tree):
        for name, value in (node.get("params") or {}).items():
            if name in SPACES:
                space[key_of(node, name)] = SPACES[name]
            elif isinstance(value, bool) or not isinstance(value, (int, float)):
                continue
            elif isinstance(value, float):
                space[key_of(node, name)] = [value * 0.5, value, value * 1.5]
            elif value > 0:
                space[key_of(node, name)] = [max(1, value // 2), value, value * 2]
    return space


def with_parameters(tree: Mapping, values: Mapping) -> dict:
    """The tree with values set by operator__parameter; a bare name sets it on every operator."""
    out = copy.deepcopy(dict(tree))
    for node in nodes_of(out):
        params = node.get("params") or {}
        for name in params:
            for key in (name, key_of(node, name)):
                if key in values:
                    params[name] = values[key]
    return out


def variants(tree: Mapping, space: Mapping[str, Sequence]) -> dict[str, dict]:
    """Every combination of the space, named by its values."""
    names = sorted(space)
    combos = product(*[space[n] for n in names])
    return {
        ",".join(f"{n}={v}" for n, v in zip(names, values)): with_parameters(tree, dict(zip(names, values))) for values in combos
    }


def ranked(scored: DataFrame) -> DataFrame:
    """Mark the best and the worst variant by ICIR, then IC (one row per variant)."""
    everyone = Window.partitionBy(F.lit(0))
    first = everyone.orderBy(F.col("ic_ir").desc(), F.col("ic_mean").desc(), "factor_id")
    last = everyone.orderBy("ic_ir", "ic_mean", "factor_id")
    marks = {"best": first, "worst": last}
    return scored.withColumns({c: (F.row_number().over(w) == 1).cast("int") for c, w in marks.items()}).withColumnRenamed("factor_id", "params")


# The rolling operators of the first template, and the shapes of the last two.
ROLLING = (
    "delta", "lag", "ts_mean", "ts_std", "ts_rank", "ts_min", "ts_max", "ts_sum", "ts_argmax", "ts_argmin", "ema", "rolling_ols_residual",
    "ts_skew", "ts_kurt", "ts_cov",
)
CROSSED = ("sub", "div", "mul")
GROUPED = ("group_neutralize", "group_rank", "group_zscore", "quantile")
SHAPED = ("abs", "log", "sigmoid", "sign")


def template_grid(fields: Sequence[str], windows: Sequence[int]) -> dict[str, dict]:
    """Every tree of the five templates, ranked: rolling, crossed pair, change over spread, grouped and shaped change.

    The first three windows are used for rolling operators, two for the pair of the
    first two fields; changes over spread take 3 and 5 over 20 and 60 rows of the first field.
    """
    out: dict[str, E] = {}
    for f, w, o in product(fields, windows[:3], ROLLING):
        out[f"{o}_{f}_{w}"] = rank(op(o, field(f), **({"alpha": 0.2} if o == "ema" else {"window": w})))
    if len(fields) > 1:
        a, b = fields[:2]
        for w, o in product(windows[:2], CROSSED):
            x, y = (op("zscore", over("delta", field(f), w)) for f in (a, b))
            out[f"cross_{o}_{a}_{b}_{w}"] = rank({"sub": x - y, "div": x / y, "mul": x * y}[o])
    for f, short, long in product(fields[:1], (3, 5), (20, 60)):
        out[f"vol_adj_{f}_{short}_{long}"] = rank(over("delta", field(f), short) / over("ts_std", field(f), long))
    for f, o in product(fields[:2], (*GROUPED, *SHAPED)):
        out[f"{o}_{f}"] = rank(op(o, over("delta", field(f), 5), **({"n": 5} if o == "quantile" else {})))
    return {k: v.node for k, v in out.items()}
