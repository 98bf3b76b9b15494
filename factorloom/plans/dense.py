"""Trees in numpy: series over the rows of an asset, then everything of a date in one grouped pass.

A rolling expression visits every row of its frame again for each of its aggregates, and a
factor column that is made before the rows are dealt by date travels with them.  Here the
partitioning by asset computes series, a few assets at a time, and hands on what the dates
read of them: fields and series, each once however many factors use it, packed by date.
Ranks, what is computed from them, scores and co-moments follow where the date is.

Sums and moments run over a frame from its oldest row by the updates that Spark's own
aggregates use.  NULL is NaN, and a NaN counts as NULL.  For dates that fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import TINY, number
from ..operators import together
from ..operators.gram import STATE, batch_state, merged, pair_names, state_columns
from ..operators.ts import forward_return, series
from . import tree

SERIES = {"lag", "ts_mean", "ts_sum", "ts_std", "ts_max", "ts_min", "ts_rank", "ts_argmax", "ts_argmin", "ts_skew", "ts_kurt", "ts_corr", "ts_cov", "ema"}
DATED = {"rank", "zscore", "quantile", "group_neutralize", "group_rank", "group_zscore"}
GROUPED = {"group_neutralize", "group_rank", "group_zscore"}
ROWS = {*tree.SCALAR_TRANSFORMS, *tree.COMBINES, *tree.FILTERS}

LEAVES = 48  # columns that a date's rows have in one group
CELLS = 1 << 15  # of the assets whose series are computed at once
PACKED = 1 << 22  # values that a task holds before it hands them on by date
SLICE = 1 << 14  # rows of a date that are folded into co-moments at once


# -- trees ------------------------------------------------------------------------------------


def _plain(node: Mapping) -> Mapping:
    """The node over plain children; a change is a difference to a lag, so that the dates get the lag alone."""
    node = tree._plain(node)
    if node["block_type"] == "data" or node.get("op") == "constant":
        return node
    made = {k: _plain(v) if k in ("input_block", "left", "right", "cond", "cond_block") and v else v for k, v in node.items()}
    params = dict(node.get("params") or {})
    if params.get("_right_block"):
        made["params"] = params | {"_right_block": _plain(params["_right_block"])}
    if node["op"] == "delta":
        x = made["input_block"]
        lag = {"block_type": "transform", "op": "lag", "params": {"window": int(params.get("window", 1))}, "input_block": x}
        return {"block_type": "combine", "op": "sub", "left": x, "right": lag}
    return made


def _swap(node: Mapping, by: Mapping[str, Mapping]) -> Mapping:
    """The node with the subtrees of the given keys exchanged."""
    if tree._key(node) in by:
        return by[tree._key(node)]
    if node["block_type"] == "data" or node.get("op") == "constant":
        return node
    made = {k: _swap(v, by) if k in ("input_block", "left", "right", "cond", "cond_block") and v else v for k, v in node.items()}
    if (node.get("params") or {}).get("_right_block"):
        made["params"] = {**node["params"], "_right_block": _swap(node["params"]["_right_block"], by)}
    return made


def _nodes(roots: Sequence[Mapping]) -> dict[str, Mapping]:
    found: dict[str, Mapping] = {}
    for root in roots:
        tree._collect(root, found)
    return found


def supports(trees: Mapping[str, Mapping]) -> bool:
    """Whether all operators of the trees are computed here; dates below a series may have any."""
    plain = [_plain(t) for t in trees.values()]
    below = tree._feeds_series(_nodes(plain))
    for key, node in _nodes(plain).items():
        op = node.get("op")
        if node["block_type"] == "data" or op in ROWS or op in SERIES or (tree._kind(node) == "date" and key in below):
            continue
        if op not in DATED or (op == "quantile" and int((node.get("params") or {}).get("n", 5)) < 2):
            return False
    return True


def _leaves(node: Mapping, found: dict[str, Mapping]) -> None:
    """What a date reads of a tree: fields and outermost series."""
    if node["block_type"] == "data" or tree._kind(node) == "asset":
        found[tree._key(node)] = node
    elif node.get("op") != "constant":
        for child in tree.children(node):
            _leaves(child, found)


# -- rows -------------------------------------------------------------------------------------


def _divide(a, b):
    return np.where(b != 0, a / (np.maximum(np.abs(b), TINY) * np.sign(b)), np.nan)


def _clip(x, lo, hi):
    return np.minimum(np.maximum(x, lo), hi)


def _row(node: Mapping, value: Callable):
    """A row-level operator over values of any shape."""
    op, p = node["op"], node.get("params") or {}
    if op == "constant":
        return float(p.get("value", 0.0))
    if op in tree.COMBINES:
        a, b = value(node["left"]), value(node["right"])
        if op == "where":
            return np.where((value(node["cond"]) > 0) if node.get("cond") else (a > b), a, b)
        return {"add": np.add, "sub": np.subtract, "mul": np.multiply, "div": _divide, "max": np.maximum, "min": np.minimum}[op](a, b)
    x = value(node["input_block"])
    if op in tree.FILTERS:
        if not node.get("cond_block"):
            return x
        c = value(node["cond_block"])
        return np.where(c > 0, x, np.nan) if op == "where_condition" else x * np.abs(c)
    if op == "piecewise":
        return np.where(x > float(p.get("threshold", 0.0)), 1.0, 0.0)
    if op == "clip":
        return _clip(x, float(p.get("lo", -3.0)), float(p.get("hi", 3.0)))
    if op == "power":
        return np.power(_clip(x, -1e10, 1e10), float(p.get("exponent", 2.0)))
    if op == "sigmoid":
        return 1.0 / (1.0 + np.exp(-_clip(x, -50.0, 50.0)))
    return {"abs": np.abs, "sign": np.sign, "log": lambda v: np.log(np.maximum(v, TINY)), "sqrt": lambda v: np.sqrt(np.maximum(v, 0.0))}[op](x)


# -- series: arrays of (asset, row), every asset's rows from the left ---------------------------


def _padded(x: np.ndarray, w: int, gap: float) -> np.ndarray:
    return np.concatenate([np.full((len(x), w - 1), gap), x], axis=1)


def _steps(x: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """The values of every row's frame from the oldest to its own."""
    for k in range(w):
        yield x[:, k : k + x.shape[1] - w + 1]


def _lag(x: np.ndarray, w: int) -> np.ndarray:
    out = np.full(x.shape, np.nan)
    out[:, w:] = x[:, : max(x.shape[1] - w, 0)]
    return out


def _total(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the values of every frame."""
    has = ~np.isnan(x)
    n, s = np.zeros(x.shape), np.zeros(x.shape)
    for v, m in zip(_steps(_padded(np.where(has, x, 0.0), w, 0.0), w), _steps(_padded(has.astype(float), w, 0.0), w)):
        n += m
        s += v
    return n, s


def _extreme(x: np.ndarray, w: int, pick: Callable) -> np.ndarray:
    """The largest or smallest value of every frame, from frames of 1, 2, 4, ... rows."""
    cols, cur, span = x.shape[1], _padded(x, w, np.nan), 1
    while span * 2 <= w:
        cur = pick(cur[:, :-span], cur[:, span:])
        span *= 2
    return pick(cur[:, :cols], cur[:, w - span : w - span + cols])


def _moments(x: np.ndarray, w: int, order: int) -> list[np.ndarray]:
    """n and the centred sums of powers 2 to ``order`` of every frame."""
    has = ~np.isnan(x)
    n, avg, m2, m3, m4 = (np.zeros(x.shape) for _ in range(5))
    for v, m in zip(_steps(_padded(np.where(has, x, 0.0), w, 0.0), w), _steps(_padded(has.astype(float), w, 0.0), w)):
        n += m
        d = (v - avg) * m
        dn = d / np.maximum(n, 1.0)
        avg += dn
        m2 += d * (d - dn)
        if order > 2:
            d2, dn2 = d * d, dn * dn
            m3 = m3 - 3.0 * dn * m2 + d * (d2 - dn2)
            if order > 3:
                m4 = m4 - 4.0 * dn * m3 - 6.0 * dn2 * m2 + d * (d * d2 - dn * dn2)
    return [n, m2, m3, m4]


def _co_moments(x: np.ndarray, y: np.ndarray, w: int) -> list[np.ndarray]:
    """n, both centred sums of squares and that of products of the complete pairs of every frame."""
    pair = ~(np.isnan(x) | np.isnan(y))
    sides = (np.where(pair, x, 0.0), np.where(pair, y, 0.0), pair.astype(float))
    n, ax, ay, xx, yy, xy = (np.zeros(x.shape) for _ in range(6))
    for u, v, m in zip(*[_steps(_padded(s, w, 0.0), w) for s in sides]):
        n += m
        some = np.maximum(n, 1.0)
        dx, dy = (u - ax) * m, (v - ay) * m
        sx, sy = dx / some, dy / some
        ax += sx
        ay += sy
        xx += dx * (dx - sx)
        yy += dy * (dy - sy)
        xy += dx * (v - ay)
    return [n, xx, yy, xy]


def _rank(x: np.ndarray, w: int) -> np.ndarray:
    below, equal, n = (np.zeros(x.shape) for _ in range(3))
    for v in _steps(_padded(x, w, np.nan), w):
        below += v < x
        equal += v == x
        n += ~np.isnan(v)
    return np.where(np.isnan(x), np.nan, (below + (equal + 1) / 2.0) / n)


def _place(x: np.ndarray, w: int, largest: bool) -> np.ndarray:
    """Place (from 0) of the first extreme of every frame over w; a gap counts as the extreme."""
    end = np.inf if largest else -np.inf
    held = _padded(np.where(np.isnan(x), end, x), w, -end)
    best, place = np.full(x.shape, -end), np.zeros(x.shape)
    for k, v in enumerate(_steps(held, w)):
        better = v > best if largest else v < best
        best = np.where(better, v, best)
        place[better] = k
    missing = w - np.minimum(np.arange(x.shape[1]) + 1, w)  # rows of a frame before the first of the asset
    return np.where(_total(x, w)[0] > 0, (place - missing) / float(w), np.nan)


def _ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean from the first value on; old weight keeps decaying over gaps."""
    out, mean, age = np.empty(x.shape), np.full(len(x), np.nan), np.zeros(len(x))
    for t in range(x.shape[1]):
        v = x[:, t]
        age += 1
        old = np.power(1.0 - alpha, age)
        got = ~np.isnan(v)
        first = got & np.isnan(mean)
        mean = np.where(first, v, np.where(got, old / (old + alpha) * mean + alpha * v / (old + alpha), mean))
        age[got] = 0
        out[:, t] = mean
    return out


def _series(node: Mapping, value: Callable) -> np.ndarray:
    op, p, x = node["op"], node.get("params") or {}, value(node["input_block"])
    if op == "ema":
        return _ema(x, float(p.get("alpha", 0.1)))
    w = int(p.get("window", 1 if op == "lag" else 20))
    if op == "lag":
        return _lag(x, w)
    if op in ("ts_mean", "ts_sum"):
        n, s = _total(x, w)
        return np.where(n > 0, s / n if op == "ts_mean" else s, np.nan)
    if op in ("ts_max", "ts_min"):
        return _extreme(x, w, np.fmax if op == "ts_max" else np.fmin)
    if op == "ts_rank":
        return _rank(x, w)
    if op in ("ts_argmax", "ts_argmin"):
        return _place(x, w, op == "ts_argmax")
    if op in ("ts_corr", "ts_cov"):
        n, xx, yy, xy = _co_moments(x, value(p["_right_block"]) if p.get("_right_block") else x, w)
        if op == "ts_cov":
            return np.where(n > 1, xy / (n - 1), np.nan)
        spread = np.sqrt(xx / n) * np.sqrt(yy / n)
        return np.round(_clip(np.where((n > 0) & (spread != 0), xy / n / spread, np.nan), -1.0, 1.0), 12)
    if op == "ts_std":
        n, m2, _, _ = _moments(x, w, 2)
        return np.where(n > 1, np.sqrt(m2 / (n - 1)), np.nan)
    n, m2, m3, m4 = _moments(x, w, 3 if op == "ts_skew" else 4)
    flat = _extreme(x, w, np.fmin) == _extreme(x, w, np.fmax)
    if op == "ts_skew":
        raw = np.where(m2 != 0, np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2), np.nan)
        return np.where((n >= w // 2) & (n >= 3), np.where(flat, 0.0, np.sqrt(n * (n - 1)) / (n - 2) * raw), np.nan)
    raw = np.where(m2 != 0, n * m4 / (m2 * m2) - 3.0, np.nan)
    return np.where((n >= w // 2) & (n >= 4), np.where(flat, -3.0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * raw + 6)), np.nan)


def _of_assets(leaves: Sequence[Mapping], fields: Mapping[str, np.ndarray]) -> list[np.ndarray]:
    """The leaves over arrays of (asset, row)."""
    known = dict(fields)
    shape = next(iter(fields.values())).shape

    def value(node: Mapping):
        key = tree._key(node)
        if key not in known:
            made = _series(node, value) if tree._kind(node) == "asset" else _row(node, value)
            known[key] = made if isinstance(made, np.ndarray) else np.full(shape, made)
        return known[key]

    with np.errstate(all="ignore"):
        return [value(n) for n in leaves]


# -- dates ------------------------------------------------------------------------------------


def _grouped_ranks(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Average rank of values within their group over its number of values."""
    order = np.lexsort((x, group))
    s, g = x[order], group[order]
    edge = np.ones(len(s), dtype=bool)
    edge[1:] = g[1:] != g[:-1]
    new = edge.copy()
    new[1:] |= s[1:] != s[:-1]
    starts, firsts = np.flatnonzero(new), np.flatnonzero(edge)
    counts, sizes = np.diff(np.append(starts, len(s))), np.diff(np.append(firsts, len(s)))
    place = np.repeat(starts + (counts + 1) / 2.0, counts) - np.repeat(firsts, sizes)
    out = np.empty(len(s))
    out[order] = place / np.repeat(sizes, sizes)
    return out


def _on_date(node: Mapping, x: np.ndarray, group: np.ndarray | None, names: np.ndarray | None) -> np.ndarray:
    """A cross-sectional operator over the rows of one date."""
    op, out = node["op"], np.full(len(x), np.nan)
    has = ~np.isnan(x)
    v = x[has]
    if op == "group_neutralize" and group is None:
        return x
    at = group[has] if op in GROUPED and group is not None else np.zeros(len(v), dtype=np.int64)
    if not len(v):
        return out
    if op in ("rank", "group_rank"):
        steady = together.steadied(v)
        out[has] = together.average_ranks(steady) / len(v) if op == "rank" else _grouped_ranks(steady, at)
    elif op == "quantile":
        n = int((node.get("params") or {}).get("n", 5))
        place = np.empty(len(v))
        place[np.lexsort((names[has], together.steadied(v)))] = np.arange(len(v)) * float(n)
        out[has] = np.maximum(0.0, np.ceil(place / max(len(v) - 1, 1)) - 1) / (n - 1)
    else:
        n = np.bincount(at)
        mean = np.bincount(at, v) / np.maximum(n, 1)
        far = v - mean[at]
        if op == "group_neutralize":
            out[has] = far
        else:
            spread = np.sqrt(np.bincount(at, far * far) / np.maximum(n - 1, 1))
            out[has] = np.where(n[at] > 1, far / (spread[at] + TINY), np.nan)
    return out


def _of_date(node: Mapping, leaves: Mapping[str, np.ndarray], rows: int, group: np.ndarray | None, names: np.ndarray | None) -> np.ndarray:
    """A tree over the rows of one date."""

    def value(node: Mapping):
        key = tree._key(node)
        if key in leaves:
            return leaves[key]
        if tree._kind(node) == "date":
            return _on_date(node, np.broadcast_to(value(node["input_block"]), rows), group, names)
        return _row(node, value)

    with np.errstate(all="ignore"):
        return np.broadcast_to(np.asarray(value(node), dtype=float), rows)


# -- rows by date -----------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Columns as bytes: the n-th bytes of a column side by side, as they are alike."""
    split = np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, 8).transpose(0, 2, 1)
    return pa.Codec("zstd", compression_level=1).compress(split.tobytes(), asbytes=True)


def _unpack(data: bytes, cols: int, rows: int) -> np.ndarray:
    raw = pa.decompress(data, cols * rows * 8, codec="zstd", asbytes=True)
    split = np.frombuffer(raw, np.uint8).reshape(cols, 8, rows).transpose(0, 2, 1)
    return np.ascontiguousarray(split).view(float).reshape(cols, rows)


class Plan:
    """Which leaves the dates need of which trees, in blocks of at most so many leaves."""

    def __init__(self, trees: Mapping[str, Mapping], labels: Sequence[str], most: int | None = LEAVES, columns: Sequence[str] = ()):
        alike: dict[str, tuple[Mapping, list[str]]] = {}
        for name, node in trees.items():
            alike.setdefault(tree._key(node), (node, []))[1].append(name)
        self.labels = [tree._key({"block_type": "data", "field_name": c}) for c in labels]
        own = {k: {"block_type": "data", "field_name": c} for k, c in zip(self.labels, labels)}
        self.blocks: list[tuple[dict[str, Mapping], list[tuple[Mapping, list[str]]]]] = []
        for node, names in alike.values():
            found: dict[str, Mapping] = {}
            _leaves(node, found)
            if not self.blocks or (most and len({**self.blocks[-1][0], **found}) > most):
                self.blocks.append((dict(own), []))
            self.blocks[-1][0].update(found)
            self.blocks[-1][1].append((node, names))
        nodes = _nodes([n for n, _ in alike.values()])
        self.fields = sorted({n["field_name"] for n in nodes.values() if n["block_type"] == "data"} | set(labels))
        groups = {n.get("group_key") or "industry" for n in nodes.values() if n.get("op") in GROUPED} & set(columns)
        if len(groups) > 1:
            raise ValueError(f"one grouping column at a time: {sorted(groups)}")
        self.group = next(iter(groups), None)
        self.named = any(n.get("op") == "quantile" for n in nodes.values())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole assets of a partition that comes in order of assets: a table and where each asset starts, some ``CELLS`` rows at a time."""
    held: list[pa.Table] = []
    rows, before = 0, None

    def place(t: pa.Table, i: int) -> tuple:
        name = t.column("asset")[i].as_py()
        return (False,) if name is None else (True, name)

    def cut(t: pa.Table) -> np.ndarray:
        code = t.column("asset").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        if len(np.unique(code)) != len(starts) or (before is not None and place(t, 0) <= before):
            raise RuntimeError("the rows of an asset are apart")
        return starts

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < CELLS:
            continue
        t = pa.concat_tables(held)
        starts = cut(t)
        whole = int(starts[-1])
        if whole:
            before = place(t, whole - 1)
            yield t.slice(0, whole), starts[:-1]
        held, rows = [t.slice(whole)], t.num_rows - whole
    if rows:
        t = pa.concat_tables(held)
        yield t, cut(t)


def _grid(column: pa.ChunkedArray, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[row, col] = column.to_numpy().astype(float)
    return out


def by_date(df: DataFrame, trees: Mapping[str, Mapping], labels: Mapping[str, int], most: int | None = LEAVES) -> tuple[DataFrame, Plan]:
    """The panel's leaves of the trees, packed: (date, _block, n, data, grp, names), a row for the rows of a date of some assets.

    Labels are forward returns over so many rows. Dates that feed series are computed first.
    """
    plain = {k: _plain(t) for k, t in trees.items()}
    nodes = _nodes(list(plain.values()))
    below = tree._feeds_series(nodes)
    dated = {k: n for k, n in nodes.items() if k in below and tree._kind(n) == "date"}
    inner = {k for n in dated.values() for k in _nodes(tree.children(n))}
    early = {k: f"_e{i}" for i, k in enumerate(k for k in dated if k not in inner)}
    made = {c: forward_return(h) for c, h in labels.items()}
    if early:  # after the labels, in whose order means of dates were always summed
        df = df.withColumns(made)
        df = tree.evaluate(df, {name: dated[k] for k, name in early.items()}, keep=df.columns)
        made = {"_at": F.row_number().over(series())}
        fields = {k: {"block_type": "data", "field_name": name} for k, name in early.items()}
        plain = {k: _swap(n, fields) for k, n in plain.items()}
    plan = Plan(plain, list(labels), most, df.columns)
    absent = sorted(set(plan.fields) - set(labels) - set(df.columns))
    if absent:
        raise ValueError(f"panel lacks field: {absent[0]}")
    # This last window brings an asset's rows together, in order of their dates.
    df = df.withColumns(made)
    extra = [F.col(plan.group).cast("string").alias("_g")] if plan.group else []
    extra += [F.col("_at")] if early else []
    values = [number(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(plan.fields)]
    source = df.select("date", "asset", *extra, *values)

    fields = [tree._key({"block_type": "data", "field_name": c}) for c in plan.fields]
    blocks = [list(leaves.values()) for leaves, _ in plan.blocks]
    every = {tree._key(n): n for leaves in blocks for n in leaves}
    spots = {k: i for i, k in enumerate(every)}
    group, named = plan.group, plan.named

    def packed(held: list[tuple[pa.Table, np.ndarray]]) -> pa.RecordBatch:
        t = pa.concat_tables([t for t, _ in held])
        values = np.concatenate([v for _, v in held], axis=1)
        dates = t.column("date").combine_chunks()
        code = dates.dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        ends = np.append(cuts[1:], len(order))
        parts, data, groups, names = [], [], [], []
        tags = t.column("_g").combine_chunks() if group else None
        who = t.column("asset").combine_chunks() if named else None
        for s, e in zip(cuts, ends):
            at = order[s:e]
            own = values[:, at]
            g = tags.take(pa.array(at)).to_pylist() if group else None
            a = who.take(pa.array(at)).to_pylist() if named else None
            for b, leaves in enumerate(blocks):
                parts.append((at[0], b, e - s))
                data.append(_pack(own[[spots[tree._key(n)] for n in leaves]]))
                groups.append(g)
                names.append(a)
        first, block, n = zip(*parts)
        return pa.RecordBatch.from_pydict(
            {
                "date": dates.take(pa.array(first, pa.int64())),
                "_block": pa.array(block, pa.int32()),
                "n": pa.array(n, pa.int64()),
                "data": pa.array(data, pa.binary()),
                "grp": pa.array(groups, pa.list_(pa.string())),
                "names": pa.array(names, pa.list_(pa.string())),
            }
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t, starts in _runs(batches):
            lengths = np.diff(np.append(starts, t.num_rows))
            # Assets of like length side by side, so that none is padded to far beyond its rows.
            made = np.empty((len(every), t.num_rows))
            row_of, col_of = np.repeat(np.arange(len(starts)), lengths), np.arange(t.num_rows) - np.repeat(starts, lengths)
            bits = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
            for size_class in np.unique(bits):
                mine = np.flatnonzero(bits == size_class)
                place = np.full(len(starts), -1)
                place[mine] = np.arange(len(mine))
                at = np.flatnonzero(place[row_of] >= 0)
                row, col, shape = place[row_of[at]], col_of[at], (len(mine), int(lengths[mine].max()))
                got = {k: _grid(t.column(f"_f{i}").take(pa.array(at)), row, col, shape) for i, k in enumerate(fields)}
                for i, v in enumerate(_of_assets(list(every.values()), got)):
                    made[i, at] = v[row, col]
            held.append((t.select(["date", "asset", *(["_g"] if group else [])]), made))
            size += made.size
            if size >= PACKED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    kinds = [df.schema["date"], T.StructField("_block", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())]
    kinds += [T.StructField(c, T.ArrayType(T.StringType())) for c in ("grp", "names")]
    return source.mapInArrow(deal, T.StructType(kinds)), plan


def _codes(lists: pa.ChunkedArray) -> np.ndarray:
    """Numbers of strings, in their order."""
    flat = [v for part in lists.to_pylist() for v in part]
    known = {v: i for i, v in enumerate(sorted(set(flat), key=lambda v: (v is not None, (v or "").encode())))}
    return np.array([known[v] for v in flat], dtype=np.int64)


def _columns(rows: pa.Table, leaves: Sequence[str]) -> tuple[dict[str, np.ndarray], int]:
    """The unpacked leaves of a date."""
    sizes = rows.column("n").to_pylist()
    total, at = sum(sizes), 0
    out = np.empty((len(leaves), total))
    for n, data in zip(sizes, rows.column("data")):
        out[:, at : at + n] = _unpack(data.as_py(), len(leaves), n)
        at += n
    return dict(zip(leaves, out)), total


def scores(df: DataFrame, trees: Mapping[str, Mapping], labels: Mapping[str, int]) -> DataFrame:
    """(factor_id, label, date, n, rank_ic, n_rows, n_values) of the trees over a panel: rank IC of the complete pairs of each date with each label.

    ``labels`` are forward returns over so many rows. Equal trees are scored once.
    """
    packed, plan = by_date(df, trees, labels)
    keys, shown = plan.labels, list(labels)
    blocks = [([*leaves], found) for leaves, found in plan.blocks]
    group, named = plan.group, plan.named

    def scored(rows: pa.Table) -> pa.Table:
        leaves, found = blocks[rows.column("_block")[0].as_py()]
        cols, total = _columns(rows, leaves)
        tags, who = _codes(rows.column("grp")) if group else None, _codes(rows.column("names")) if named else None
        sides = []
        for key in keys:
            y, has = cols[key], ~np.isnan(cols[key])
            y = together.steadied(y)
            sides.append((y, has, np.argsort(y)))
        made = []
        for node, ids in found:
            x = _of_date(node, cols, total, tags, who)
            valid = ~np.isnan(x)
            for side, label in zip(sides, shown):
                got = together.pair_score(x, valid, *side)
                made += [(name, label, *got) for name in ids]
        ids, label, n, ic, n_rows, n_values = zip(*made)
        return pa.table(
            {
                "factor_id": pa.array(ids, pa.string()),
                "label": pa.array(label, pa.string()),
                "date": rows.column("date").take(pa.array([0] * len(made))),
                "n": pa.array(n, pa.int64()),
                "rank_ic": pa.array(ic, pa.float64()),
                "n_rows": pa.array(n_rows, pa.int64()),
                "n_values": pa.array(n_values, pa.int64()),
            }
        )

    kinds = {"factor_id": T.StringType(), "label": T.StringType(), "date": df.schema["date"].dataType, "n": T.LongType(), "rank_ic": T.DoubleType()}
    kinds |= {"n_rows": T.LongType(), "n_values": T.LongType()}
    return packed.groupBy("date", "_block").applyInArrow(scored, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))


def states(df: DataFrame, trees: Mapping[str, Mapping]) -> DataFrame:
    """(f1, f2, ...) the co-moments of all pairs of trees over the rows of each date, for ``gram.whole_moments``."""
    packed, plan = by_date(df, trees, {"_near": 1}, most=None)
    ((leaves, found),) = plan.blocks
    leaves, group, named = [*leaves], plan.group, plan.named
    order = sorted(trees)
    left, right, upper = pair_names(order)
    spot = {name: i for i, name in enumerate(order)}

    def folded(rows: pa.Table) -> pa.Table:
        cols, total = _columns(rows, leaves)
        tags, who = _codes(rows.column("grp")) if group else None, _codes(rows.column("names")) if named else None
        values = np.empty((total, len(order)))
        for node, ids in found:
            values[:, [spot[i] for i in ids]] = _of_date(node, cols, total, tags, who)[:, None]
        state = None
        for at in range(0, total, SLICE):
            s = batch_state(values[at : at + SLICE])
            state = s if state is None else merged(state, s)
        return pa.table({"f1": pa.array(left, pa.string()), "f2": pa.array(right, pa.string())} | state_columns(state, upper))

    return packed.groupBy("date").applyInArrow(folded, "f1 string, f2 string, " + ", ".join(f"{s} double" for s in STATE))
