"""Histogram gradient-boosted trees over document statistics.

Statistics (``STATISTICS``) come from the whole bytes of a text. Trees grow level
by level on binned values; all trees are then flattened into arrays of features,
thresholds, children and leaf values, and numpy walks every row of a batch down
one level at a time.

Learning uses at most ``per_class`` labelled rows of each class (a documented
bound), scoring reads every whole text. Null and empty texts have all-zero
statistics and get the score of their leaf. Without labels of both classes every
text gets the share of positive rows (0 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .labelled import sample, with_text
from .store import carried
from .words import NOT_SPACE, mix, slices, words

STATISTICS = (
    "bytes", "words", "word_bytes", "upper", "lower", "digits", "beyond_ascii", "full_stops", "commas", "marks", "symbols", "bars",
    "lines", "line_words", "distinct_words", "repeated_next", "repeated_lines", "symbol_words", "mark_words", "upper_words", "short_words",
    "one_letter", "word_spread",
)


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER_LETTER, DIGITS = _kind(bytes(range(65, 91))), _kind(bytes(range(97, 123))), _kind(b"0123456789")
BEYOND, MARKS, SYMBOLS = _kind(bytes(range(128, 256))), _kind(b"!?"), _kind(b"*#$%&@^~_=<>+\\/{}[]")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    w = words(data, offsets, NOT_SPACE)
    per = np.diff(w.first).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(size, 1)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.row, values, n) / np.maximum(per, 1)

    def distinct(row: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(row):
            return np.zeros(n)
        keys = np.unique(mix(h) ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        return np.bincount(row[keys], minlength=n)

    lengths = (w.ends - w.starts).astype(float)
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    again = np.zeros(len(w.row))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    ups = np.concatenate([[0], np.cumsum(UPPER[data])])
    breaks = data == 10
    not_break = np.ones(256, bool)
    not_break[10] = False
    lines = words(data, offsets, not_break)
    per_line = np.diff(lines.first).astype(float)
    mean = by_word(lengths)
    return np.column_stack([
        size, per, mean, share(UPPER[data]), share(LOWER_LETTER[data]), share(DIGITS[data]), share(BEYOND[data]), share(data == 46), share(data == 44),
        share(MARKS[data]), share(SYMBOLS[data]), share(data == 124), share(breaks), per / np.maximum(per_line, 1),
        distinct(w.row, w.hashes) / np.maximum(per, 1), by_word(again), 1 - distinct(lines.row, lines.hashes) / np.maximum(per_line, 1) * (per_line > 0) - (per_line == 0),
        by_word(SYMBOLS[last].astype(float)), by_word(MARKS[last].astype(float)), by_word((ups[w.ends] - ups[w.starts] >= 2).astype(float)), by_word((lengths <= 3).astype(float)),
        by_word((lengths == 1).astype(float)), np.sqrt(np.maximum(by_word(lengths**2) - mean**2, 0)),
    ])


@dataclass
class Trees:
    """All trees one after the other; a leaf is its own child on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, z = np.arange(len(x)), np.full(len(x), self.start)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            z += self.value[at]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 5.0, penalty: float = 1.0) -> Trees:
    """Logistic loss, second-order gains, histograms of equal-count bins."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)])
    spot = binned + np.arange(m) * bins
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    z = np.full(n, start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        level, where = [len(nodes) - 1], np.full(n, len(nodes) - 1)
        for d in range(depth + 1):
            below = []
            slot = {k: i for i, k in enumerate(level)}
            own = np.array([slot.get(k, -1) for k in range(roots[-1], len(nodes))])[where - roots[-1]]
            live = own >= 0
            width = m * bins
            at = (own[live, None] * width + spot[live]).ravel()
            hist = [np.bincount(at, np.repeat(v[live], m), len(level) * width).reshape(len(level), m, bins) for v in (g, h, np.ones(n))]
            for i, k in enumerate(level):
                sg, sh, sn = (v[i].cumsum(axis=1) for v in hist)
                tg, th, tn = sg[0, -1], sh[0, -1], sn[0, -1]
                nodes[k][4] = float(-rate * tg / (th + penalty))
                if d == depth:
                    continue
                gain = sg**2 / (sh + penalty) + (tg - sg) ** 2 / (th - sh + penalty) - tg**2 / (th + penalty)
                gain[(sn < least) | (tn - sn < least)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                a = len(nodes)
                nodes += [[0, 0.0, a, a, 0.0], [0, 0.0, a + 1, a + 1, 0.0]]
                nodes[k][:4] = [int(j), float(cuts[j][b]), a, a + 1]
                mine = where == k
                where[mine] = np.where(binned[mine, j] <= b, a, a + 1)
                below += [a, a + 1]
            level = below
            if not level:
                break
        z += np.array([x[4] for x in nodes])[where]
    f, t, le, r, v = zip(*nodes, strict=True)
    return Trees(np.array(roots), np.array(f), np.array(t), np.array(le), np.array(r), np.array(v), start, depth)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", per_class: int = 10_000, **shape) -> Trees:
    """Learn from labels of rows that aren't held out; at most ``per_class`` rows of each class."""
    rows = with_text(docs, sample(labels, label, per_class), text).select("text", "label")

    def run(stream):
        for batch in stream:
            y = batch.column(1)
            for lo, hi, data, offsets in slices(batch.column(0)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([y.slice(lo, hi - lo), *[pa.array(c) for c in x.T]], names=["label", *STATISTICS])

    got = rows.mapInArrow(run, "label int, " + ", ".join(f"`{c}` double" for c in STATISTICS)).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)  # the same model whatever the order of the rows
    y, x = got["label"].to_numpy(), got[list(STATISTICS)].to_numpy()
    if len(set(y)) < 2:
        leaf = np.zeros(1, int)
        return Trees(leaf, leaf, np.zeros(1), leaf, leaf, np.zeros(1), 40.0 if y.sum() else -40.0, 0)
    return boost(x, y, **shape)


def score(df: DataFrame, trees: Trees, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with the probability of label 1; an existing column of that name is replaced."""
    rest = [c for c in df.columns if c != to]
    cols, fields = carried(df, rest)
    schema = T.StructType([*fields, T.StructField(to, T.DoubleType())])

    def run(stream):
        for batch in stream:
            p = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch.column(0)):
                p[lo:hi] = trees.predict(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=schema.names)

    return df.select(df[text].alias("_text_"), *cols).mapInArrow(run, schema).toDF(*rest, to)
