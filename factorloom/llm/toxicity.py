"""A linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

1. Counts: for every hashed n-gram, in how many labelled texts of either class it
   occurs (Spark sums the counts of the tasks).
2. Ratios: r = log((a + s) / (A + 2s)) - log((b + s) / (B + 2s)) for a of A positive
   and b of B negative texts. The ``features`` n-grams with the clearest difference
   in share are kept, at least ``clear`` standard errors; n-grams whose shares
   differ by chance would only add up in long texts.
3. Weights: logistic regression with an L2 penalty on x_j = r_j * present_j.

Of labelled near copies one is used (``labelled.one_of_each``). Learning uses at most ``most`` labelled rows (a documented bound); scoring reads every whole text. Null and empty texts have no n-grams
and get the score of the intercept. If a class has no labelled rows, every text
gets the share of positive rows (0 without labels). Repeated rows get equal
scores; other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import one_of_each, sample, with_text
from .store import carried, written
from .words import U, mix, slices

_folds = [chr(i).lower() if not 0xD800 <= i < 0xE000 else "??" for i in range(1 << 16)]
LOWER_CODE = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(_folds)], np.uint32)
STEP = U(0x9E3779B97F4A7C15)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, and the row of each."""
    text = data.tobytes().decode("utf-8", "replace")
    got = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = np.where(got < len(LOWER_CODE), LOWER_CODE[np.minimum(got, len(LOWER_CODE) - 1)], got)
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    return got, np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(upto))


def grams(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int):
    """(row, hashed n-gram) of every position, one n-gram size at a time."""
    c, row = codes(data, offsets)
    if not len(c):
        return
    c = mix(c.astype(np.uint64) + U(1))
    h = c.copy()
    for n in range(2, max(sizes) + 1):
        if len(c) < n:
            return
        h = h[:-1] + c[n - 1 :] * U(pow(int(STEP), n - 1, 1 << 64))
        if n in sizes:
            inside = row[: len(h)] == row[n - 1 :]
            yield row[: len(h)][inside], ((h[inside] * STEP) >> U(64 - bits)).astype(np.int64)


@dataclass
class Model:
    sizes: tuple[int, ...]
    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.weights
        return out

    def present(self, data, offsets, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, bucket) pairs of the model's n-grams."""
        pairs = [(r[k], b[k]) for r, b in grams(data, offsets, self.sizes, self.bits) for k in [known[b]]]
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.unique(np.concatenate([(r.astype(np.int64) << self.bits) | b for r, b in pairs]))
        return keys >> self.bits, keys & ((1 << self.bits) - 1)


def counts(rows: DataFrame, sizes: tuple[int, ...], bits: int) -> DataFrame:
    """(bucket, negative texts with it, positive texts with it)."""

    def run(stream):
        n = np.zeros((2, 1 << bits), np.int32)
        for batch in stream:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(0)):
                found = [(r.astype(np.int64) << bits) | b for r, b in grams(data, offsets, sizes, bits)]
                if found:
                    keys = np.unique(np.concatenate(found))
                    label, bucket = y[lo:hi][keys >> bits], keys & ((1 << bits) - 1)
                    for k in (0, 1):
                        np.add.at(n[k], bucket[label == k], 1)
        at = np.flatnonzero(n.any(axis=0))
        for lo in range(0, len(at), 1 << 16):
            k = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[0, k].astype(np.int64)), pa.array(n[1, k].astype(np.int64))], names=["bucket", "n0", "n1"])

    got = rows.select("text", "label").mapInArrow(run, "bucket long, n0 long, n1 long")
    return got.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method, on the mean log loss."""
    n, k = x.shape
    x = np.column_stack([x, np.ones(n, x.dtype)])
    ridge = np.full(k + 1, penalty)
    ridge[k] = 1e-9
    weight = np.full(n, 1 / n)

    def loss(w):
        z = x @ w
        return float(weight @ np.logaddexp(0, np.where(y == 1, -z, z)) + 0.5 * ridge @ w**2)

    w = np.zeros(k + 1)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = ((x * (weight * p * (1 - p) + 1e-12)[:, None].astype(x.dtype)).T @ x).astype(float)
        bend[np.diag_indices(k + 1)] += ridge
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - after < 1e-10:
            break
        w, now = w - size * step, after
    return w[:k], float(w[k])


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", sizes: tuple[int, ...] = (4, 5), bits: int = 22,
    most: int = 12_000, features: int = 1024, clear: float = 4.5, smooth: float = 1.0, penalty: float = 1e-4,
) -> Model:
    """Learn from labels of rows that aren't held out; at most ``most`` rows."""
    rows = written(one_of_each(with_text(docs, sample(labels, label, most=most), text)).select("text", "label"), "toxicity-rows")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(sizes, bits, np.zeros(0, np.int64), np.zeros(0), 40.0 if share else -40.0)
    share0, share1, both = F.col("n0") / n0, F.col("n1") / n1, (F.col("n0") + F.col("n1")) / (n0 + n1)
    gap = F.abs(share1 - share0) / F.sqrt(both * (1 - both) * F.lit(1 / n0 + 1 / n1) + F.lit(1e-9))
    top = (
        counts(rows, sizes, bits)
        .withColumn("gap", gap)
        .filter(F.col("gap") >= clear)
        .orderBy(F.desc("gap"), "bucket")
        .limit(features)
        .toPandas()
    )
    buckets = top["bucket"].to_numpy()
    ratio = np.log((top["n1"] + smooth) / (n1 + 2 * smooth)) - np.log((top["n0"] + smooth) / (n0 + 2 * smooth))
    order = np.argsort(buckets)
    buckets, ratio = buckets[order], ratio.to_numpy()[order]
    model = Model(sizes, bits, buckets, np.ones(len(buckets)), 0.0)

    def run(stream):
        known = model.table() != 0
        for batch in stream:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(0)):
                row, bucket = model.present(data, offsets, known)
                at = np.searchsorted(model.buckets, bucket).astype(np.int32)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi]), found], names=["label", "at"])

    got = rows.mapInArrow(run, "label int, at array<int>").toPandas()
    x = np.zeros((len(got), len(buckets)), np.float32)
    x[np.repeat(np.arange(len(got)), got["at"].map(len)), np.concatenate([*got["at"], np.zeros(0, np.int32)]).astype(np.int64)] = 1
    w, b = logistic(x * ratio.astype(np.float32), got["label"].to_numpy(), penalty)
    return Model(sizes, bits, buckets, w * ratio, b)


def score(df: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``df`` with the probability of label 1; an existing column of that name is replaced."""
    rest = [c for c in df.columns if c != to]
    cols, fields = carried(df, rest)
    schema = T.StructType([*fields, T.StructField(to, T.DoubleType())])

    def run(stream):
        weights = model.table()
        known = weights != 0
        for batch in stream:
            z = np.full(batch.num_rows, model.intercept)
            for lo, hi, data, offsets in slices(batch.column(0)):
                row, bucket = model.present(data, offsets, known)
                z[lo:hi] += np.bincount(row, weights[bucket], hi - lo)
            got = pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], got], names=schema.names)

    return df.select(df[text].alias("_text_"), *cols).mapInArrow(run, schema).toDF(*rest, to)
