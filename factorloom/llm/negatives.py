"""Hard negatives of anchor vectors by exact inner products, with length buckets and coordinate pruning.

Rows are sorted by length once, in range partitions, so a batch of rows is a
length bucket. A task walks its buckets from the longest on and keeps, for every
anchor of a wave, the best rows so far; their last score is the anchor's bound:

* a bucket whose longest vector can't reach the bound is skipped (length),
* each bucket holds its unit coordinates as sorted lists. With q the anchor's unit
  coordinate and t the bound over both lengths, only unit coordinates between
  cos(acos q + acos t) and cos(acos q - acos t) can reach it: the slices that these
  ranges cut from the lists of the anchor's largest (focus) coordinates are
  intersected, and only rows in all of them are candidates,
* candidates are verified by exact integer products.

Anchors go to the tasks in waves of at most ``WAVE`` vectors, so what is sent is
bounded; every wave meets every row, and a task returns its best rows only.

Rows with a null label or vector, or a component that is null or not finite,
take no part. A row with a null id is no anchor and comes last among equal scores
(the id 2**63 - 1 stands for it). Repeated rows are rows of their own: each is an
anchor, and the others of them are its candidates. A shorter vector counts as
padded with zeros. Scores beyond +-9e16 count as that. Other columns are ignored;
an empty table, and one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import shared_folder, written

WAVE = 8192  # anchors sent to the tasks at once
FOCUS = 3  # coordinates whose ranges are intersected
SPARSE = 4  # candidate sets under 1/SPARSE of a bucket are gathered, larger ones verified with the whole bucket
AT_ONCE = 64  # anchors of one matrix product
NO_ID = np.iinfo(np.int64).max
LIMIT = 9 * 10**16
OUT = "anchor long, slot long, score long, id long, row long"


@dataclass(frozen=True)
class Rule:
    """How many positives and negatives, and the share of the positive's score that a negative's may have, in percent."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def prepared(rows: DataFrame, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, label, vector, length, row) of the rows that take part, longest first in range partitions."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    length = F.aggregate(F.col("vector"), F.lit(0.0), lambda s, x: s + x * x)
    got = (
        rows.select(
            F.coalesce(F.col(vec_id).cast("long"), F.lit(int(NO_ID))).alias("id"),
            (F.col("label") if label is None else label).cast("long").alias("label"),
            F.when(finite, F.col(vector).cast("array<double>")).alias("vector"),
        )
        .filter(F.col("label").isNotNull() & F.col("vector").isNotNull())
        .withColumn("length", length)
    )
    order = [F.desc("length"), "id"]
    got = got.repartitionByRange(*order).sortWithinPartitions(*order, "label", "vector")
    return written(got.withColumn("row", F.monotonically_increasing_id()), "vectors-by-length")


def matrix(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """Scaled and floored components, one row for each vector, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.floor(np.clip(scale * np.asarray(column.flatten(), np.float64), -1e300, 1e300))
    out = np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    norm = lambda m: float(np.sqrt((m * m).sum(1).max(initial=0.0)))
    with np.errstate(over="ignore"):
        small = norm(a) * norm(b) < 2.0**52
    if small:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(x) for x in r] for r in m]
    rows_b = whole(b)
    got = [[max(-LIMIT, min(LIMIT, sum(x * y for x, y in zip(r, s, strict=True)))) for s in rows_b] for r in whole(a)]
    return np.array(got, np.int64).reshape(len(a), len(b))


class Bucket:
    """Rows of similar length: unit coordinates, and for each coordinate asked for its sorted list."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        lengths = np.sqrt((vectors * vectors).sum(1))
        self.longest = float(lengths.max(initial=0.0))
        self.unit = vectors / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def feasible(self, anchors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor whether the bucket can reach its bound, its focus coordinates, and their slices of the sorted lists."""
        lengths = np.sqrt((anchors * anchors).sum(1))
        reach = lengths * self.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach > 0, bounds / reach, np.where(bounds > 0, 2.0, 0.0))
        unit = anchors / np.where(lengths > 0, lengths, 1.0)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : min(FOCUS, unit.shape[1])]
        q = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
        angle = np.arccos(np.clip(t, 0, 1))[:, None]
        lower, upper = np.cos(np.minimum(q + angle, np.pi)) - 1e-9, np.cos(np.maximum(q - angle, 0)) + 1e-9
        lower[t <= 0], upper[t <= 0] = -2, 2  # rows without length or at an obtuse angle can reach it as well
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            _, values = self.sorted_list(int(f))
            first[at], last[at] = np.searchsorted(values, lower[at], "left"), np.searchsorted(values, upper[at], "right")
        return t <= 1 + 1e-9, focus, first, last

    def scored(self, anchors: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, rows, scores) of the candidates: a grid for those with large sets, a list of rows for each other anchor."""
        can, focus, first, last = self.feasible(anchors, bounds)
        n = len(self.vectors)
        few = can & ((last - first).min(1, initial=n) * SPARSE < n)
        for lo in range(0, len(anchors), AT_ONCE):
            some = lo + np.flatnonzero((can & ~few)[lo : lo + AT_ONCE])
            if len(some):
                yield some, np.arange(n), products(anchors[some], self.vectors)
        for i in np.flatnonzero(few):
            seen = np.zeros(n, np.int8)
            for f, a, b in zip(focus[i], first[i], last[i], strict=True):
                seen[self.sorted_list(int(f))[0][a:b]] += 1
            rows = np.flatnonzero(seen == focus.shape[1])
            if len(rows):
                yield np.array([i]), rows, products(anchors[[i]], self.vectors[rows])


class Best:
    """The first rows of every slot, by score and then id, and the score of the last where the slot is full."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.found = np.zeros((3, slots, size), np.int64)  # score, id, row
        self.found[0] = -LIMIT - 1  # no row yet

    @property
    def bounds(self) -> np.ndarray:
        return np.maximum(self.found[0, :, -1], -LIMIT)

    def add(self, slot, score, ids, rows) -> None:
        touched, new = np.unique(slot, return_inverse=True)
        old = self.found[:, touched].reshape(3, -1)
        there = old[0] >= -LIMIT
        at = np.concatenate([np.repeat(np.arange(len(touched)), self.size)[there], new])
        got = np.concatenate([old[:, there], np.stack([score, ids, rows])], axis=1)
        order = np.lexsort((got[2], got[1], -got[0], at))
        at, got = at[order], got[:, order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        keep = place < self.size
        self.found[:, touched[at[keep]], place[keep]] = got[:, keep]

    def rows(self) -> list[np.ndarray]:
        slot, place = np.nonzero(self.found[0] >= -LIMIT)
        return [slot, *self.found[:, slot, place]]


@dataclass(frozen=True)
class Wave:
    """Anchors of one wave: scaled vectors, rows and labels; for negatives the score range of every slot."""

    vectors: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    least: np.ndarray | None = None  # anchors x positives
    most: np.ndarray | None = None


def buckets(stream, scale: int, width: int) -> Iterator[tuple[Bucket, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in stream:
        if batch.num_rows:
            ids, labels, rows = (np.asarray(batch.column(c)) for c in (0, 1, 3))
            yield Bucket(matrix(batch.column(2), scale, width)), ids, labels, rows


def best_rows(rows: DataFrame, wave: Wave, size: int, scale: int) -> DataFrame:
    """The first ``size`` rows of each slot. Without ranges: rows of the anchor's label; with them: of other labels and in range."""
    sent = rows.sparkSession.sparkContext.broadcast(wave)
    slots = 1 if wave.least is None else wave.least.shape[1]

    def run(stream):
        w = sent.value
        best = Best(len(w.rows) * slots, size)
        for bucket, ids, labels, at in buckets(stream, scale, w.vectors.shape[1]):
            anchors = widened(w.vectors, bucket.vectors.shape[1])
            floor = best.bounds.reshape(-1, slots)
            if w.least is not None:
                floor = np.maximum(floor, w.least)
            for some, cols, scores in bucket.scored(anchors, floor.min(1).astype(float)):
                same = w.labels[some][:, None] == labels[cols][None, :]
                fits = (same if w.least is None else ~same) & (w.rows[some][:, None] != at[cols][None, :])
                for j in range(slots):
                    floor = best.bounds.reshape(-1, slots)[some, j]
                    ok = fits & (scores >= floor[:, None])
                    if w.least is not None:
                        ok &= (scores >= w.least[some, j][:, None]) & (scores <= w.most[some, j][:, None])
                    i, k = np.nonzero(ok)
                    if len(i):
                        best.add(some[i] * slots + j, scores[i, k], ids[cols][k], at[cols][k])
        slot, score, ids, at = best.rows()
        names = ["anchor", "slot", "score", "id", "row"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (w.rows[slot // slots], slot % slots, score, ids, at)], names=names)

    got = rows.select("id", "label", "vector", "row").mapInArrow(run, OUT)
    place = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return got.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= size)


def mine(rows: DataFrame, rule: Rule = Rule(), every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of ``prepared``; anchors have ids divisible by ``every``."""
    spark = rows.sparkSession
    anchors = rows.filter((F.col("id") % every == 0) & (F.col("id") != int(NO_ID)))
    anchors = written(anchors.select("id", "label", "vector", "row", F.pmod(F.xxhash64("row"), F.lit(1 << 20)).alias("dealt")), "anchors")
    waves = -(-anchors.count() * 5 // (4 * WAVE))  # dealt by hash, so planned a fifth under the bound
    to = shared_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(to)
    for n in range(waves):
        got = anchors.filter(F.col("dealt") % waves == n).toArrow().sort_by("row")
        ids, at, labels = (np.asarray(got.column(c).combine_chunks(), np.int64) for c in ("id", "row", "label"))
        wave = Wave(matrix(got.column("vector"), rule.scale), at, labels)
        firsts = written(best_rows(rows, wave, rule.positives, rule.scale), "positives").drop("slot")
        pos = firsts.toPandas()
        # no score lies in the empty range of an absent positive
        least, most = np.full((len(at), rule.positives), LIMIT, np.int64), np.full((len(at), rule.positives), -LIMIT, np.int64)
        i, j, p = np.searchsorted(at, pos["anchor"].to_numpy(np.int64)), pos["place"].to_numpy(np.int64) - 1, pos["score"].to_numpy(np.int64)
        least[i, j], most[i, j] = -(-rule.low * p // 100), rule.high * p // 100
        worst = best_rows(rows, Wave(wave.vectors, at, labels, least, most), rule.negatives, rule.scale)
        names = spark.createDataFrame(pd.DataFrame({"anchor": at, "anchor_id": ids}), "anchor long, anchor_id long")
        known = firsts.select("anchor", (F.col("place") - 1).cast("long").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        shown = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
        out = worst.join(F.broadcast(known), ["anchor", "slot"]).join(F.broadcast(names), "anchor")
        out.select(
            "anchor_id",
            shown("positive").alias("positive_id"),
            F.col("place").alias("rank"),
            shown("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(to)
    return spark.read.schema(schema).parquet(to)
