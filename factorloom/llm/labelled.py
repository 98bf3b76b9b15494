"""Labelled rows to learn from: the rows that may be used, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, slices, words

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id's text divisible by five. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(labels: DataFrame, label: str, per_class: int | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` rows of each class, or of ``most`` rows, that aren't held out, chosen by a hash of the id.

    Rows without an id or a label are no labels; of repeated ids the larger label counts.
    """
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    if most is not None:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    pick = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return pick[0].unionByName(pick[1])


def with_text(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """Text and label of the sampled rows; the sample's bound makes it small enough to send to every task."""
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")


def one_of_each(rows: DataFrame, k: int = 5, rounds: int = 2) -> DataFrame:
    """Of labelled texts that are near copies, the one with the smallest id.

    Copies of one text would make its chance n-grams look like evidence. Near
    copies mostly agree in the smallest hash of their k-word shingles; texts of
    fewer words agree if they are the same words.
    """

    names = [*rows.columns, *(f"sign{i}" for i in range(rounds))]

    def run(stream):
        for batch in stream:
            for lo, hi, data, offsets in slices(batch.column(batch.schema.get_field_index("text"))):
                w = words(data, offsets)
                sign = np.full((rounds, hi - lo), np.iinfo(np.int64).max)
                whole = w.spans(w.first[:-1], w.first[1:]).view(np.int64)
                at, h = w.grams(k)
                for i in range(rounds):
                    np.minimum.at(sign[i], w.row[at], mix(h + np.uint64(i)).view(np.int64))
                    sign[i] = np.where(np.diff(w.first) < k, whole, sign[i])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, sign)], names=names)

    fields = [T.StructField(f"sign{i}", T.LongType()) for i in range(rounds)]
    got = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))
    for i in range(rounds):
        got = got.groupBy(f"sign{i}").agg(F.min_by(F.struct(*[c for c in got.columns if c != f"sign{i}"]), "doc_id").alias("x")).select(f"sign{i}", "x.*")
    return got.select(*rows.columns)
