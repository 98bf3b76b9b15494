"""Ranks and rank IC of many columns of a date at once.

A window sorts the whole rows of its date once for every column it ranks. Here rows are
grouped by date one time and the columns are ranked one after the other in numpy, so the
cost of a column is that of sorting its own values. For groups that fit a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import STEP

MANY = 4  # from so many ranks on, one grouped pass is cheaper than a sort for each
BLOCK = 16  # factor columns of a date that are scored in one group


def held(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles and which of them are no NULL; a NaN is a value, as in a window."""
    return column.to_numpy().astype(float), column.is_valid().to_numpy()


def steadied(v: np.ndarray) -> np.ndarray:
    """``scalar.steady`` of an array."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = v * STEP
        return np.where(np.abs(v) < 1e300, far - (far - v), v)


def ranks_in_order(s: np.ndarray) -> np.ndarray:
    """Average ranks of sorted values; NaN equals NaN."""
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(s)))
    return np.repeat(starts + (counts + 1) / 2.0, counts)


def average_ranks(v: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Average ranks of values, from 1."""
    order = np.argsort(v) if order is None else order
    out = np.empty(len(v))
    out[order] = ranks_in_order(v[order])
    return out


def rank_columns(df: DataFrame, xs: Mapping[str, str]) -> DataFrame:
    """Add ``out`` for every (out, x): the average rank of ``x`` on its date over the number of values. The columns ``x`` drop out."""
    rest = [f for f in df.schema.fields if f.name not in set(xs.values())]

    def ranked(rows: pa.Table) -> pa.Table:
        cols = {f.name: rows.column(f.name) for f in rest}
        for out, x in xs.items():
            v, valid = held(rows.column(x))
            made = np.zeros(len(v))
            made[valid] = average_ranks(steadied(v[valid])) / max(valid.sum(), 1)
            cols[out] = pa.array(made, mask=~valid)
        return pa.table(cols)

    schema = T.StructType([*rest, *[T.StructField(out, T.DoubleType()) for out in xs]])
    return df.groupBy("date").applyInArrow(ranked, schema)


def rank_ic(x: np.ndarray, y: np.ndarray, order: np.ndarray) -> float | None:
    """Rank correlation of complete pairs, ``order`` sorts ``y``; None if a side is constant.

    Ranks less their mean are multiples of a half, so sums are exact up to some 200,000 pairs.
    """
    middle = (len(x) + 1) / 2.0
    a, b = average_ranks(x) - middle, average_ranks(y, order) - middle
    spread = float(a @ a) * float(b @ b)
    return float(a @ b) / spread**0.5 if spread > 0 else None


def pair_score(x: np.ndarray, valid: np.ndarray, y: np.ndarray, has: np.ndarray, order: np.ndarray) -> tuple[int, float | None, int, int]:
    """(n, rank_ic, n_rows, n_values) of a column against a steadied label; ``order`` sorts the label."""
    pair = valid & has
    place = np.cumsum(pair) - 1  # of a row among the pairs
    n = int(pair.sum())
    return n, rank_ic(steadied(x[pair]), y[pair], place[order[pair[order]]]) if n else None, len(x), int(valid.sum())


def above(a: np.ndarray, b: float) -> np.ndarray:
    """``a > b`` as Spark has it: NaN is the largest value and equals itself."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def percentile(s: np.ndarray, p: float) -> float:
    """``F.percentile`` of sorted values."""
    place = (len(s) - 1) * p
    low, high = int(np.floor(place)), int(np.ceil(place))
    if s[low] == s[high] or low == high:
        return float(s[low])
    return float((high - place) * s[low] + (place - low) * s[high])


def n_distinct(v: np.ndarray) -> int:
    return len(np.unique(v))


def top_columns(df: DataFrame, factors: Sequence[str], share: float, keep: Sequence[str] = (), label: str | None = None, distinct: int = 0) -> DataFrame:
    """(factor_id, date, asset, keep...) of the top ``share`` of names of each factor column and date, at least one, ties by asset.

    With ``label`` only rows that have one take part; with ``distinct`` only dates (not NULL) of so many distinct values.
    """
    df = df.filter("date IS NOT NULL") if distinct else df
    rest = ["date", "asset", *keep]

    def tops(rows: pa.Table) -> pa.Table:
        names = pc.rank(rows.column("asset"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        has = held(rows.column("_label"))[1]
        parts = []
        for j, f in enumerate(factors):
            v, valid = held(rows.column(f"_x{j}"))
            at = np.flatnonzero(valid & has)
            if not len(at) or (distinct and n_distinct(v[at]) < distinct):
                continue
            x = steadied(v[at])
            order = np.lexsort((names[at], np.where(np.isnan(x), 0.0, -x), ~np.isnan(x)))
            best = at[order[: max(1, int(np.floor(len(at) * share)))]]
            taken = rows.select(rest).take(pa.array(best))
            parts.append(taken.add_column(0, "factor_id", pa.array([f] * len(best), pa.string())))
        none = rows.select(rest).slice(0, 0).add_column(0, "factor_id", pa.array([], pa.string()))
        return pa.concat_tables(parts or [none])

    has = F.col(label) if label is not None else F.lit(0.0)
    values = [F.col(f"`{f}`").cast("double").alias(f"_x{j}") for j, f in enumerate(factors)]
    kinds = [T.StructField("factor_id", T.StringType()), *[df.schema[c] for c in rest]]
    return df.select(*rest, has.cast("double").alias("_label"), *values).groupBy("date").applyInArrow(tops, T.StructType(kinds))


def bucket_columns(df: DataFrame, factors: Sequence[str], n: int, label: str) -> DataFrame:
    """(factor_id, date, bucket, bucket_return): mean label by bucket of each factor column, on dates (not NULL) of ``n`` distinct values or more."""

    def means(rows: pa.Table) -> pa.Table:
        y, has = held(rows.column("_y"))
        ids, buckets, got = [], [], []
        for j, f in enumerate(factors):
            v, valid = held(rows.column(f"_x{j}"))
            pair = valid & has
            x, r = v[pair], y[pair]
            if n_distinct(x) < n:
                continue
            s = np.sort(x)
            edges = [percentile(s, i / n) for i in range(n)]
            bucket = np.ones(len(x), dtype=int)
            for before, e in zip(edges, edges[1:]):
                if above(np.array(e), before):
                    bucket += above(x, e)
            for b in np.unique(bucket):
                ids.append(f)
                buckets.append(b)
                got.append(r[bucket == b].mean())
        return pa.table(
            {
                "factor_id": pa.array(ids, pa.string()),
                "date": rows.column("date").take(pa.array([0] * len(ids), pa.int64())),
                "bucket": pa.array(buckets, pa.int32()),
                "bucket_return": pa.array(got, pa.float64()),
            }
        )

    values = [F.col(f"`{f}`").cast("double").alias(f"_x{j}") for j, f in enumerate(factors)]
    kinds = {"factor_id": T.StringType(), "date": df.schema["date"].dataType, "bucket": T.IntegerType(), "bucket_return": T.DoubleType()}
    narrow = df.filter("date IS NOT NULL").select("date", F.col(label).cast("double").alias("_y"), *values)
    return narrow.groupBy("date").applyInArrow(means, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))


def score_columns(df: DataFrame, factors: Sequence[str], label: Column) -> DataFrame:
    """(factor_id, date, n, rank_ic, n_rows, n_values) of factor columns: rank IC of the complete pairs of each date.

    A row is dealt once for each block of columns, so neither rows for each factor nor a whole wide date are held at once.
    """
    blocks = [list(factors[i : i + BLOCK]) for i in range(0, len(factors), BLOCK)]

    def block(i: int) -> Column:
        values = [F.col(f"`{f}`").cast("double") for f in blocks[i]] + [F.lit(None).cast("double")] * (BLOCK - len(blocks[i]))
        return F.struct(F.lit(i).alias("_block"), *[v.alias(f"_x{j}") for j, v in enumerate(values)])

    def scored(rows: pa.Table) -> pa.Table:
        names = blocks[rows.column("_block")[0].as_py()]
        y, has = held(rows.column("_y"))
        y = steadied(y)
        order = np.argsort(y)
        made = [pair_score(*held(rows.column(f"_x{j}")), y, has, order) for j in range(len(names))]
        n, ic, n_rows, n_values = zip(*made)
        return pa.table(
            {
                "factor_id": pa.array(names, pa.string()),
                "date": rows.column("date").take(pa.array([0] * len(names))),
                "n": pa.array(n, pa.int64()),
                "rank_ic": pa.array(ic, pa.float64()),
                "n_rows": pa.array(n_rows, pa.int64()),
                "n_values": pa.array(n_values, pa.int64()),
            }
        )

    dealt = df.select("date", label.cast("double").alias("_y"), F.inline(F.array(*[block(i) for i in range(len(blocks))])))
    kinds = {"factor_id": T.StringType(), "date": df.schema["date"].dataType, "n": T.LongType(), "rank_ic": T.DoubleType()}
    kinds |= {"n_rows": T.LongType(), "n_values": T.LongType()}
    return dealt.groupBy("date", "_block").applyInArrow(scored, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))
