"""Exact ranks over groups of any size, from range partitions and a table of their offsets.

Rows are dealt once by (keys, value, tie-break) in ranges, so a group lies in consecutive
pieces: its rows in one partition. Every piece is ranked by itself. A small table with one
row for each piece holds its count, its first and last value and how many rows equal them;
from it come the rows before each piece, the group's total, and, for the few values that
cross from one piece into the next, their total and where they begin. The dealt rows are
checkpointed once, so that every step, also one that runs again, sees the same ranges;
nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

PIECE = "_piece"


def same(left: Sequence[str], right: Sequence[str]):
    """NULL-safe equality of column lists."""
    cond = F.lit(True)
    for a, b in zip(left, right, strict=True):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "left", side_keys: Sequence[str] | None = None) -> DataFrame:
    """Join ``cols`` of ``side`` on NULL-safe keys."""
    names = [f"_key{i}" for i in range(len(keys))]
    right = side.select(*[F.col(k).alias(n) for k, n in zip(side_keys or keys, names, strict=True)], *cols)
    return df.join(right, same(keys, names), how).drop(*names)


def dealt(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in ranges of ``order``, with the number of their range."""
    return settle(rows.repartitionByRange(*order).withColumn(PIECE, F.spark_partition_id()))


def ranked_pieces(rows: DataFrame, keys: Sequence[str], v: str, tie: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their rank (``_r``), equal rows (``_e``) and row number (``_i``) in their piece; the pieces; the values that cross pieces.

    Pieces have ``_off`` rows of the group before them and ``_tot`` rows in the group;
    crossing values have ``_veq`` rows and ``_vlt`` smaller ones.
    """
    keys, tie = list(keys), list(tie)
    local = Window.partitionBy(*keys, PIECE)
    by_value = local.orderBy(v)
    ranked = dealt(rows, [*keys, v, *tie]).withColumns(
        {
            "_r": F.rank().over(by_value),
            "_e": F.count(F.lit(1)).over(by_value.rangeBetween(0, 0)),
            "_i": F.row_number().over(local.orderBy(v, *tie)),
        }
    )
    pieces = ranked.groupBy(*keys, PIECE).agg(
        F.count(F.lit(1)).alias("_c"),
        F.array_distinct(F.array(F.struct(F.min(v).alias("v"), F.min_by("_e", v).alias("e")), F.struct(F.max(v).alias("v"), F.max_by("_e", v).alias("e")))).alias("_ends"),
    )
    before = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns(
        {"_off": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_tot": F.sum("_c").over(Window.partitionBy(*keys))}
    )
    ends = pieces.select(*keys, PIECE, (F.col("_off") + F.col("_c")).alias("_end"), F.explode("_ends").alias("_x"))
    crossing = (
        ends.groupBy(*keys, F.col("_x.v").alias(v))
        .agg(F.sum("_x.e").alias("_veq"), F.count(F.lit(1)).alias("_pieces"), F.min_by(F.col("_end") - F.col("_x.e"), PIECE).alias("_vlt"))
        .filter("_pieces > 1")
        .drop("_pieces")
    )
    return ranked, pieces, crossing


def group_ranks(rows: DataFrame, keys: Sequence[str], v: str, tie: Sequence[str], out: str) -> DataFrame:
    """Add ``{out}_n``, ``{out}_lt``, ``{out}_eq`` and ``{out}_rn`` to rows whose ``v`` is no NULL."""
    ranked, pieces, crossing = ranked_pieces(rows, keys, v, tie)
    got = attach(ranked, pieces, [*keys, PIECE], ["_off", "_tot"])
    got = attach(got, crossing, [*keys, v], ["_veq", "_vlt"])
    return got.select(
        *rows.columns,
        F.col("_tot").alias(f"{out}_n"),
        F.coalesce("_vlt", F.col("_off") + F.col("_r") - 1).alias(f"{out}_lt"),
        F.coalesce("_veq", F.col("_e")).alias(f"{out}_eq"),
        (F.col("_off") + F.col("_i")).alias(f"{out}_rn"),
    )


def step_up(rows: DataFrame, keys: Sequence[str], v: str, tie: Sequence[str], value: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``_n`` (rows of the group), ``_k`` (place in the group by ``v`` and tie-break) and ``_least``: the minimum of ``value(k, n)`` over this and all later places.

    Every piece holds its own running minimum; that of the group's later pieces is carried back from one row for each piece.
    """
    keys = list(keys)
    ranked, pieces, _ = ranked_pieces(rows, keys, v, tie)
    got = attach(ranked, pieces, [*keys, PIECE], ["_off", "_tot"])
    got = got.select(*rows.columns, PIECE, F.col("_tot").alias("_n"), (F.col("_off") + F.col("_i")).alias("_k"))
    got = got.withColumn("_v", value(F.col("_k"), F.col("_n")))
    later = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(1, Window.unboundedFollowing)  # one row for each piece
    least = got.groupBy(*keys, PIECE).agg(F.min("_v").alias("_own")).withColumn("_later", F.min("_own").over(later))
    ahead = Window.partitionBy(*keys, PIECE).orderBy("_k").rowsBetween(0, Window.unboundedFollowing)
    got = attach(got, least, [*keys, PIECE], ["_later"])
    return got.withColumn("_least", F.least(F.min("_v").over(ahead), "_later")).drop("_v", "_later", PIECE)
