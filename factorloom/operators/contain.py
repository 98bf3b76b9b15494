"""Which strings of two tables contain one another, by a join on n-grams.

A string can only stand inside those that hold all its n-grams, so it is looked up by the
one that the fewest strings of the other table hold; what meets there is then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 3


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n))))


def inside(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
    """(s, t): each distinct string of ``short.s`` with the distinct strings of ``long.t`` that hold it, equal ones included.

    Strings under three characters are looked up whole, the empty one stands in every string. NULL matches nothing.
    """
    asked = short.select(F.col(s).alias("_s")).distinct().filter("_s IS NOT NULL")
    texts = long.select(F.col(t).alias("_t")).distinct().filter("_t IS NOT NULL")
    all_of = F.concat(F.array(F.lit("")), *[F.coalesce(_grams(F.col("_t"), n), F.array().cast("array<string>")) for n in range(1, SIZE + 1)])
    postings = texts.select("_t", F.explode(all_of).alias("_g"))
    keys = F.when(F.length("_s") >= SIZE, _grams(F.col("_s"), SIZE)).otherwise(F.array("_s"))
    keys = asked.select("_s", F.explode(keys).alias("_g"))
    often = postings.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rarest = Window.partitionBy("_s").orderBy(F.coalesce("_n", F.lit(0)), "_g")  # a string's own n-grams
    best = keys.join(often, "_g", "left").withColumn("_p", F.row_number().over(rarest)).filter("_p = 1").select("_s", "_g")
    return best.join(postings, "_g").filter(F.contains("_t", "_s")).select(F.col("_s").alias(s), F.col("_t").alias(t))


def either_way(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y): distinct strings of ``a.x`` and ``b.y`` of which one holds the other."""
    return inside(a, b, x, y).unionByName(inside(b, a, y, x).select(x, y)).distinct()
