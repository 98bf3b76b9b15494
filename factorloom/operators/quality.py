"""Data quality reports and the survivorship filter.

Reports are one or two aggregations over the table, never a collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bounded, holds
from .ordered import beside
from .ts import longest_run, pct_change

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def column_profile(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """(column, missing_rate, outliers): share of NULLs and values beyond 5 population sigmas."""
    numbers = numeric_columns(df)
    moments = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"s_{c}") for c in numbers]
    )
    d = beside(df, moments)

    def beyond(c: str) -> Column:
        if c not in numbers:
            return F.lit(0).cast("bigint")
        far = (F.col(f"s_{c}") > 0) & (F.abs(F.col(c) - F.col(f"m_{c}")) > sigmas * F.col(f"s_{c}"))
        return F.count_if(holds(far))

    one = d.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"r_{c}") for c in df.columns], *[beyond(c).alias(f"o_{c}") for c in df.columns]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"r_{c}").alias("missing_rate"), F.col(f"o_{c}").alias("outliers")) for c in df.columns]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one (on all columns, or on a key)."""
    counts = df.groupBy(*(keys or df.columns)).agg(F.count(F.lit(1)).alias("_c"))
    return counts.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame, today: Column, date: str = "date") -> DataFrame:
    """One row: rows, columns, mean missing rate, outliers, duplicates, staleness and score."""
    columns = column_profile(df).agg(
        F.avg("missing_rate").alias("avg_missing_rate"), F.sum("outliers").alias("total_outliers")
    )
    size = df.agg(F.count(F.lit(1)).alias("total_rows"), F.max(date).alias("_last"))
    one = size.withColumn("_one", F.lit(1))
    for side in (columns, duplicate_rows(df)):
        one = one.join(side.withColumn("_one", F.lit(1)), "_one")
    one = one.withColumns(
        {"total_columns": F.lit(len(df.columns)), "stale_days": F.greatest(F.lit(0), F.datediff(today, F.col("_last")))}
    )
    return one.withColumn("quality_score", quality_score()).drop("_one", "_last")


def quality_score() -> Column:
    """0.4 completeness + 0.3 freshness + 0.3 cleanliness; 0 without rows."""
    fresh = F.exp(-F.coalesce("stale_days", F.lit(365)) / 30.0)
    dirty = F.try_divide(F.col("total_outliers"), F.col("total_rows") * F.greatest("total_columns", F.lit(1)))
    score = (
        bounded(1.0 - F.col("avg_missing_rate"), 0, 1) * 0.4 + bounded(fresh, 0, 1) * 0.3 + bounded(1.0 - dirty, 0, 1) * 0.3
    )
    return F.when(F.col("total_rows") > 0, F.round(score, 4)).otherwise(0.0)


def coverage_report(df: DataFrame) -> DataFrame:
    """One row: rows, assets, date range, NULL share, known industry and cap shares of the assets."""
    gaps = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    one = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        (F.sum(gaps) / (F.count(F.lit(1)) * len(df.columns))).alias("nan_ratio"),
    )
    known = df.groupBy("asset").agg(
        F.max((F.coalesce("industry", F.lit("unknown")) != "unknown").cast("int")).alias("_i"),
        F.max(F.col("market_cap").isNotNull().cast("int")).alias("_c"),
    ).agg(F.count(F.lit(1)).alias("asset_count"), F.avg("_i").alias("industry_coverage"), F.avg("_c").alias("market_cap_coverage"))
    out = one.withColumn("_one", F.lit(1)).join(known.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out.withColumn("coverage", 1.0 - F.col("nan_ratio"))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, assets, dates, range, and the missing share of each column."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("asset").alias("assets"),
        F.count_distinct("date").alias("dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in df.columns],
    )


# -- universe -----------------------------------------------------------------------------------


def survivorship_filter(
    df: DataFrame, min_history_days: int = 60, lookahead_days: int = 20, min_assets: int = 30
) -> DataFrame:
    """Drop late listings, early delistings and thin dates; blank closes after extreme 5-row returns.

    The asset spans and date counts are small aggregates joined back by key.
    """
    ends = df.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    spans = df.groupBy("asset").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    mature = beside(spans, ends).filter(F.col("_first") < F.date_add("_lo", min_history_days))
    # The end of the data is that of all rows, late listings included.
    active = mature.filter(F.col("_last") > F.date_sub("_hi", lookahead_days)).select("asset")
    kept = df.join(active, "asset", "left_semi")
    dates = kept.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_assets).select("date")
    kept = kept.join(dates, "date", "left_semi").withColumn("_r", pct_change("close", 5))
    wild = holds((F.col("_r") < -0.5) | (F.col("_r") > 2.0))
    return kept.withColumn("close", F.when(~wild, F.col("close"))).drop("_r")


def survivorship_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.count_distinct("asset").alias(f"{name}_assets"),
            F.count_distinct("date").alias(f"{name}_dates"),
        ).withColumn("_one", F.lit(1))

    both = sizes(before, "original").join(sizes(after, "final"), "_one").drop("_one")
    return both.withColumn("retention_pct", F.col("final_rows") / F.greatest("original_rows", F.lit(1)) * 100)


# -- anomalies ----------------------------------------------------------------------------------


def sanity_checks(df: DataFrame, today: Column) -> DataFrame:
    """One row: NULL closes, assets with a zero-volume row, duplicate keys, future dates."""
    one = df.agg(
        F.count_if(F.col("close").isNull()).alias("nan_in_close"),
        F.count_distinct(F.when(F.col("volume") == 0, F.col("asset"))).alias("zero_volume"),
        F.count_if(F.col("date") > today).alias("future_dates"),
    ).withColumn("_one", F.lit(1))
    return one.join(duplicate_rows(df, ["date", "asset"]).withColumn("_one", F.lit(1)), "_one").drop("_one")


def price_gaps(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return df.withColumn("ratio", pct_change("close")).filter(F.abs("ratio") > limit).select("asset", "date", "ratio")


def corporate_actions(df: DataFrame) -> DataFrame:
    """Suspected splits (a 40 % fall on tripled volume) and dividends (a 1-10 % fall on normal volume)."""
    d = df.withColumns({"ratio": pct_change("close"), "_v": pct_change("volume")})
    split = (F.col("ratio") < -0.40) & (F.col("_v") > 2.0)
    dividend = (F.col("ratio") < -0.01) & (F.col("ratio") > -0.10) & (F.abs("_v") < 0.5)
    d = d.withColumn("action", F.when(holds(split), "split").when(holds(dividend), "dividend"))
    return d.filter(F.col("action").isNotNull()).select("asset", "date", "action", "ratio")


def suspensions(df: DataFrame, min_length: int = 5) -> DataFrame:
    """Runs of at least five consecutive rows without a close or volume."""
    return longest_run(df, F.col("close").isNull() | (F.col("volume") == 0), min_length)


def anomaly_summary(df: DataFrame, today: Column) -> DataFrame:
    """(kind, n) of every anomaly check, with the total."""
    sane = sanity_checks(df, today)
    kinds = ("nan_in_close", "zero_volume", "future_dates", "duplicate_rows")
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("bigint").alias("n")) for k in kinds])
    parts = sane.select(F.explode(rows).alias("r")).select("r.*")
    parts = parts.unionByName(corporate_actions(df).groupBy(F.col("action").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
    parts = parts.unionByName(price_gaps(df).agg(F.lit("price_gap").alias("kind"), F.count(F.lit(1)).alias("n")))
    parts = parts.unionByName(suspensions(df).agg(F.lit("suspended").alias("kind"), F.count_distinct("asset").alias("n")))
    return parts.unionByName(parts.agg(F.lit("total").alias("kind"), F.sum("n").alias("n")))
