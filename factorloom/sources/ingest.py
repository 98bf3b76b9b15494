"""Reading, normalising and merging market tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import number
from ..functions.text import clean_text, compact_date, known_industry, zero_pad
from ..operators.ordered import beside
from ..operators.ts import series

# The columns of the target dataset.
TARGET = (
    "date asset open high low close volume amount turnover market_cap float_market_cap pb pe total_share float_share industry"
).split()
TARGET_SCHEMA = T.StructType(
    [
        T.StructField(c, T.DateType() if c == "date" else T.StringType() if c in ("asset", "industry") else T.DoubleType())
        for c in TARGET
    ]
)


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """CSV (all text, coerced later) or a typed columnar file."""
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)


def coerce(x) -> Column:
    """Text or number to double; unreadable and NaN become NULL."""
    return number(F.expr(f"try_cast(`{x}` AS double)"))


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def dedup_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    An aggregate with map-side combine, so a key with very many copies never meets in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def _first_usable(df: DataFrame, keys: Sequence[str], needed: Sequence[str], rest: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The first complete row of each key by arrival; without an arrival column, by its values."""
    return dedup_keep(df.dropna(subset=[*keys, *needed]), keys, [*arrival, *rest]).drop(*arrival)


def clean_price_series(df: DataFrame, arrival: Sequence[str] = ()) -> DataFrame:
    """One asset's OHLCV: coerce, one complete row per date, the first by ``arrival`` (file and row number, say)."""
    cols = ["open", "high", "low", "close", "volume"]
    require(df, ["date", *cols])
    d = df.select(compact_date("date").alias("date"), *[coerce(c).alias(c) for c in cols], *arrival)
    return _first_usable(d, ["date"], cols, cols, arrival)


def clean_panel(df: DataFrame, arrival: Sequence[str] = ()) -> DataFrame:
    """A raw panel: asset from its code, numbers coerced, industry and cap defaulted, one complete row per key."""
    if "asset" not in df.columns:
        require(df, ["ts_code"])
        df = df.withColumn("asset", F.substring_index("ts_code", ".", 1))
    require(df, ["date", "asset", "close", "volume"])
    text = {"date", "asset", "industry", "ts_code", *arrival}
    d = df.withColumns({c: coerce(c) for c in df.columns if c not in text})
    d = d.withColumns({"date": compact_date("date"), "asset": zero_pad("asset")})
    industry = F.coalesce(known_industry("industry"), F.lit("unknown")) if "industry" in d.columns else F.lit("unknown")
    size = F.col("close") * F.col("volume")
    d = d.withColumns(
        {"industry": industry, "market_cap": F.coalesce("market_cap", size) if "market_cap" in d.columns else size}
    )
    order = [c for c in d.columns if c not in ("date", "asset", *arrival)]
    return _first_usable(d, ["date", "asset"], ["close", "volume"], order, arrival)


def summarize_panel(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("asset").alias("assets"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.max_by("close", F.struct("date", "asset")).alias("latest_close"),
    )


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("date", "asset"), newest_wins: bool = True) -> DataFrame:
    """Union by name with one row per key; the new rows win (or, extending backwards, lose)."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_src"]
    order = ["_src", *[c for c in rest if not dict(both.dtypes)[c].startswith("map")]]
    return dedup_keep(both, keys, order, last=newest_wins).drop("_src")


def new_rows_only(df: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows after the last loaded date (all rows when nothing is loaded)."""
    last = loaded.agg(F.max("date").alias("_last"))
    d = beside(df, last)
    return d.filter(F.col("_last").isNull() | (F.col("date") > F.col("_last"))).drop("_last")


def normalize_vendor(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename vendor columns, pad codes, parse dates, coerce numbers, one complete row per key."""
    return clean_panel(df.withColumnsRenamed(dict(names)))


def normalize_units(daily: DataFrame, industries: DataFrame) -> DataFrame:
    """Vendor daily bars: compact date, lots and thousands to units, industry attached, cap left empty."""
    d = daily.withColumns(
        {
            "asset": F.substring_index("ts_code", ".", 1),
            "date": compact_date("trade_date"),
            "volume": F.col("vol") * 100,
            "amount": F.col("amount") * 1000,
            "market_cap": F.lit(None).cast("double"),
        }
    ).drop("ts_code", "trade_date", "vol")
    return attach_industry(d, industries).dropna(subset=["close", "volume"])


def attach_industry(df: DataFrame, industries: DataFrame) -> DataFrame:
    """Left join (asset, industry); unmatched is unknown.  The join strategy is left to the size statistics."""
    d = df.drop("industry").join(industries.select("asset", "industry"), "asset", "left")
    return d.withColumn("industry", F.coalesce(known_industry("industry"), F.lit("unknown")))


def merge_metadata(primary: DataFrame, fallback: DataFrame, texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Full join of two metadata tables on asset; empty or unknown primary values fall back."""
    a, b = primary.alias("a"), fallback.alias("b")
    j = a.join(b, F.col("a.asset") == F.col("b.asset"), "full")

    def pick(c: str) -> Column:
        clean = known_industry if c == "industry" else clean_text
        best = F.coalesce(clean(F.col(f"a.{c}")), clean(F.col(f"b.{c}")))
        return (F.coalesce(best, F.lit("unknown")) if c == "industry" else best).alias(c)

    nums = [F.coalesce(number(F.col(f"a.{c}")), number(F.col(f"b.{c}"))).alias(c) for c in numbers]
    return j.select(F.coalesce("a.asset", "b.asset").alias("asset"), *[pick(c) for c in texts], *nums)


def fill_secondary(meta: DataFrame, names: DataFrame, industries: DataFrame) -> DataFrame:
    """Fill empty names and unknown industries from secondary maps; flags tell what was filled."""
    d = meta.join(names.select("asset", F.col("asset_name").alias("_n")), "asset", "left").join(
        industries.select("asset", F.col("industry").alias("_i")), "asset", "left"
    )
    name, industry = clean_text("asset_name"), known_industry("industry")
    return d.withColumns(
        {
            "name_filled": name.isNull() & clean_text("_n").isNotNull(),
            "industry_filled": industry.isNull() & known_industry("_i").isNotNull(),
            "asset_name": F.coalesce(name, clean_text("_n"), F.lit("")),
            "industry": F.coalesce(industry, known_industry("_i"), F.lit("unknown")),
        }
    ).drop("_n", "_i")


def attach_caps(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """market_cap = close x total shares, else the static cap, else close x volume; float cap from the first two."""
    side = meta.select(
        "asset",
        F.col("total_share").alias("_ts"),
        F.col("float_share").alias("_fs"),
        F.col("market_cap").alias("_mc"),
        F.col("float_market_cap").alias("_fm"),
    )
    d = panel.join(side, "asset", "left")
    cap = F.coalesce(F.when(F.col("_ts") > 0, F.col("close") * F.col("_ts")), F.col("_mc"), F.col("close") * F.col("volume"))
    free = F.coalesce(F.when(F.col("_fs") > 0, F.col("close") * F.col("_fs")), F.col("_fm"))
    return d.withColumns({"market_cap": cap, "float_market_cap": free}).drop("_ts", "_fs", "_mc", "_fm")


def attach_adj_factor(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """Left join adjustment factors on (asset, date); 1.0 where the asset has none at all."""
    covered = factors.select("asset").distinct().withColumn("_has", F.lit(True))
    d = panel.join(factors.select("asset", "date", "adj_factor"), ["asset", "date"], "left").join(covered, "asset", "left")
    return d.withColumn("adj_factor", F.when(F.col("_has").isNull(), F.lit(1.0)).otherwise(F.col("adj_factor"))).drop("_has")


def asof_join(panel: DataFrame, reports: DataFrame, value: str, backfill: bool = True) -> DataFrame:
    """The latest report at or before each row's date, then filled backwards.

    Rows and reports are stacked and scanned once per asset in date order; a report comes
    before a row of the same date.  Reports are first reduced to one per date (the largest
    value), so an asset's series is never longer than twice the calendar.
    """
    rows = panel.withColumns({"_s": F.lit(1), "_v": F.lit(None).cast("double")})
    one = reports.groupBy("asset", "date").agg(F.max(F.col(value).cast("double")).alias("_v"))
    marks = one.withColumn("_s", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("asset").orderBy("date", "_s")
    past = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = both.withColumn("_p", past).filter(F.col("_s") == 1)
    if backfill:
        ahead = series().rowsBetween(0, Window.unboundedFollowing)
        d = d.withColumn("_p", F.coalesce("_p", F.first("_p", ignorenulls=True).over(ahead)))
    return d.withColumn(value, F.col("_p")).drop("_s", "_v", "_p")


def merge_fill(panel: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Exact left join on (date, asset), filled forwards then backwards."""
    one = values.groupBy("date", "asset").agg(F.min(value).alias(value))
    d = panel.drop(value).join(one, ["date", "asset"], "left")
    back = F.last(value, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn(value, back)
    ahead = F.first(value, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
    return d.withColumn(value, ahead)


def ttm_earnings(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """(asset, date, pe): cumulative profit to quarters, four-report sum, as-of cap over it where positive.

    Reports are one row per (asset, report date) with column ``cum``.
    """
    w = series()
    q = reports.withColumn("q", F.coalesce(F.col("cum") - F.lag("cum").over(w), F.col("cum")))
    q = q.withColumn("ttm", F.sum("q").over(w.rowsBetween(-3, 0)))
    enough = Window.partitionBy("asset")
    q = q.withColumn("_k", F.count(F.lit(1)).over(enough)).filter((F.col("_k") >= 2) & (F.col("ttm") > 0))
    caps = panel.select("asset", "date", F.col("market_cap").alias("cap"))
    priced = asof_join(q.select("asset", "date", "ttm"), caps, "cap", backfill=False)
    return priced.filter(F.col("cap") > 0).select("asset", "date", (F.col("cap") / F.col("ttm")).alias("pe"))


def add_missing_columns(df: DataFrame, schema: T.StructType = TARGET_SCHEMA) -> DataFrame:
    """Project to a fixed schema; absent columns are NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


# The stand-in industries of a single series.
PROXY_INDUSTRIES = ["bank", "tech", "consumer", "industry", "energy", "healthcare"]


def expand_to_panel(prices: DataFrame) -> DataFrame:
    """Six scaled copies of one price series; one generator, no join.  The series is as long as its calendar."""
    i = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1
    d = prices.withColumn("_t", i.cast("double"))
    d = d.select("*", F.posexplode(F.array(*[F.lit(x) for x in PROXY_INDUSTRIES])).alias("_k", "industry"))
    k, t = F.col("_k"), F.col("_t")
    close = F.col("close") * (1 + k * 0.035) * (1 + 0.025 * F.sin(t / (5 + k))) * (1 + (k - 2) * 0.00045 * t)
    volume = F.greatest(F.col("volume") * (1 + k * 0.18) * (1 + 0.12 * F.cos(t / (4 + k))), F.lit(1.0))
    d = d.withColumns({"asset": F.concat(F.lit("proxy_"), F.lpad((k + 1).cast("string"), 2, "0")), "close": close, "volume": volume})
    return d.withColumn("market_cap", F.col("close") * F.col("volume") * (800 + k * 120)).select(
        "date", "asset", "close", "volume", "industry", "market_cap"
    )


def resume_assets(wanted: DataFrame, loaded: DataFrame, start, end, failed: DataFrame | None = None) -> DataFrame:
    """Assets still to load: wanted without a row in the range; formerly failed ones first."""
    span = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    todo = wanted.join(loaded.filter(span).select("asset").distinct(), "asset", "left_anti")
    if failed is None:
        return todo.withColumn("priority", F.lit(1))
    flags = failed.select("asset").distinct().withColumn("_f", F.lit(1))
    return todo.join(flags, "asset", "left").withColumn("priority", F.when(F.col("_f") == 1, 0).otherwise(1)).drop("_f")


def export_panel(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a panel; Parquet is laid out by month so later scans prune."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def export_results(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write a result's tables (metrics, equity curve, trades, signals) side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
