"""Market-style panels over the provided star schema and event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_FIELDS = {"pb", "premium_rate"}
INDUSTRY_FIELDS = {"industry"}
SHARE_FIELDS = {"market_cap", "float_market_cap", "total_share", "float_share", "circ_mv", "issuance_size"}


def cents(total: str):
    """A sum of two-decimal amounts, free of the summation order."""
    return rounded(total, 2)


def weekly_panel(spark: SparkSession, sf_dir: str, fields: Iterable[str] = ()) -> DataFrame:
    """Week x supplier panel from line items.

    ``fields`` names the columns wanted; joins and the share window only appear in the
    plan when a field needs them, the rest is column pruning.  Lines are aggregated to
    cells before any join except the part lookup, so a dominant supplier or week is
    combined on the map side.
    """
    want = set(fields)
    li = table(spark, sf_dir, "lineitem")
    if want & PART_FIELDS:
        li = li.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    else:
        li = li.withColumn("p_retailprice", F.lit(None).cast("double"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    weekday = F.weekday("l_shipdate")
    by_day = [
        F.sum(F.when(weekday == d, F.col(c))).alias(f"{c}_{d}") for d in range(7) for c in ("l_extendedprice", "l_quantity")
    ]
    cells = li.groupBy(
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_suppkey").alias("supp")
    ).agg(
        F.sum("l_extendedprice").alias("ext"),
        F.sum("l_quantity").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        F.sum("l_discount").alias("disc"),
        F.sum("p_retailprice").alias("retail"),
        *by_day,
    )
    # The opening price is the average price of the week's first trading day.
    first_day = [cents(f"l_extendedprice_{d}") / F.col(f"l_quantity_{d}") for d in range(7)]
    p = cells.select(
        "date",
        F.lpad(F.col("supp").cast("string"), 10, "0").alias("asset"),
        "supp",
        F.coalesce(*first_day).alias("open"),
        "high",
        "low",
        (cents("ext") / F.col("volume")).alias("close"),
        "volume",
        "trades",
        cents("ext").alias("amount"),
        (F.col("volume") / F.col("trades")).alias("turnover"),
        (cents("disc") / F.col("trades")).alias("disc"),
        (cents("retail") / F.col("trades")).alias("retail"),
    )
    if want & SHARE_FIELDS:
        whole = Window.partitionBy("asset")
        p = p.withColumn("total_share", F.sum("volume").over(whole))
        p = p.withColumn("float_share", F.col("total_share") * (1 - F.col("disc")))
        p = p.withColumn("market_cap", F.col("close") * F.col("total_share"))
        p = p.withColumn("float_market_cap", F.col("market_cap") * (1 - F.col("disc")))
    if want & INDUSTRY_FIELDS:
        dim = table(spark, sf_dir, "supplier").join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
        p = p.join(dim.select(F.col("s_suppkey").alias("supp"), F.col("n_name").alias("industry")), "supp", "left")
        p = p.withColumn("industry", F.coalesce("industry", F.lit("unknown")))
    made = {
        "vwap": F.col("close"),
        "pb": F.col("close") / F.col("retail"),
        "turnover_rate": F.col("turnover"),
        "basis": (F.col("open") - F.col("close")) / F.col("open"),
        "term_structure": F.col("high") / F.col("low") - 1,
        "open_interest": F.col("volume") * 2 + F.col("turnover"),
        "near_price": F.col("high"),
        "far_price": F.col("low"),
        "spot": F.col("open"),
        "future": F.col("close"),
        "delta": F.col("disc"),
        "bond_floor": F.col("low"),
        "underlying_price": F.col("open"),
    }
    if want & {"pe", "pe_ttm"}:
        made["pe"] = made["pe_ttm"] = F.col("amount") / F.col("trades")
    if want & SHARE_FIELDS:
        made["circ_mv"] = F.col("float_market_cap")
        made["issuance_size"] = F.col("market_cap")
    if want & PART_FIELDS:
        made["premium_rate"] = F.col("close") / F.col("retail") - 1
    core = ["open", "high", "low", "close", "volume", "amount", "turnover"]
    cols = core + sorted(want - set(core))
    return p.withColumns({k: v for k, v in made.items() if k in want}).select("date", "asset", *cols)


ALL_FIELDS = sorted(
    PART_FIELDS
    | INDUSTRY_FIELDS
    | SHARE_FIELDS
    | {"pe", "pe_ttm", "turnover_rate", "basis", "term_structure", "open_interest", "near_price", "far_price"}
    | {"spot", "future", "delta", "bond_floor", "underlying_price"}
)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day x user panel from events."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.to_date("ts").alias("date"), F.col("user_id")).agg(
        F.sum("value").alias("v"), F.count(F.lit(1)).cast("double").alias("volume")
    ).select(
        "date",
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("asset"),
        (cents("v") / F.col("volume")).alias("close"),
        "volume",
    )


def date_is_wide(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the largest week has too many line items for one task (an upper bound on assets)."""
    from ..operators.sizes import is_wide

    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")
    return is_wide(table(spark, sf_dir, "lineitem").select(week), ["date"])


# The same panels for the SQL check.
PANEL_SQL = """
lines AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS supp, l_extendedprice AS e, l_quantity AS q,
         l_extendedprice / l_quantity AS unit, l_discount, isodow(l_shipdate) - 1 AS wd, p_retailprice
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey),
cells AS (
  SELECT date, supp, round(sum(e), 2) AS amount, sum(q) AS volume, count(*) AS trades,
         coalesce(FIRST_DAY) AS open,
         max(unit) AS high, min(unit) AS low, round(sum(l_discount), 2) AS disc0, round(sum(p_retailprice), 2) AS retail0
  FROM lines GROUP BY date, supp),
shaped AS (
  SELECT date, supp, lpad(CAST(supp AS VARCHAR), 10, '0') AS asset, open, high, low, amount / volume AS close, volume, amount,
         volume / trades AS turnover, disc0 / trades AS disc, retail0 / trades AS retail, trades,
         sum(volume) OVER (PARTITION BY supp) AS total_share
  FROM cells),
panel AS (
  SELECT s.date, s.asset, s.open, s.high, s.low, s.close, s.volume, s.amount, s.turnover,
         total_share, total_share * (1 - disc) AS float_share,
         close * total_share AS market_cap, close * total_share * (1 - disc) AS float_market_cap,
         close * total_share * (1 - disc) AS circ_mv, close * total_share AS issuance_size,
         coalesce(n_name, 'unknown') AS industry, close / retail AS pb, close / retail - 1 AS premium_rate,
         amount / trades AS pe, amount / trades AS pe_ttm,
         turnover AS turnover_rate, close AS vwap, (open - close) / open AS basis,
         high / low - 1 AS term_structure, volume * 2 + turnover AS open_interest,
         high AS near_price, low AS far_price, open AS spot, close AS future, disc AS delta, low AS bond_floor,
         open AS underlying_price
  FROM shaped s LEFT JOIN supplier ON supp = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)"""
PANEL_SQL = PANEL_SQL.replace(
    "FIRST_DAY", ", ".join(f"round(sum(e) FILTER (WHERE wd = {d}), 2) / sum(q) FILTER (WHERE wd = {d})" for d in range(7))
)

DAILY_SQL = """
daily AS (
  SELECT CAST(ts AS DATE) AS date, lpad(CAST(user_id AS VARCHAR), 10, '0') AS asset, round(sum(value), 2) / count(*) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
