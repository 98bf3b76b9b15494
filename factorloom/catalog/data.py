"""Ingest, merge, quality and universe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import query, r6, show
from .dsl import A
from ..functions import text as tx
from ..operators import quality
from ..sources import ingest
from ..sources.adapters import DAILY_SQL, PANEL_SQL, daily_panel, table, weekly_panel

TODAY = "DATE '2001-12-31'"


def today():
    return F.lit("2001-12-31").cast("date")


def dates(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


# -- scans and keys ----------------------------------------------------------------------------


CLEAN_SQL = f"""WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, CASE WHEN industry = 'NATION_3' THEN 'unknown' ELSE industry END AS industry,
 {r6('close', 'close', 4)}, {r6('close * volume', 'market_cap', 2)} FROM panel WHERE volume <> 7"""


def raw_panel(spark, sf_dir):
    """The panel as text, every row twice."""
    p = weekly_panel(spark, sf_dir, ["industry"])
    raw = p.select(
        F.date_format("date", "yyyyMMdd").alias("date"),
        F.concat("asset", F.lit(".SZ")).alias("ts_code"),
        F.col("close").cast("string").alias("close"),
        F.when(F.col("volume") == 7, "n/a").otherwise(F.col("volume").cast("string")).alias("volume"),
        F.when(F.col("industry") == "NATION_3", " NaN ").otherwise(F.col("industry")).alias("industry"),
    )
    return raw.unionByName(raw)


@query("s_scan_panel", CLEAN_SQL)
def scan_panel(spark, sf_dir):
    return show(ingest.clean_panel(raw_panel(spark, sf_dir)), ["date", "asset", "industry"], ["close"], 4, {"market_cap": 2})


@query("s_normalize_vendor", CLEAN_SQL)
def normalize_vendor(spark, sf_dir):
    names = {"trade_date": "date", "vol": "volume", "sector": "industry"}
    vendor = raw_panel(spark, sf_dir).withColumnsRenamed({v: k for k, v in names.items()})
    return show(ingest.normalize_vendor(vendor, names), ["date", "asset", "industry"], ["close"], 4, {"market_cap": 2})


@query(
    "s_scan_price_series",
    f"""WITH {PANEL_SQL}, m AS (SELECT date, avg(open) AS open, max(high) AS high, min(low) AS low, sum(amount) / sum(volume) AS close, sum(volume) AS volume FROM panel GROUP BY date)
SELECT CAST(date AS VARCHAR) AS date, {r6('high', 'high', 4)}, {r6('low', 'low', 4)}, {r6('close', 'close', 4)}, {r6('volume', 'volume', 4)} FROM m""",
)
def scan_price_series(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    m = p.groupBy("date").agg(
        F.avg("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        (F.sum("amount") / F.sum("volume")).alias("close"), F.sum("volume").alias("volume"),
    )
    raw = m.select(*[F.col(c).cast("string").alias(c) for c in m.columns])
    bad = raw.withColumns({"close": F.lit("x"), "date": F.lit("19000101")})
    d = ingest.clean_price_series(raw.unionByName(raw).unionByName(bad))
    return show(d, ["date"], ["high", "low", "close", "volume"], 4)


@query(
    "s_summarize_panel",
    f"""WITH {PANEL_SQL} SELECT count(*) AS rows, count(DISTINCT asset) AS assets, CAST(min(date) AS VARCHAR) AS start_date, CAST(max(date) AS VARCHAR) AS end_date,
 {r6("arg_max(close, CAST(date AS VARCHAR) || asset)", 'latest_close', 4)} FROM panel""",
)
def summarize(spark, sf_dir):
    d = dates(ingest.summarize_panel(weekly_panel(spark, sf_dir)), "start_date", "end_date")
    return show(d, ["rows", "assets", "start_date", "end_date"], ["latest_close"], 4)


KEEP = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def _dedup(name: str, last: bool) -> None:
    order = ", ".join(f"{c} {'DESC' if last else 'ASC'}" for c in KEEP)

    @query(
        name,
        f"""SELECT l_orderkey, l_linenumber, l_partkey, {r6('l_extendedprice', 'l_extendedprice', 2)} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1""",
    )
    def run(spark, sf_dir):
        d = ingest.dedup_keep(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], KEEP, last)
        return show(d, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_extendedprice"], 2)


_dedup("s_dedup_keep_first", False)
_dedup("s_dedup_keep_last", True)

CUT = "DATE '2000-01-03'"


def halves(spark, sf_dir):
    """An existing panel up to 2000 and new rows from 1999 on at doubled closes."""
    p = weekly_panel(spark, sf_dir).select("date", "asset", "close", "volume")
    old = p.filter(F.col("date") < "2000-01-03")
    new = p.filter(F.col("date") >= "1999-01-04").withColumns({"close": F.col("close") * 2, "source": F.lit("new")})
    return old, new


MERGED = "SELECT CAST(date AS VARCHAR) AS date, asset, {src} AS source, " + r6("close * {k}", "close", 4) + " FROM panel"
NEW = "date >= DATE '1999-01-04'"
OLD = f"date < {CUT}"


@query("s_upsert_panel", f"WITH {PANEL_SQL} " + MERGED.format(src=f"CASE WHEN {NEW} THEN 'new' END", k=f"CASE WHEN {NEW} THEN 2 ELSE 1 END"))
def upsert(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return show(ingest.upsert(old, new), ["date", "asset", "source"], ["close"], 4)


@query("s_extend_backward", f"WITH {PANEL_SQL} " + MERGED.format(src=f"CASE WHEN NOT {OLD} THEN 'new' END", k=f"CASE WHEN {OLD} THEN 1 ELSE 2 END"))
def extend_backward(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return show(ingest.upsert(old, new, newest_wins=False), ["date", "asset", "source"], ["close"], 4)


@query("s_new_rows_only", f"WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('close * 2', 'close', 4)} FROM panel WHERE date > (SELECT max(date) FROM panel WHERE {OLD}) AND {NEW}")
def new_rows(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return show(ingest.new_rows_only(new, old), ["date", "asset"], ["close"], 4)


@query(
    "s_normalize_units",
    f"""WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, CASE WHEN industry = 'NATION_5' THEN 'unknown' ELSE industry END AS industry,
 {r6('volume * 100', 'volume', 2)}, {r6('amount * 1000', 'amount', 2)}, CAST(NULL AS DOUBLE) AS market_cap FROM panel""",
)
def normalize_units(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    raw = p.select(
        F.concat("asset", F.lit(".SH")).alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("trade_date"), "close", F.col("volume").alias("vol"), "amount"
    )
    d = ingest.normalize_units(raw, supplier_industry(spark, sf_dir).filter(F.col("industry") != "NATION_5"))
    return show(d, ["date", "asset", "industry"], ["volume", "amount", "market_cap"], 2)


def supplier_industry(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("asset"), F.col("n_name").alias("industry"))


@query(
    "s_exchange_code",
    """WITH c AS (SELECT c_custkey, CASE WHEN length(CAST(c_custkey * 7919 AS VARCHAR)) >= 6 THEN CAST(c_custkey * 7919 AS VARCHAR) ELSE lpad(CAST(c_custkey * 7919 AS VARCHAR), 6, '0') END AS z FROM customer)
SELECT c_custkey, CASE WHEN z[1] IN ('6', '9') THEN 'sh' WHEN z[1] IN ('4', '8') THEN 'bj' ELSE 'sz' END || z AS symbol, z || CASE WHEN z[1] = '6' THEN '.SH' ELSE '.SZ' END AS ts_code FROM c""",
)
def exchange_code(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("code", F.col("c_custkey") * 7919)
    return c.select("c_custkey", tx.exchange_prefix("code").alias("symbol"), tx.exchange_suffix("code").alias("ts_code"))


@query(
    "s_attach_industry",
    f"""WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, CASE WHEN industry IN ('NATION_1', 'NATION_2') THEN 'unknown' ELSE industry END AS industry FROM panel""",
)
def attach_industry(spark, sf_dir):
    ind = supplier_industry(spark, sf_dir).withColumn("industry", F.when(F.col("industry") == "NATION_1", "none").otherwise(F.col("industry")))
    d = ingest.attach_industry(weekly_panel(spark, sf_dir), ind.filter(F.col("industry") != "NATION_2"))
    return dates(d.select("date", "asset", "industry"), "date")


META = """ma AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN ' nan ' ELSE s_name END AS nm, CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'N' || s_nationkey END AS ind,
  CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cap FROM supplier),
mb AS (SELECT c_custkey AS k, c_name AS nm, c_mktsegment AS ind, c_acctbal AS cap FROM customer)"""


def metadata(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("asset"),
        F.when(F.col("s_suppkey") % 3 == 0, " nan ").otherwise(F.col("s_name")).alias("asset_name"),
        F.when(F.col("s_suppkey") % 2 == 0, "unknown").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("industry"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("market_cap"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("asset"), F.col("c_name").alias("asset_name"), F.col("c_mktsegment").alias("industry"), F.col("c_acctbal").alias("market_cap")
    )
    return s, c


@query(
    "s_merge_metadata",
    f"""WITH {META} SELECT CAST(coalesce(ma.k, mb.k) AS VARCHAR) AS asset, coalesce(CASE WHEN trim(ma.nm) <> 'nan' THEN ma.nm END, mb.nm) AS asset_name,
 coalesce(nullif(ma.ind, 'unknown'), mb.ind, 'unknown') AS industry, {r6('coalesce(ma.cap, mb.cap)', 'market_cap', 2)} FROM ma FULL JOIN mb ON ma.k = mb.k""",
)
def merge_metadata(spark, sf_dir):
    s, c = metadata(spark, sf_dir)
    return show(ingest.merge_metadata(s, c, ["asset_name", "industry"], ["market_cap"]), ["asset", "asset_name", "industry"], ["market_cap"], 2)


@query(
    "s_fill_metadata_secondary",
    f"""WITH {META} SELECT CAST(ma.k AS VARCHAR) AS asset, coalesce(CASE WHEN trim(ma.nm) <> 'nan' THEN ma.nm END, mb.nm, '') AS asset_name, coalesce(nullif(ma.ind, 'unknown'), mb.ind, 'unknown') AS industry,
 CAST(trim(ma.nm) = 'nan' AND mb.nm IS NOT NULL AS INT) AS name_filled, CAST(ma.ind = 'unknown' AND mb.ind IS NOT NULL AS INT) AS industry_filled FROM ma LEFT JOIN mb ON ma.k = mb.k""",
)
def fill_secondary(spark, sf_dir):
    s, c = metadata(spark, sf_dir)
    d = ingest.fill_secondary(s, c, c)
    return d.select("asset", "asset_name", "industry", F.col("name_filled").cast("int").alias("name_filled"), F.col("industry_filled").cast("int").alias("industry_filled"))


@query(
    "s_attach_caps",
    f"""WITH {PANEL_SQL}, m AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS asset, CASE WHEN s_nationkey < 10 THEN s_acctbal END AS ts, CASE WHEN s_nationkey < 15 THEN abs(s_acctbal) END AS mc FROM supplier)
SELECT CAST(date AS VARCHAR) AS date, p.asset, {r6('CASE WHEN ts > 0 THEN close * ts WHEN mc IS NOT NULL THEN mc ELSE close * volume END', 'market_cap', 2)},
 {r6('CASE WHEN ts > 0 THEN close * ts / 2 ELSE mc END', 'float_market_cap', 2)} FROM panel p LEFT JOIN m ON p.asset = m.asset""",
)
def attach_caps(spark, sf_dir):
    bal = F.col("s_acctbal")
    m = table(spark, sf_dir, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("asset"),
        F.when(F.col("s_nationkey") < 10, bal).alias("total_share"),
        F.when(F.col("s_nationkey") < 10, bal / 2).alias("float_share"),
        F.when(F.col("s_nationkey") < 15, F.abs(bal)).alias("market_cap"),
        F.when(F.col("s_nationkey") < 15, F.abs(bal)).alias("float_market_cap"),
    )
    return show(ingest.attach_caps(weekly_panel(spark, sf_dir), m), ["date", "asset"], ["market_cap", "float_market_cap"], 2)


@query(
    "s_attach_adj_factor",
    f"""WITH {PANEL_SQL}, a AS (SELECT date, asset, turnover / 10 AS adj FROM panel WHERE asset < '0000000050' AND volume > 20), h AS (SELECT DISTINCT asset FROM a)
SELECT CAST(p.date AS VARCHAR) AS date, p.asset, {r6('CASE WHEN h.asset IS NULL THEN 1.0 ELSE adj END', 'adj_factor')} FROM panel p LEFT JOIN a USING (date, asset) LEFT JOIN h ON h.asset = p.asset""",
)
def adj_factor(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    a = p.filter((F.col("asset") < "0000000050") & (F.col("volume") > 20)).select("date", "asset", (F.col("turnover") / 10).alias("adj_factor"))
    return show(ingest.attach_adj_factor(p, a), ["date", "asset"], ["adj_factor"])


# -- as-of joins and earnings ----------------------------------------------------------------------

REPORTS = """rp AS (SELECT asset, CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 40 DAY AS rd, sum(amount) AS q FROM panel GROUP BY 1, 2),
rq AS (SELECT asset, CAST(rd AS DATE) AS date, sum(q) OVER (PARTITION BY asset, year(rd) ORDER BY rd) AS cum, q FROM rp)"""


def reports(p):
    """Quarterly reports per asset: amount so far in the year, dated 40 days into the quarter."""
    from pyspark.sql import Window

    q = p.groupBy("asset", F.date_add(F.trunc("date", "quarter"), 40).alias("date")).agg(F.sum("amount").alias("q"))
    w = Window.partitionBy("asset", F.year("date")).orderBy("date")
    return q.withColumn("cum", F.sum("q").over(w))


@query(
    "j_asof_join",
    f"""WITH {PANEL_SQL}, {REPORTS}, j AS (SELECT p.date, p.asset, r.q AS pe FROM panel p ASOF LEFT JOIN rq r ON p.asset = r.asset AND p.date >= r.date),
b AS (SELECT date, asset, coalesce(pe, first_value(pe IGNORE NULLS) OVER ({A} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pe FROM j)
SELECT CAST(date AS VARCHAR) AS date, asset, {r6('pe', 'pe', 2)} FROM b""",
)
def asof_join(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    r = reports(p).select("asset", "date", F.col("q").alias("pe"))
    return show(ingest.asof_join(p.select("date", "asset"), r, "pe"), ["date", "asset"], ["pe"], 2)


@query(
    "s_merge_pb_fill",
    f"""WITH {PANEL_SQL}, v AS (SELECT date, asset, CASE WHEN volume > 30 THEN turnover END AS pb FROM panel),
f AS (SELECT date, asset, last_value(pb IGNORE NULLS) OVER ({A} ROWS UNBOUNDED PRECEDING) AS pb FROM v)
SELECT CAST(date AS VARCHAR) AS date, asset, {r6(f'first_value(pb IGNORE NULLS) OVER ({A} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'pb')} FROM f""",
)
def merge_pb(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    v = p.filter(F.col("volume") > 30).select("date", "asset", F.col("turnover").alias("pb"))
    return show(ingest.merge_fill(p.select("date", "asset"), v, "pb"), ["date", "asset"], ["pb"])


@query(
    "s_ttm_earnings",
    f"""WITH {PANEL_SQL}, {REPORTS}, d AS (SELECT asset, date, coalesce(cum - lag(cum) OVER ({A}), cum) AS q, count(*) OVER (PARTITION BY asset) AS k FROM rq),
t AS (SELECT asset, date, k, sum(q) OVER ({A} ROWS 3 PRECEDING) AS ttm FROM d), u AS (SELECT * FROM t WHERE k >= 2 AND round(ttm, 6) > 0)
SELECT CAST(u.date AS VARCHAR) AS date, u.asset, {r6('market_cap / ttm', 'pe', 4)} FROM u ASOF JOIN panel p ON p.asset = u.asset AND u.date >= p.date WHERE market_cap > 0""",
)
def ttm(spark, sf_dir):
    p = weekly_panel(spark, sf_dir, ["market_cap"])
    return show(ingest.ttm_earnings(p, reports(p)), ["date", "asset"], ["pe"], 4)


@query(
    "s_dataset_profile",
    f"""WITH {PANEL_SQL}, x AS (SELECT *, nullif(volume, 7) AS v7 FROM panel) SELECT count(*) AS rows, count(DISTINCT asset) AS assets, count(DISTINCT date) AS dates,
 CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, {r6('1 - count(v7) / count(*)', 'missing_volume')}, {r6('0', 'missing_close')} FROM x""",
)
def profile(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select("date", "asset", "close", F.nullif("volume", F.lit(7.0)).alias("volume"))
    d = dates(quality.dataset_profile(p), "first_date", "last_date")
    return show(d, ["rows", "assets", "dates", "first_date", "last_date"], ["missing_volume", "missing_close"])


@query(
    "s_add_missing_columns",
    f"WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('close', 'close', 4)}, CAST(NULL AS DOUBLE) AS pe, CAST(NULL AS VARCHAR) AS industry FROM panel",
)
def missing_columns(spark, sf_dir):
    d = ingest.add_missing_columns(weekly_panel(spark, sf_dir))
    return show(d, ["date", "asset", "industry"], ["close", "pe"], 4)


@query(
    "s_expand_to_panel",
    f"""WITH {PANEL_SQL}, m AS (SELECT date, sum(amount) / sum(volume) AS close, sum(volume) AS volume, CAST(row_number() OVER (ORDER BY date) - 1 AS DOUBLE) AS t FROM panel GROUP BY date),
k AS (SELECT unnest(range(6)) AS k), e AS (SELECT date, k, close * (1 + k * 0.035) * (1 + 0.025 * sin(t / (5 + k))) * (1 + (k - 2) * 0.00045 * t) AS close,
  greatest(volume * (1 + k * 0.18) * (1 + 0.12 * cos(t / (4 + k))), 1.0) AS volume FROM m, k)
SELECT CAST(date AS VARCHAR) AS date, 'proxy_0' || (k + 1) AS asset, (['bank', 'tech', 'consumer', 'industry', 'energy', 'healthcare'])[k + 1] AS industry, {r6('close', 'close', 4)}, {r6('volume', 'volume', 4)} FROM e""",
)
def expand(spark, sf_dir):
    m = weekly_panel(spark, sf_dir).groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("close"), F.sum("volume").alias("volume"))
    return show(ingest.expand_to_panel(m), ["date", "asset", "industry"], ["close", "volume"], 4)


@query(
    "s_resume_assets",
    f"""WITH {PANEL_SQL}, l AS (SELECT DISTINCT asset FROM panel WHERE date BETWEEN DATE '2001-10-20' AND DATE '2001-12-31'), b AS (SELECT DISTINCT asset FROM panel WHERE volume > 180)
SELECT p.asset, CASE WHEN b.asset IS NOT NULL THEN 0 ELSE 1 END AS priority FROM (SELECT DISTINCT asset FROM panel) p LEFT JOIN b USING (asset) WHERE p.asset NOT IN (SELECT asset FROM l)""",
)
def resume(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    return ingest.resume_assets(p.select("asset").distinct(), p, "2001-10-20", "2001-12-31", p.filter(F.col("volume") > 180))


# -- set operations --------------------------------------------------------------------------------


@query("u_union_by_name", f"WITH {PANEL_SQL}, {DAILY_SQL} SELECT 'w' AS src, count(*) AS rows, count(amount) AS amounts FROM panel UNION ALL SELECT 'd', count(*), 0 FROM daily")
def union_by_name(spark, sf_dir):
    d = weekly_panel(spark, sf_dir).withColumn("src", F.lit("w")).unionByName(daily_panel(spark, sf_dir).withColumn("src", F.lit("d")), allowMissingColumns=True)
    return d.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.count("amount").alias("amounts"))


@query("u_intersect", f"WITH {PANEL_SQL} SELECT asset FROM panel WHERE volume > 90 INTERSECT SELECT asset FROM panel WHERE volume < 5")
def intersect(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    return p.filter(F.col("volume") > 90).select("asset").intersect(p.filter(F.col("volume") < 5).select("asset"))


@query("u_except", f"WITH {PANEL_SQL} SELECT asset FROM panel EXCEPT SELECT asset FROM panel WHERE volume > 180")
def except_(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    return p.select("asset").distinct().exceptAll(p.filter(F.col("volume") > 180).select("asset").distinct())


@query("j_semi_anti", f"WITH {PANEL_SQL}, b AS (SELECT DISTINCT asset FROM panel WHERE volume > 180) SELECT CAST(date AS VARCHAR) AS date, asset, {r6('close', 'close', 4)} FROM panel WHERE asset IN (SELECT asset FROM b) AND date NOT IN (SELECT date FROM panel GROUP BY date HAVING count(*) < 80)")
def semi_anti(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    big = p.filter(F.col("volume") > 180).select("asset")
    thin = p.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < 80)
    return show(p.join(big, "asset", "left_semi").join(thin, "date", "left_anti"), ["date", "asset"], ["close"], 4)


@query("j_align_factor_by_date", f"WITH {PANEL_SQL}, f AS (SELECT date, avg(turnover) AS factor FROM panel GROUP BY date HAVING count(*) >= 80) SELECT CAST(date AS VARCHAR) AS date, asset, {r6('factor', 'factor')} FROM panel LEFT JOIN f USING (date)")
def align_by_date(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    f = p.groupBy("date").agg(F.avg("turnover").alias("factor"), F.count(F.lit(1)).alias("n")).filter("n >= 80").drop("n")
    return show(p.join(f, "date", "left"), ["date", "asset"], ["factor"])


@query("j_align_factor", f"WITH {PANEL_SQL}, f AS (SELECT date, asset, turnover AS factor FROM panel WHERE volume > 20) SELECT CAST(date AS VARCHAR) AS date, asset, {r6('factor', 'factor')} FROM panel LEFT JOIN f USING (date, asset)")
def align(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    f = p.filter(F.col("volume") > 20).select("date", "asset", F.col("turnover").alias("factor"))
    return show(p.join(f, ["date", "asset"], "left"), ["date", "asset"], ["factor"])


# -- quality and universe ----------------------------------------------------------------------------

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ALL = [*NUM, "l_returnflag", "l_linestatus", "l_shipdate"]
OUT = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", 1 - count({c}) / count(*) AS missing_rate, "
    + (f"count(*) FILTER (WHERE s_{c} > 0 AND abs({c} - m_{c}) > 1.7 * s_{c})" if c in NUM else "0") + " AS outliers FROM x, mo"
    for c in ALL
)
QUALITY = f"""x AS (SELECT * REPLACE (nullif(l_quantity, 7) AS l_quantity) FROM lineitem),
mo AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in NUM)} FROM x)"""


def gappy_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0)))


@query("q_column_profile", f"WITH {QUALITY} SELECT \"column\", CAST(outliers AS BIGINT) AS outliers, {r6('missing_rate', 'missing_rate')} FROM ({OUT})")
def column_profile(spark, sf_dir):
    return show(quality.column_profile(gappy_lines(spark, sf_dir), 1.7), ["column", "outliers"], ["missing_rate"])


@query(
    "q_quality_report",
    f"""WITH {QUALITY}, o AS ({OUT.replace('1.7 * s_', '5 * s_')}), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM x)),
r AS (SELECT (SELECT count(*) FROM x) AS total_rows, 11 AS total_columns, (SELECT count(*) FROM x) - (SELECT n FROM d) AS duplicate_rows,
  date_diff('day', (SELECT max(l_shipdate)::DATE FROM x), {TODAY}) AS stale_days, (SELECT avg(missing_rate) FROM o) AS mr, (SELECT CAST(sum(outliers) AS BIGINT) FROM o) AS total_outliers)
SELECT total_rows, total_columns, duplicate_rows, CAST(stale_days AS INT) AS stale_days, total_outliers, {r6('mr', 'avg_missing_rate')},
 {r6('round((1 - mr) * 0.4 + exp(-greatest(stale_days, 0) / 30.0) * 0.3 + (1 - total_outliers / (total_rows * 11)) * 0.3, 4)', 'quality_score', 4)} FROM r""",
)
def quality_report(spark, sf_dir):
    d = quality.quality_report(gappy_lines(spark, sf_dir), today(), "l_shipdate")
    return show(d, ["total_rows", "total_columns", "duplicate_rows", "stale_days", "total_outliers"], ["avg_missing_rate"], other={"quality_score": 4})


@query(
    "q_coverage_report",
    f"""WITH {PANEL_SQL}, x AS (SELECT date, asset, close, nullif(volume, 7) AS volume, CASE WHEN industry = 'NATION_4' THEN 'unknown' ELSE industry END AS industry, CASE WHEN asset > '0000000010' THEN market_cap END AS market_cap FROM panel),
k AS (SELECT max(CASE WHEN industry <> 'unknown' THEN 1 ELSE 0 END) AS i, max(CASE WHEN market_cap IS NOT NULL THEN 1 ELSE 0 END) AS c FROM x GROUP BY asset)
SELECT count(*) AS total_rows, (SELECT count(*) FROM k) AS asset_count, CAST(min(date) AS VARCHAR) AS date_start, CAST(max(date) AS VARCHAR) AS date_end,
 {r6('(count(*) * 2 - count(volume) - count(market_cap)) / (count(*) * 6)', 'nan_ratio')}, {r6('(SELECT avg(i) FROM k)', 'industry_coverage')}, {r6('(SELECT avg(c) FROM k)', 'market_cap_coverage')} FROM x""",
)
def coverage_report(spark, sf_dir):
    p = weekly_panel(spark, sf_dir, ["industry", "market_cap"]).select(
        "date", "asset", "close", F.nullif("volume", F.lit(7.0)).alias("volume"),
        F.when(F.col("industry") == "NATION_4", "unknown").otherwise(F.col("industry")).alias("industry"),
        F.when(F.col("asset") > "0000000010", F.col("market_cap")).alias("market_cap"),
    )
    d = dates(quality.coverage_report(p), "date_start", "date_end")
    return show(d, ["total_rows", "asset_count", "date_start", "date_end"], ["nan_ratio", "industry_coverage", "market_cap_coverage"])


SURVIVE = f"""sp AS (SELECT asset, min(date) AS f, max(date) AS l FROM panel GROUP BY 1),
m AS (SELECT * FROM sp WHERE f < (SELECT min(date) FROM panel) + INTERVAL 14 DAY),
ac AS (SELECT asset FROM m WHERE l > (SELECT max(date) FROM panel) - INTERVAL 14 DAY),
k1 AS (SELECT date, asset, close FROM panel WHERE asset IN (SELECT asset FROM ac)),
k2 AS (SELECT *, close / lag(close, 5) OVER ({A}) - 1 AS r FROM k1 WHERE date IN (SELECT date FROM k1 GROUP BY date HAVING count(*) >= 70)),
sv AS (SELECT date, asset, CASE WHEN NOT coalesce(r < -0.5 OR r > 2, false) THEN close END AS close FROM k2)"""


@query("q_survivorship_filter", f"WITH {PANEL_SQL}, {SURVIVE} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('close', 'close', 4)} FROM sv")
def survivorship(spark, sf_dir):
    return show(quality.survivorship_filter(weekly_panel(spark, sf_dir).select("date", "asset", "close"), 14, 14, 70), ["date", "asset"], ["close"], 4)


@query(
    "q_survivorship_summary",
    f"""WITH {PANEL_SQL}, {SURVIVE} SELECT (SELECT count(*) FROM panel) AS original_rows, (SELECT count(DISTINCT asset) FROM panel) AS original_assets, (SELECT count(DISTINCT date) FROM panel) AS original_dates,
 count(*) AS final_rows, count(DISTINCT asset) AS final_assets, count(DISTINCT date) AS final_dates, {r6('count(*) / (SELECT count(*) FROM panel) * 100', 'retention_pct')} FROM sv""",
)
def survivorship_summary(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select("date", "asset", "close")
    d = quality.survivorship_summary(p, quality.survivorship_filter(p, 14, 14, 70))
    return show(d, [c for c in d.columns if c != "retention_pct"], ["retention_pct"])


@query(
    "q_price_gaps",
    f"WITH {PANEL_SQL}, r AS (SELECT asset, date, close / lag(close) OVER ({A}) - 1 AS ratio FROM panel) SELECT asset, CAST(date AS VARCHAR) AS date, {r6('ratio', 'ratio')} FROM r WHERE abs(ratio) > 0.5",
)
def price_gaps(spark, sf_dir):
    return show(quality.price_gaps(weekly_panel(spark, sf_dir)), ["asset", "date"], ["ratio"])


ACTIONS = f"""rv AS (SELECT asset, date, close / lag(close) OVER ({A}) - 1 AS ratio, volume / nullif(lag(volume) OVER ({A}), 0) - 1 AS v FROM panel),
act AS (SELECT asset, date, ratio, CASE WHEN ratio < -0.4 AND v > 2 THEN 'split' WHEN ratio < -0.01 AND ratio > -0.1 AND abs(v) < 0.5 THEN 'dividend' END AS action FROM rv)"""


@query("q_corporate_actions", f"WITH {PANEL_SQL}, {ACTIONS} SELECT asset, CAST(date AS VARCHAR) AS date, action, {r6('ratio', 'ratio')} FROM act WHERE action IS NOT NULL")
def corporate_actions(spark, sf_dir):
    return show(quality.corporate_actions(weekly_panel(spark, sf_dir)), ["asset", "date", "action"], ["ratio"])


# Thin volume stands for a halted row, so that runs exist in the data.
HALTED = f"""h AS (SELECT date, asset, close, CASE WHEN volume < 40 THEN 0 ELSE volume END AS volume FROM panel),
hf AS (SELECT *, row_number() OVER ({A}) - sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) OVER ({A}) AS island FROM h),
hr AS (SELECT asset, count(*) AS run_length, min(date) AS s, max(date) AS e FROM hf WHERE volume = 0 GROUP BY asset, island HAVING count(*) >= 5)"""


def halted(spark, sf_dir):
    v = F.when(F.col("volume") < 40, 0.0).otherwise(F.col("volume"))
    return weekly_panel(spark, sf_dir).select("date", "asset", "close", v.alias("volume"))


@query("q_suspensions", f'WITH {PANEL_SQL}, {HALTED} SELECT asset, run_length, CAST(s AS VARCHAR) AS "start", CAST(e AS VARCHAR) AS "end" FROM hr')
def suspensions(spark, sf_dir):
    return dates(quality.suspensions(halted(spark, sf_dir)), "start", "end")


@query(
    "q_sanity_checks",
    f"""WITH {PANEL_SQL}, {HALTED} SELECT 0 AS nan_in_close, count(DISTINCT CASE WHEN volume = 0 THEN asset END) AS zero_volume, count(*) FILTER (WHERE date > DATE '2000-01-01') AS future_dates, count(*) AS duplicate_rows FROM h""",
)
def sanity(spark, sf_dir):
    h = halted(spark, sf_dir)
    d = quality.sanity_checks(h.unionByName(h), F.lit("2000-01-01").cast("date"))
    return d.withColumn("future_dates", (F.col("future_dates") / 2).cast("bigint"))


@query(
    "q_anomaly_summary",
    f"""WITH {PANEL_SQL}, {HALTED}, rv AS (SELECT asset, date, close / lag(close) OVER ({A}) - 1 AS ratio, volume / nullif(lag(volume) OVER ({A}), 0) - 1 AS v FROM h),
act AS (SELECT CASE WHEN ratio < -0.4 AND v > 2 THEN 'split' WHEN ratio < -0.01 AND ratio > -0.1 AND abs(v) < 0.5 THEN 'dividend' END AS action FROM rv),
k AS (SELECT 'nan_in_close' AS kind, 0 AS n UNION ALL SELECT 'zero_volume', count(DISTINCT CASE WHEN volume = 0 THEN asset END) FROM h UNION ALL SELECT 'future_dates', 0 UNION ALL SELECT 'duplicate_rows', 0
 UNION ALL SELECT action, count(*) FROM act WHERE action IS NOT NULL GROUP BY 1 UNION ALL SELECT 'price_gap', count(*) FROM rv WHERE abs(ratio) > 0.5 UNION ALL SELECT 'suspended', count(DISTINCT asset) FROM hr)
SELECT kind, CAST(n AS BIGINT) AS n FROM k UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM k""",
)
def anomaly_summary(spark, sf_dir):
    return quality.anomaly_summary(halted(spark, sf_dir), today())


# -- dates and strings -----------------------------------------------------------------------------------


@query(
    "x_date_functions",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE)::VARCHAR AS back6, CAST(CAST(o_orderdate AS DATE) - 60 AS VARCHAR) AS minus60,
 CAST(date_trunc('month', o_orderdate) AS DATE)::VARCHAR AS month_start, CAST(greatest(0, date_diff('day', o_orderdate::DATE, DATE '2001-12-31')) AS INT) AS stale, CAST(date_diff('day', o_orderdate::DATE, DATE '2001-12-31') > 3 AS INT) AS outdated FROM orders""",
)
def date_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", tx.compact_date(F.date_format("o_orderdate", "yyyyMMdd"))).withColumn("t", today())
    d = o.select(
        "o_orderkey", F.col("d").alias("parsed"), F.add_months("d", -6).alias("back6"), F.date_sub("d", 60).alias("minus60"),
        F.trunc("d", "MM").alias("month_start"), tx.stale_days("d", "t").alias("stale"), (tx.stale_days("d", "t") > 3).cast("int").alias("outdated"),
    )
    return dates(d, "parsed", "back6", "minus60", "month_start")


@query(
    "x_string_functions",
    """SELECT p_partkey, CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 6 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS code,
 CASE WHEN p_size > 25 THEN p_name END AS cleaned, CAST(starts_with(p_brand, 'Brand#1') AS INT) AS pre, CAST(contains(p_name, 'red') AS INT) AS has, p_name[1:5] AS head,
 array_to_string(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), lambda w: length(w) > 1)).list_sort(), ' ') AS words FROM part""",
)
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("raw", F.when(F.col("p_size") > 25, F.concat(F.lit(" "), F.col("p_name"))).otherwise(" NaN"))
    return p.select(
        "p_partkey", tx.zero_pad("p_partkey").alias("code"), tx.clean_text("raw").alias("cleaned"), F.startswith("p_brand", F.lit("Brand#1")).cast("int").alias("pre"),
        F.contains("p_name", F.lit("red")).cast("int").alias("has"), F.substring("p_name", 1, 5).alias("head"), F.array_join(F.sort_array(tx.tokens("p_name")), " ").alias("words"),
    )
