"""Portfolio weights, costs, performance, signals and strategy studies."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import query, r6, show
from .dsl import A
from .evaluation import OVERLAP, factor_frame, factor_long
from .sqlkit import FOUR, corr, ic_daily, long_factors, pairs_of_four
from ..functions.scalar import clip
from ..operators import combine, gram, health, ic, oos, performance, portfolio, scorecard, signals
from ..operators.ordered import beside
from ..operators.ts import delta, forward_return, pct_change, trend_features
from ..plans import tree
from ..session import settle
from ..sources.adapters import PANEL_SQL, date_is_wide, table, weekly_panel

FACTOR = f"{PANEL_SQL}, f AS (SELECT *, close - lag(close, 5) OVER ({A}) AS factor_value FROM panel)"
RANKED = f"""{FACTOR}, rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor_value DESC, asset) AS rn, count(*) OVER (PARTITION BY date) AS n
  FROM f WHERE factor_value IS NOT NULL)"""
CHOSEN = f"""{RANKED}, sel AS (SELECT date, asset, factor_value, industry, 'long' AS side FROM rk WHERE n >= 10 AND rn <= 10
  UNION ALL SELECT date, asset, factor_value, industry, 'short' FROM rk WHERE n >= 10 AND rn > n - 5)"""
SIDE = "PARTITION BY date, side"
RECENT = f"""lf AS (SELECT 'f' AS factor_id, date, asset, factor_value, lead(close, 5) OVER ({A}) / close - 1 AS label FROM f), {ic_daily('lf', out='ld')},
rc AS (SELECT CASE WHEN (SELECT count(*) FROM ld) >= 5 THEN avg(rank_ic) ELSE 0 END AS recent FROM (SELECT rank_ic FROM ld ORDER BY date DESC LIMIT 20))"""
RAW = {
    "equal": f"1.0 / count(*) OVER ({SIDE})",
    "score": f"coalesce(abs(factor_value) / nullif(sum(abs(factor_value)) OVER ({SIDE}), 0), 1.0 / count(*) OVER ({SIDE}))",
    "ic_rank": f"""(rank() OVER ({SIDE} ORDER BY CASE WHEN (SELECT recent FROM rc) < 0 THEN -factor_value ELSE factor_value END DESC) + (count(*) OVER ({SIDE}, factor_value) - 1) / 2.0)
       / (count(*) OVER ({SIDE}) * (count(*) OVER ({SIDE}) + 1) / 2.0)""",
    "sector_neutral": f"1.0 / k / count(*) OVER ({SIDE}, industry)",
}


def factor_panel(spark, sf_dir, fields=()):
    return weekly_panel(spark, sf_dir, fields).withColumn("factor_value", delta("close", 5)), date_is_wide(spark, sf_dir)


def _weights(scheme: str) -> None:
    src = "(SELECT *, max(dr) OVER (PARTITION BY date, side) AS k FROM (SELECT *, dense_rank() OVER (PARTITION BY date, side ORDER BY industry) AS dr FROM sel))"

    @query(
        f"b_weights_{scheme}",
        f"""WITH {CHOSEN}, {RECENT}, w AS (SELECT date, asset, side, least(greatest({RAW[scheme]}, 0.005), 0.15) AS w FROM {src})
SELECT CAST(date AS VARCHAR) AS date, asset, side, {r6(f"CASE WHEN side = 'short' THEN -1 ELSE 1 END * w / sum(w) OVER ({SIDE})", 'weight')} FROM w""",
    )
    def run(spark, sf_dir):
        p, wide = factor_panel(spark, sf_dir, ["industry"])
        chosen = portfolio.select_side(p, 10, 5, wide)
        if scheme == "ic_rank":  # against the factor if its last ICs are negative
            long = p.select(F.lit("f").alias("factor_id"), "date", "asset", "factor_value", forward_return(5).alias("label"))
            chosen = beside(chosen, portfolio.recent_ic(ic.daily_ic(long, wide=wide)))
        return show(portfolio.weigh(chosen, scheme, F.col("recent_ic"), high=0.15), ["date", "asset", "side"], ["weight"])


for _s in RAW:
    _weights(_s)


@query(
    "b_rank_target_weights",
    f"""WITH {FACTOR}, l AS (SELECT asset, (rank() OVER (ORDER BY factor_value) + (count(*) OVER (PARTITION BY factor_value) - 1) / 2.0) AS r
  FROM f WHERE factor_value IS NOT NULL AND date = (SELECT max(date) FROM panel))
SELECT (SELECT CAST(max(date) AS VARCHAR) FROM panel) AS date, asset, {r6('r / sum(r) OVER ()', 'weight')} FROM l""",
)
def rank_weights(spark, sf_dir):
    p, wide = factor_panel(spark, sf_dir)
    return show(portfolio.latest_rank_weights(p, wide), ["date", "asset"], ["weight"])


PERIODS = """dts AS (SELECT min(date) AS date FROM (SELECT DISTINCT date FROM f) GROUP BY date_trunc('month', date)),
per AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date, CAST(row_number() OVER (ORDER BY date) AS INT) AS period FROM dts)"""


@query("b_rebalance_dates", f"WITH {FACTOR}, {PERIODS} SELECT CAST(date AS VARCHAR) AS date, CAST(next_date AS VARCHAR) AS next_date, period FROM per")
def rebalance_dates(spark, sf_dir):
    d = portfolio.month_starts(weekly_panel(spark, sf_dir).select("date").distinct())
    return d.select(F.col("date").cast("string").alias("date"), F.col("next_date").cast("string").alias("next_date"), "period")


@query(
    "b_rebalance_every_kth",
    f"""WITH {PANEL_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p FROM (SELECT DISTINCT date FROM panel))
SELECT CAST(date AS VARCHAR) AS date, CAST(row_number() OVER (ORDER BY date) AS INT) AS period FROM d WHERE p % 20 = 0""",
)
def every_kth(spark, sf_dir):
    d = portfolio.every_kth(weekly_panel(spark, sf_dir), 20)
    return d.select(F.col("date").cast("string").alias("date"), "period")


BOOK = f"""{RANKED}, {PERIODS}, hold AS (SELECT period, next_date, rk.date, asset, 1.0 / count(*) OVER (PARTITION BY period) AS weight
  FROM rk JOIN per ON rk.date = per.date WHERE n >= 10 AND rn <= 10)"""
PRICED = """pr AS (SELECT h.period, h.asset, any_value(h.weight) AS weight, arg_min(p.close, p.date) FILTER (WHERE p.date >= h.date) AS s,
  arg_max(p.close, p.date) FILTER (WHERE p.date <= h.next_date) AS e FROM hold h JOIN panel p ON h.asset = p.asset WHERE h.next_date IS NOT NULL GROUP BY 1, 2),
pret AS (SELECT period, coalesce(sum(weight * CASE WHEN s > 0 THEN e / s - 1 ELSE 0 END), 0) AS period_return, count(*) AS n_held FROM pr GROUP BY 1)"""
CHANGES = """chg AS (SELECT coalesce(a.period, b.period + 1) AS period, coalesce(a.asset, b.asset) AS asset, coalesce(a.weight, 0) AS new_w, coalesce(b.weight, 0) AS old_w
  FROM hold a FULL JOIN hold b ON a.period = b.period + 1 AND a.asset = b.asset),
ch AS (SELECT * FROM chg WHERE period > (SELECT min(period) FROM hold) AND period <= (SELECT max(period) FROM hold))"""


def monthly_book(spark, sf_dir):
    p, wide = factor_panel(spark, sf_dir)
    periods = portfolio.month_starts(p.select("date").distinct())
    chosen = portfolio.select_side(p, 10, 0, wide)
    w = portfolio.weigh(chosen, "equal", high=1.0).join(periods, "date")
    return p, periods, w


@query("b_period_returns", f"WITH {BOOK}, {PRICED} SELECT period, n_held, {r6('period_return', 'period_return')} FROM pret")
def period_returns(spark, sf_dir):
    p, periods, w = monthly_book(spark, sf_dir)
    prices = portfolio.period_prices(p, periods, w)
    held = w.filter(F.col("next_date").isNotNull())
    return show(portfolio.period_returns(held, prices), ["period", "n_held"], ["period_return"])


@query(
    "b_portfolio_turnover",
    f"WITH {BOOK}, {CHANGES} SELECT CAST(period AS INT) AS period, {r6('sum(abs(new_w - old_w)) / 2', 'turnover')} FROM ch GROUP BY 1",
)
def portfolio_turnover(spark, sf_dir):
    _, _, w = monthly_book(spark, sf_dir)
    return show(portfolio.turnover(portfolio.weight_changes(w)), ["period"], ["turnover"])


BUY = "greatest(0.0003, 5.0 / greatest(tv, 1.0)) + 0.0002 + 0.1 * pow(part, 0.5)"
COST = f"""q AS (SELECT ch.*, coalesce(p.close, 10.0) AS px, coalesce(p.volume, 1e6) AS vol, abs(new_w - old_w) * 1000000 AS tv
  FROM ch JOIN per USING (period) LEFT JOIN panel p ON p.date = per.date AND p.asset = ch.asset),
c0 AS (SELECT *, CASE WHEN vol > 0 THEN least(tv / px / greatest(vol, 1.0), 0.2) ELSE 0 END AS part FROM q WHERE tv > 0),
ct AS (SELECT *, tv * (CASE WHEN new_w > old_w THEN {BUY} ELSE {BUY} + 0.001 END) AS cost FROM c0)"""


def costs(spark, sf_dir):
    p, periods, w = monthly_book(spark, sf_dir)
    quotes = p.join(periods, "date").select("period", "asset", "close", "volume")
    return p, periods, w, portfolio.trade_costs(portfolio.weight_changes(w), quotes, 1_000_000.0)


@query(
    "b_trade_cost",
    f"WITH {BOOK}, {CHANGES}, {COST} SELECT CAST(period AS INT) AS period, asset, {r6('tv', 'trade_value', 4)}, {r6('cost', 'cost', 4)}, {r6('part', 'participation', 4)} FROM ct",
)
def trade_cost(spark, sf_dir):
    *_, c = costs(spark, sf_dir)
    return show(c, ["period", "asset"], ["trade_value", "cost", "participation"], 4)


@query(
    "b_net_of_cost",
    f"""WITH {BOOK}, {PRICED}, {CHANGES}, {COST}, k AS (SELECT period, sum(cost) AS cost FROM ct GROUP BY 1),
n AS (SELECT period_return AS g, period_return - coalesce(cost, 0) / 1000000 AS t, coalesce(cost, 0) AS cost FROM pret LEFT JOIN k USING (period))
SELECT count(*) AS n_periods, {r6('product(1 + g) - 1', 'gross_return', 4)}, {r6('product(1 + t) - 1', 'net_return', 4)}, {r6('sum(cost)', 'total_cost', 2)} FROM n""",
)
def net_of_cost(spark, sf_dir):
    p, periods, w, c = costs(spark, sf_dir)
    r = portfolio.period_returns(w.filter(F.col("next_date").isNotNull()), portfolio.period_prices(p, periods, w))
    out = performance.net_of_cost(r.join(c.groupBy("period").agg(F.sum("cost").alias("cost")), "period", "left"), 1_000_000.0)
    return show(out, ["n_periods"], ["gross_return", "net_return"], 4, {"total_cost": 2})


@query(
    "b_round_trip_cost",
    f"WITH {PANEL_SQL} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('2 * (greatest(0.0003, 5.0 / greatest(amount, 1.0)) + 0.0002) + 0.001', 'rate', 8)} FROM panel",
)
def round_trip(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).withColumn("rate", portfolio.round_trip_rate("amount"))
    return show(p, ["date", "asset"], ["rate"], 8)


IMPACT = """dd AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) AS p FROM (SELECT DISTINCT date FROM facs)),
sq AS (SELECT factor_id, asset, factor_value, p // 20 AS seq FROM facs JOIN dd USING (date) WHERE p % 20 = 0),
bo AS (SELECT c.factor_id, c.seq, c.asset, c.factor_value AS cv, p.factor_value AS pv FROM sq c JOIN sq p ON c.factor_id = p.factor_id AND c.asset = p.asset AND c.seq = p.seq + 1),
cn AS (SELECT *, count(*) OVER (PARTITION BY factor_id, seq) AS common, row_number() OVER (PARTITION BY factor_id, seq ORDER BY pv DESC NULLS LAST, asset) AS pr,
  row_number() OVER (PARTITION BY factor_id, seq ORDER BY cv DESC NULLS LAST, asset) AS cr FROM bo),
tt AS (SELECT factor_id, seq, 1 - count(*) FILTER (WHERE pv IS NOT NULL AND cv IS NOT NULL AND pr <= floor(common * 0.2) AND cr <= floor(common * 0.2))
  / greatest(count(*) FILTER (WHERE pv IS NOT NULL AND pr <= floor(common * 0.2)), 1) AS t FROM cn WHERE common >= 20 GROUP BY 1, 2),
im AS (SELECT factor_id, avg(t) AS turnover, avg(t) * 252 / 20 AS annual_turnover, avg(t) * 252 / 20 * 0.002 * 10000 AS cost_impact_bps, avg(t) * 252 / 20 * 0.002 / 0.2 AS ic_penalty FROM tt GROUP BY 1)"""


@query(
    "b_turnover_cost_impact",
    f"""WITH {long_factors()}, {IMPACT} SELECT factor_id, {r6('turnover', 'turnover')}, {r6('annual_turnover', 'annual_turnover')}, {r6('cost_impact_bps', 'cost_impact_bps', 4)}, {r6('ic_penalty', 'ic_penalty')} FROM im""",
)
def cost_impact(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    long = tree.long_form(settle(df), FOUR, ["label"])
    out = portfolio.turnover_cost_impact(long, wide=wide)
    return show(out, ["factor_id"], ["turnover", "annual_turnover", "ic_penalty"], other={"cost_impact_bps": 4})


@query(
    "b_capacity",
    f"""WITH {PANEL_SQL}, v AS (SELECT avg(volume) AS v FROM panel)
SELECT {r6('v * 20 * 0.05', 'per_stock_capacity', 4)}, {r6('v * 20 * 0.05 * 50', 'daily_capacity', 4)}, {r6('v * 20 * 0.05 * 50 * 20', 'monthly_capacity', 4)} FROM v""",
)
def capacity(spark, sf_dir):
    v = weekly_panel(spark, sf_dir).agg(F.avg("volume").alias("v"))
    out = v.select(*[c.alias(n) for n, c in portfolio.capacity("v").items()])
    return show(out, [], out.columns, 4)


NAV = f"""{RANKED}, pv AS (SELECT date, asset, lag(close) OVER ({A}) AS pc, lag(date) OVER ({A}) AS pd FROM panel),
dy AS (SELECT date, lag(date) OVER (ORDER BY date) AS yd FROM (SELECT DISTINCT date FROM panel)),
nr AS (SELECT r.date, coalesce(sum(CASE WHEN pd = yd AND pc > 0 THEN close / pc - 1 END), 0) / count(*) AS period_return, count(*) AS n_held
  FROM rk r JOIN pv USING (date, asset) JOIN dy USING (date) WHERE rn <= 50 GROUP BY 1)"""


@query("b_factor_nav", f"WITH {NAV} SELECT CAST(date AS VARCHAR) AS date, n_held, {r6('period_return', 'period_return')}, {r6('ln(product(1 + period_return) OVER (ORDER BY date))', 'log_nav')} FROM nr")
def factor_nav(spark, sf_dir):
    p, wide = factor_panel(spark, sf_dir)
    d = portfolio.factor_nav(p, 50, wide).withColumn("log_nav", F.log("nav"))
    return show(d, ["date", "n_held"], ["period_return", "log_nav"])


PERF = ["total_return", "max_drawdown", "batting_average", "annual_return", "annual_volatility", "sharpe", "calmar", "information_ratio"]
PERF_SQL = """pn AS (SELECT {by}, r, exp(sum(ln(1 + r)) OVER (PARTITION BY {by} ORDER BY date)) AS nav, date FROM {src}),
pk AS (SELECT *, nav / max(nav) OVER (PARTITION BY {by} ORDER BY date) - 1 AS dd FROM pn),
pa AS (SELECT {by}, count(*) AS n_periods, exp(sum(ln(1 + r))) - 1 AS total_return, min(dd) AS max_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS batting_average,
  stddev_samp(r) AS sd, avg(r) AS mean FROM pk GROUP BY 1),
pb AS (SELECT *, pow(1 + total_return, 252.0 / n_periods) - 1 AS annual_return, sd * sqrt(252) AS annual_volatility FROM pa),
perf AS (SELECT *, annual_return / nullif(annual_volatility, 0) AS sharpe, CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar,
  mean / nullif(sd, 0) * sqrt(252) AS information_ratio FROM pb)"""
ASSET_RETURNS = f"""ar AS (SELECT asset, date, least(greatest(close / lag(close) OVER ({A}) - 1, -0.5), 0.5) * 0.1 AS r FROM panel QUALIFY lag(close) OVER ({A}) IS NOT NULL)"""


@query("b_performance", f"WITH {PANEL_SQL}, {ASSET_RETURNS}, {PERF_SQL.format(by='asset', src='ar')} SELECT asset, n_periods, {', '.join(r6(c, c, 4) for c in PERF)} FROM perf")
def perf(spark, sf_dir):
    r = clip(pct_change("close"), -0.5, 0.5) * 0.1
    p = weekly_panel(spark, sf_dir).withColumn("r", r).filter(F.col("r").isNotNull())
    return show(performance.performance(p, "r", ["asset"]), ["asset", "n_periods"], PERF, 4)


MKT = """mk AS (SELECT per.period, avg(b.close / a.close - 1) AS m FROM per JOIN panel a ON a.date = per.date JOIN panel b ON b.date = per.next_date AND b.asset = a.asset GROUP BY 1)"""


@query(
    "h_market_attribution",
    f"""WITH {BOOK}, {PRICED}, {MKT}, x AS (SELECT period_return AS y, coalesce(m, 0) AS m FROM pret LEFT JOIN mk USING (period))
SELECT {r6('regr_slope(y, m)', 'market_beta', 5)}, {r6('regr_intercept(y, m)', 'alpha', 5)}, {r6('1 - regr_r2(y, m)', 'residual', 5)} FROM x""",
)
def attribution(spark, sf_dir):
    p, periods, w = monthly_book(spark, sf_dir)
    r = portfolio.period_returns(w.filter(F.col("next_date").isNotNull()), portfolio.period_prices(p, periods, w))
    return show(performance.attribution(r.join(performance.market_periods(p, periods), "period")), [], ["market_beta", "alpha", "residual"], 5)


BOOK_LABEL = f", lead(close, 1) OVER ({A}) / close - 1 AS lab"
TURN = """top_r AS (SELECT factor_id, date, asset, lab, row_number() OVER (PARTITION BY factor_id, date ORDER BY factor_value DESC, asset) AS rn,
   count(*) OVER (PARTITION BY factor_id, date) AS n FROM facs WHERE factor_value IS NOT NULL),
top_m AS (SELECT factor_id, date, asset, lab FROM top_r WHERE rn <= greatest(1, floor(n * 0.2))),
top_d AS (SELECT factor_id, date, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS s FROM (SELECT DISTINCT factor_id, date FROM top_m)),
top_h AS (SELECT factor_id, s, asset FROM top_m JOIN top_d USING (factor_id, date)),
top_t AS (SELECT a.factor_id, a.s, 1 - count(b.asset) / count(*) AS t FROM top_h a LEFT JOIN top_h b
   ON a.factor_id = b.factor_id AND a.asset = b.asset AND b.s = a.s + 1
   WHERE EXISTS (SELECT 1 FROM top_d d WHERE d.factor_id = a.factor_id AND d.s = a.s + 1) GROUP BY 1, 2),
tn AS (SELECT factor_id, avg(t) AS turnover FROM top_t GROUP BY 1),
bd AS (SELECT m.factor_id, m.date, avg(lab) AS r, count(*) AS k FROM top_m m GROUP BY 1, 2 HAVING count(lab) > 0),
bn AS (SELECT bd.factor_id, r, k, r - coalesce(t, 0) * 0.002 AS net FROM bd JOIN top_d USING (factor_id, date) LEFT JOIN top_t ON top_t.factor_id = bd.factor_id AND top_t.s = top_d.s - 1),
bk AS (SELECT factor_id, product(1 + r) - 1 AS gross_return, product(1 + net) - 1 AS net_return, avg(net) / nullif(stddev_samp(net), 0) * sqrt(252) AS sharpe, avg(k) AS n_positions FROM bn GROUP BY 1)"""


@query(
    "b_ic_vs_return",
    f"""WITH {long_factors(BOOK_LABEL, ', lab')}, {ic_daily('facs', 20, 'lab')}, {TURN},
s AS (SELECT factor_id, ic_mean, n_positions AS n, sharpe FROM (SELECT factor_id, avg(rank_ic) AS ic_mean FROM daily GROUP BY 1) JOIN bk USING (factor_id)),
p AS (SELECT *, CASE WHEN ic_mean > 0 THEN ic_mean * sqrt(n * 12) ELSE 0 END AS pr FROM s)
SELECT factor_id, {r6('pr', 'predicted_sharpe')}, {r6('CASE WHEN ic_mean > 0 THEN (pr - sharpe) / pr ELSE 0 END', 'correlation_bias')},
 {r6('CASE WHEN ic_mean > 0 THEN 1 - least(sharpe / pr, 1) ELSE 1 END', 'ic_inefficiency')},
 CASE WHEN ic_mean <= 0 THEN 'no_signal' WHEN sharpe > pr * 1.2 THEN 'ic_understates' WHEN sharpe < pr * 0.5 THEN 'ic_overstates' WHEN sharpe < pr * 0.8 THEN 'ic_mildly_overstates' ELSE 'consistent' END AS verdict FROM p""",
)
def ic_vs_return(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir, labels={"label": 1})
    df = settle(df)
    members = settle(ic.frame_top_members(df, FOUR, keep=["label"], wide=wide))
    book = performance.top_book(tree.long_form(df, FOUR, ["label"]), wide=wide, members=members)
    s = ic.frame_rank_ic(df, FOUR, ic.Convention(horizon=1), wide=wide).join(book, "factor_id")
    return show(performance.ic_vs_return(s), ["factor_id", "verdict"], ["predicted_sharpe", "correlation_bias", "ic_inefficiency"])


ORDERS = """tg AS (SELECT asset, close AS price, 1.0 / count(*) OVER () AS weight FROM panel WHERE date = (SELECT max(date) FROM panel)),
hd AS (SELECT asset, CAST(sum(volume) AS BIGINT) AS quantity FROM panel GROUP BY 1),
df AS (SELECT asset, CAST(floor(coalesce(weight, 0) * 1e9 / (price * 100)) AS BIGINT) - coalesce(quantity, 0) AS d FROM tg LEFT JOIN hd USING (asset) WHERE price > 0)"""


@query("b_target_orders", f"WITH {PANEL_SQL}, {ORDERS} SELECT asset, CASE WHEN d > 0 THEN 'buy' ELSE 'sell' END AS side, abs(d) AS quantity FROM df WHERE d <> 0")
def target_orders(spark, sf_dir):
    p = weekly_panel(spark, sf_dir)
    last = p.join(F.broadcast(p.agg(F.max("date").alias("date"))), "date", "left_semi")
    n = last.agg(F.count(F.lit(1)).alias("n"))
    targets = beside(last, n).select("asset", (1.0 / F.col("n")).alias("weight"))
    held = p.groupBy("asset").agg(F.sum("volume").cast("bigint").alias("quantity"))
    return portfolio.target_orders(targets, held, last.select("asset", F.col("close").alias("price")), 1e9)


# Four factors by their share of IC, added up; their panel, the nav of a momentum book.
COMBINED = f"""{long_factors().replace(PANEL_SQL + ',', '', 1)}, {ic_daily('facs')},
wi AS (SELECT factor_id, greatest(avg(rank_ic), 0.001) AS v FROM daily GROUP BY 1), wt AS (SELECT factor_id, round(v / sum(v) OVER (), 4) AS w FROM wi),
cb AS (SELECT any_value(industry) AS industry, sum(coalesce(factor_value, 0) * w) AS combined FROM facs JOIN wt USING (factor_id) GROUP BY date, asset)"""
RISK_SCORE = """cp AS (SELECT quantile_cont(market_cap, 0.1) AS c FROM panel),
i AS (SELECT max(abs(m)) AS mi FROM (SELECT avg(combined) AS m FROM cb GROUP BY industry)),
l AS (SELECT count(*) FILTER (WHERE market_cap < (SELECT c FROM cp)) AS thin, avg(volume * close) AS mv FROM panel),
nn AS (SELECT product(1 + period_return) OVER (ORDER BY date) AS nav, date FROM nr), dx AS (SELECT abs(min(d)) AS md FROM (SELECT nav / max(nav) OVER (ORDER BY date) - 1 AS d FROM nn)),
s AS (SELECT (SELECT count(*) FROM wt WHERE w > 0.15) AS h, mi, thin, mv, md FROM i, l, dx),
z AS (SELECT *, least(1.0, 0.15 * h + CASE WHEN mi > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN thin > 0 THEN 0.05 ELSE 0 END + CASE WHEN mv < 1e6 THEN 0.1 ELSE 0 END + CASE WHEN md > 0.15 THEN 0.3 ELSE 0 END) AS sc FROM s)"""


def risk_report(spark, sf_dir):
    return risk_of(spark, sf_dir, *risk_frame(spark, sf_dir))


def risk_frame(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir, fields=("industry", "market_cap", "volume", "close"))
    return settle(df), wide


def risk_of(spark, sf_dir, df, wide):
    weights = settle(combine.weigh(ic.frame_rank_ic(df, FOUR, wide=wide)).select("factor_id", "weight"))
    shares = {r["factor_id"]: r["weight"] for r in weights.collect()}  # one number for each factor column
    nav = portfolio.factor_nav(settle(factor_panel(spark, sf_dir)[0]), 50, wide)
    return portfolio.risk_check(weights, combine.weighted_combine(df, shares), nav, wide=True)


@query(
    "b_risk_check",
    f"""WITH {NAV}, {COMBINED}, {RISK_SCORE}
SELECT h AS heavy_factors, thin AS thin_rows, CASE WHEN sc > 0.5 THEN 'suspend' WHEN sc > 0.25 THEN 'reduce' ELSE 'approve' END AS recommendation,
 {r6('mi', 'max_industry_exposure')}, {r6('md', 'max_drawdown', 5)}, {r6('sc', 'risk_score')} FROM z""",
)
def risk_check(spark, sf_dir):
    return show(risk_report(spark, sf_dir), ["heavy_factors", "thin_rows", "recommendation"], ["max_industry_exposure", "risk_score"], other={"max_drawdown": 5})


# -- delivery screening and report flags -----------------------------------------------------------


def screened(spark, sf_dir):
    labels = {"label": 1, "l20": 20}
    df, wide = factor_frame(spark, sf_dir, fields=("market_cap", "industry", "volume"), labels=labels)
    df = settle(df)
    members = settle(ic.frame_top_members(df, FOUR, keep=["label"], wide=wide))
    long = tree.long_form(df, FOUR, [*labels, "market_cap", "industry", "volume"])
    overlap = combine.crowding_scores(gram.pair_corr(df, FOUR)).select("factor_id", "max_corr")
    how = ic.DECAY
    scored = ic.batch_rank_ic(long, how, wide=wide)
    far = ic.frame_rank_ic(df, FOUR, how, label="l20", wide=wide).select("factor_id", F.col("ic_mean").alias("ic_20"))
    turn = ic.member_turnover(members).groupBy("factor_id").agg(F.avg("turnover").alias("turnover"))
    cap = long.groupBy("factor_id").agg(F.avg("volume").alias("_v"))
    cap = cap.select("factor_id", portfolio.capacity("_v")["daily_capacity"].alias("capacity"))
    d = scored
    straight = ic.batch_rank_ic(long, dataclasses.replace(how, ranked=False), wide=wide).select("factor_id", F.col("positive_ratio").alias("_pos"))
    near_far = ic.pooled_corr(long, {1: "label", 20: "l20"})
    for side in (far, turn, ic.exposure(long), cap, overlap, straight, near_far, performance.top_book(long, wide=wide, members=members)):
        d = d.join(side, "factor_id")
    return d.withColumns(
        {
            "ic_1": F.col("ic_mean"),
            "decay_ratio": F.when(F.abs("ic_mean") > 0.001, F.abs("ic_20") / F.abs("ic_mean")).otherwise(0.0),
            "stability_score": scorecard.stability(F.col("_pos"), F.col("positive_ratio"), F.col("corr_1"), F.col("corr_20")),
        }
    )


LABELS = f", lead(close, 1) OVER ({A}) / close - 1 AS lab, lead(close, 20) OVER ({A}) / close - 1 AS l20"
CAPX = "CASE WHEN factor_value IS NOT NULL THEN ln(greatest(market_cap, 1.0)) END"
SCREEN = f"""{long_factors(LABELS, ', lab, l20')}, {ic_daily('facs', 5, 'lab', out='d1')}, {ic_daily('facs', 5, 'l20', out='d20')}, {TURN},
a1 AS (SELECT factor_id, avg(rank_ic) AS ic, coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0) AS ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS pos FROM d1 GROUP BY 1),
a20 AS (SELECT factor_id, avg(rank_ic) AS ic20 FROM d20 GROUP BY 1),
ex AS (SELECT factor_id, abs(covar_pop(factor_value, {CAPX}) / nullif(stddev_pop(factor_value) * stddev_pop({CAPX}), 0)) AS ce, avg(volume) * 20 * 0.05 * 50 AS cap FROM facs GROUP BY 1),
{ic_daily('facs', 5, 'lab', ranked=False, out='p1')}, ap AS (SELECT factor_id, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS lpos FROM p1 GROUP BY 1),
hc AS (SELECT factor_id, {', '.join(f"coalesce({corr(f'CASE WHEN {l} IS NOT NULL THEN factor_value END', f'CASE WHEN factor_value IS NOT NULL THEN {l} END')}, 0) AS h_{l}" for l in ('lab', 'l20'))} FROM facs GROUP BY 1),
{pairs_of_four()}, {OVERLAP},
sb AS (SELECT *, CASE WHEN abs(ic) > 0.001 THEN abs(ic20) / abs(ic) ELSE 0 END AS dr,
   least(greatest(0.45 * lpos + 0.35 * pos + 0.2 * greatest(CASE WHEN h_lab <> 0 THEN least(greatest(h_l20 / h_lab, -1.0), 1.0) ELSE 0 END, 0.0), 0.0), 1.0) AS stab
  FROM a1 JOIN a20 USING (factor_id) JOIN tn USING (factor_id) JOIN ex USING (factor_id) JOIN ap USING (factor_id) JOIN hc USING (factor_id) JOIN mc USING (factor_id) JOIN bk USING (factor_id)),
sc AS (SELECT * REPLACE (CASE WHEN pos = 0 THEN least(1.0, 0.5 + stab * 0.3) ELSE pos END AS pos), pos AS raw_pos FROM sb)"""


def listed_sql(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda v: v IS NOT NULL), ',')"


FAILS = listed_sql(
    ("abs(ir) < 1.0", "icir"), ("abs(ic) < 0.02", "rank_ic"), ("pos < 0.55", "positive_ratio"), ("max_corr > 0.3", "library_corr"), ("turnover > 0.5", "turnover"),
    ("ce > 0.3", "cap_exposure"), ("cap > 0 AND cap < 5000000", "capacity"), ("dr > 0 AND dr < 0.3", "decay"),
)


@query(
    "m_delivery_screen",
    f"""WITH {SCREEN}, x AS (SELECT *, {FAILS} AS fail_reasons FROM sc) SELECT factor_id, fail_reasons, CAST(fail_reasons = '' AS INT) AS deliverable,
 {r6('ic', 'ic_mean')}, {r6('dr', 'decay_ratio', 4)}, {r6('turnover', 'turnover')}, {r6('max_corr', 'max_corr')}, {r6('stab', 'stability_score')} FROM x""",
)
def delivery_screen(spark, sf_dir):
    d = health.delivery_screen(screened(spark, sf_dir)).withColumn("deliverable", F.col("deliverable").cast("int"))
    return show(d, ["factor_id", "fail_reasons", "deliverable"], ["ic_mean", "turnover", "max_corr", "stability_score"], other={"decay_ratio": 4})


FLAGS = listed_sql(
    ("ic < 0.02", "weak_ic"), ("ir < 0.3", "low_icir"), ("raw_pos < 0.55", "unstable_sign"), ("abs(ic) > 0.01 AND abs(ic20) < abs(ic) * 0.3", "fast_decay"),
    ("turnover > 0.5", "high_turnover"), ("abs(ce) > 0.3", "size_exposure"), ("cap < 5000000", "small_capacity"), ("net_return < gross_return * 0.5", "cost_erosion"),
)


@query(
    "m_risk_flags",
    f"""WITH {SCREEN}, x AS (SELECT *, {FLAGS} AS fl FROM sc) SELECT factor_id, CASE WHEN fl = '' THEN 'none' ELSE fl END AS risk_flags,
 CASE WHEN abs(ic) > 0.05 THEN 'strong' WHEN abs(ic) > 0.02 THEN 'medium' ELSE 'weak' END AS ic_strength,
 CASE WHEN abs(ir) > 2 THEN 'excellent' WHEN abs(ir) > 1 THEN 'good' WHEN abs(ir) > 0.5 THEN 'fair' ELSE 'low' END AS icir_strength,
 {listed_sql(('abs(ic) > 0.03', 'ic'), ('abs(ir) > 1.0', 'icir'), ('sharpe > 1.0', 'sharpe'))} AS strengths, {r6('sharpe', 'sharpe', 4)} FROM x""",
)
def risk_flags(spark, sf_dir):
    return show(health.risk_flags(screened(spark, sf_dir)), ["factor_id", "risk_flags", "ic_strength", "icir_strength", "strengths"], ["sharpe"], 4)


@query(
    "m_governance_severity",
    f"""WITH {NAV}, {COMBINED}, {pairs_of_four()}, {RISK_SCORE},
w AS (SELECT count(*) FILTER (WHERE c > 0.1) AS n FROM (SELECT f, avg(abs(corr)) AS c FROM (SELECT f1 AS f, corr FROM pairs UNION ALL SELECT f2, corr FROM pairs) GROUP BY 1))
SELECT n AS crowded_factors, CASE WHEN n > 5 THEN 'high' WHEN n > 2 THEN 'moderate' ELSE 'low' END AS crowding_severity,
 CASE WHEN sc > 0.7 THEN 'high' WHEN sc > 0.4 THEN 'moderate' ELSE 'low' END AS risk_level FROM w, z""",
)
def governance(spark, sf_dir):
    df, wide = risk_frame(spark, sf_dir)
    crowded = combine.crowding_scores(gram.pair_corr(df, FOUR), 0.1).agg(F.count_if("crowded").alias("crowded_factors"))
    d = beside(crowded, risk_of(spark, sf_dir, df, wide).select("risk_score"))
    crowd, risk = health.governance_severity(F.col("crowded_factors"), F.col("risk_score"))
    return d.select("crowded_factors", crowd.alias("crowding_severity"), risk.alias("risk_level"))


# -- signals -----------------------------------------------------------------------------------------

MA = f"""ma AS (SELECT asset, date, close, avg(close) OVER ({A} ROWS 4 PRECEDING) AS s, avg(close) OVER ({A} ROWS 19 PRECEDING) AS l FROM panel),
mp AS (SELECT *, lag(s) OVER ({A}) AS ps, lag(l) OVER ({A}) AS pl FROM ma),
sg AS (SELECT asset, date, close, CASE WHEN s < l AND ps >= pl THEN -1 WHEN s > l AND ps <= pl THEN 1 ELSE 0 END AS signal FROM mp)"""


@query("b_ma_cross_signal", f"WITH {PANEL_SQL}, {MA} SELECT CAST(date AS VARCHAR) AS date, asset, signal FROM sg")
def ma_signal(spark, sf_dir):
    d = signals.ma_cross(weekly_panel(spark, sf_dir), 5, 20)
    return d.select(F.col("date").cast("string").alias("date"), "asset", "signal")


CHANNEL = f"""cb AS (SELECT asset, date, close, CASE WHEN count(*) OVER u = 10 THEN max(close) OVER u END AS hi, CASE WHEN count(*) OVER d = 20 THEN min(close) OVER d END AS lo
  FROM panel WINDOW u AS ({A} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), d AS ({A} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
sg AS (SELECT asset, date, close, CASE WHEN close < lo THEN -1 WHEN close > hi THEN 1 ELSE 0 END AS signal FROM cb)"""


@query("b_channel_breakout_signal", f"WITH {PANEL_SQL}, {CHANNEL} SELECT CAST(date AS VARCHAR) AS date, asset, signal FROM sg")
def channel_signal(spark, sf_dir):
    d = signals.channel_breakout(weekly_panel(spark, sf_dir), 10, 20)
    return d.select(F.col("date").cast("string").alias("date"), "asset", "signal")


@query(
    "v_trend_features",
    f"""WITH {PANEL_SQL}, r AS (SELECT *, avg(close) OVER ({A} ROWS 59 PRECEDING) AS trend_ma, coalesce(close / lag(close) OVER ({A}) - 1, 0) AS returns FROM panel)
SELECT CAST(date AS VARCHAR) AS date, asset, CASE WHEN close > trend_ma THEN 'uptrend' ELSE 'downtrend' END AS trend_state, {r6('trend_ma', 'trend_ma', 4)}, {r6('returns', 'returns', 4)},
 {r6(f'coalesce(stddev_samp(returns) OVER ({A} ROWS 19 PRECEDING), 0)', 'volatility', 4)} FROM r""",
)
def trend(spark, sf_dir):
    return show(trend_features(weekly_panel(spark, sf_dir)), ["date", "asset", "trend_state"], ["trend_ma", "returns", "volatility"], 4)


HELD = f"""ps AS (SELECT *, CASE WHEN last_value(nullif(signal, 0) IGNORE NULLS) OVER ({A}) = 1 THEN 1 ELSE 0 END AS position FROM sg),
pb AS (SELECT *, coalesce(lag(position) OVER ({A}), 0) AS b, coalesce(close / lag(close) OVER ({A}), 1) AS mv, first_value(close) OVER ({A}) AS base FROM ps),
gr AS (SELECT *, CASE WHEN b = 1 THEN mv ELSE 1 END * CASE WHEN position = 1 AND b = 0 THEN 1 / 1.0005 ELSE 1 END * CASE WHEN position = 0 AND b = 1 THEN 0.9995 ELSE 1 END AS g FROM pb),
eq AS (SELECT *, exp(sum(ln(g)) OVER ({A})) AS equity, sum(CASE WHEN position = 1 AND b = 0 THEN 1 ELSE 0 END) OVER ({A}) AS no FROM gr),
er AS (SELECT *, coalesce(equity / lag(equity) OVER ({A}) - 1, 0) AS dr, equity / max(equity) OVER ({A}) - 1 AS dd FROM eq),
wn AS (SELECT asset, avg(CASE WHEN o IS NOT NULL THEN CASE WHEN o > i THEN 1.0 ELSE 0 END END) AS win_rate FROM
  (SELECT asset, no, max(CASE WHEN position = 1 AND b = 0 THEN close END) AS i, max(CASE WHEN position = 0 AND b = 1 THEN close END) AS o FROM er WHERE position <> b GROUP BY 1, 2) GROUP BY 1),
mt AS (SELECT asset, count(*) AS rows, arg_max(equity, date) - 1 AS total_return, arg_max(close / base - 1, date) AS benchmark_return, min(dd) AS max_drawdown,
  coalesce(avg(dr) / nullif(stddev_samp(dr), 0) * sqrt(252), 0) AS sharpe, count(*) FILTER (WHERE position <> b) AS trade_count FROM er GROUP BY 1)"""
METRICS = ["total_return", "benchmark_return", "excess_return", "max_drawdown", "sharpe", "annual_return", "win_rate"]


@query(
    "b_signal_returns",
    f"""WITH {PANEL_SQL}, {MA}, {HELD} SELECT asset, rows, trade_count, {r6('total_return', 'total_return', 4)}, {r6('benchmark_return', 'benchmark_return', 4)}, {r6('total_return - benchmark_return', 'excess_return', 4)},
 {r6('max_drawdown', 'max_drawdown', 4)}, {r6('sharpe', 'sharpe', 4)}, {r6('pow(1 + total_return, 252.0 / rows) - 1', 'annual_return', 4)}, {r6('coalesce(win_rate, 0)', 'win_rate', 4)} FROM mt LEFT JOIN wn USING (asset)""",
)
def signal_returns(spark, sf_dir):
    held = signals.positions(signals.ma_cross(weekly_panel(spark, sf_dir).select("date", "asset", "close"), 5, 20))
    return show(signals.signal_metrics(held), ["asset", "rows", "trade_count"], METRICS, 4)


COMBOS = signals.grid([3, 5], [10, 20])


# Both strategies, their windows, with and without the trend and volatility filters.
SWEPT = {"ma_cross": COMBOS, "channel_breakout": signals.grid([5, 10], [10, 20]) + [(10, 10)]}
CALM = 0.35
SPANS = sorted({k for pairs in SWEPT.values() for pair in pairs for k in pair})
GRID_KEYS = "asset, strategy, short, long, filters"
FEATURES = f"""tr AS (SELECT asset, date, close, avg(close) OVER ({A} ROWS 59 PRECEDING) AS trend_ma, coalesce(close / lag(close) OVER ({A}) - 1, 0) AS ret,
  {', '.join(f"avg(close) OVER ({A} ROWS {k - 1} PRECEDING) AS m{k}, CASE WHEN count(*) OVER ({A} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN max(close) OVER ({A} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS u{k}, CASE WHEN count(*) OVER ({A} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN min(close) OVER ({A} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS d{k}" for k in SPANS)} FROM panel),
ft AS (SELECT *, coalesce(stddev_samp(ret) OVER ({A} ROWS 19 PRECEDING), 0) AS vol, {', '.join(f'lag(m{k}) OVER ({A}) AS p{k}' for k in SPANS)} FROM tr)"""


def signal_sql(name: str, s: int, l: int, filters: str) -> str:
    trend, vol = signals.FILTERS[filters]
    buy, sell = (f"m{s} > m{l} AND p{s} <= p{l}", f"m{s} < m{l} AND p{s} >= p{l}") if name == "ma_cross" else (f"close > u{s}", f"close < d{l}")
    buy += (" AND close > trend_ma" if trend else "") + (f" AND vol <= {CALM}" if vol else "")
    return f"SELECT asset, date, close, '{name}' AS strategy, {s} AS short, {l} AS long, '{filters}' AS filters, CASE WHEN {sell} THEN -1 WHEN {buy} THEN 1 ELSE 0 END AS signal FROM ft"


GRID_SIGNALS = f"{FEATURES}, sg AS ({' UNION ALL '.join(signal_sql(n, s, l, f) for n, pairs in SWEPT.items() for s, l in pairs for f in signals.FILTERS)})"
GRID_HELD = HELD.replace(A, f"PARTITION BY {GRID_KEYS} ORDER BY date").replace("SELECT asset,", f"SELECT {GRID_KEYS},").replace("GROUP BY 1, 2", "GROUP BY ALL").replace("GROUP BY 1", "GROUP BY ALL")


@query(
    "o_strategy_grid",
    f"""WITH {PANEL_SQL}, {GRID_SIGNALS}, {GRID_HELD}, ar AS (SELECT *, pow(1 + total_return, 252.0 / rows) - 1 AS annual_return FROM mt)
SELECT {GRID_KEYS}, trade_count, CAST(row_number() OVER (PARTITION BY asset ORDER BY round(annual_return, 7) DESC, round(sharpe, 7) DESC, strategy, short, long, filters) AS INTEGER) AS place,
 {r6('total_return', 'total_return', 4)}, {r6('max_drawdown', 'max_drawdown', 4)}, {r6('sharpe', 'sharpe', 4)} FROM ar""",
)
def strategy_grid(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).select("date", "asset", "close")
    by = GRID_KEYS.split(", ")
    m = signals.grid_metrics(*signals.strategy_signals(p, SWEPT, CALM))
    place = Window.partitionBy("asset").orderBy(F.round("annual_return", 7).desc(), F.round("sharpe", 7).desc(), *by[1:])
    return show(m.withColumn("place", F.row_number().over(place)), [*by, "trade_count", "place"], ["total_return", "max_drawdown", "sharpe"], 4)


def _filtered_signal(name: str, strategy: str, s: int, l: int) -> None:
    @query(name, f"WITH {PANEL_SQL}, {FEATURES}, sg AS ({signal_sql(strategy, s, l, 'both')}) SELECT CAST(date AS VARCHAR) AS date, asset, signal FROM sg")
    def run(spark, sf_dir):
        make = {"ma_cross": signals.ma_cross, "channel_breakout": signals.channel_breakout}[strategy]
        d = make(weekly_panel(spark, sf_dir), s, l, trend=True, max_volatility=CALM)
        return d.select(F.col("date").cast("string").alias("date"), "asset", "signal")


_filtered_signal("b_ma_cross_filtered", "ma_cross", 5, 20)
_filtered_signal("b_channel_filtered", "channel_breakout", 10, 20)


@query(
    "t_leaderboard",
    f"""WITH {PANEL_SQL}, {MA}, {HELD} SELECT asset, {r6('total_return', 'total_return', 4)}, {r6('sharpe', 'sharpe', 4)} FROM mt
ORDER BY pow(1 + total_return, 252.0 / rows) - 1 DESC, mt.sharpe DESC, asset LIMIT 10""",
)
def leaderboard(spark, sf_dir):
    held = signals.positions(signals.ma_cross(weekly_panel(spark, sf_dir).select("date", "asset", "close"), 5, 20))
    return show(signals.leaderboard(signals.signal_metrics(held), ["asset"], 10), ["asset"], ["total_return", "sharpe"], 4)


def market_series(spark, sf_dir):
    return performance.equal_weight_nav(weekly_panel(spark, sf_dir))


def strategy_study(spark, sf_dir):
    """Grid, walk-forward and research results of both strategies on the equal-weight market."""
    p = market_series(spark, sf_dir)
    rows = None
    for name in signals.GRIDS:
        by = ["asset", "short", "long"]
        full = signals.signal_metrics(signals.positions(signals.GRIDS[name](p, COMBOS), by), by)
        best = full.agg(
            F.max_by("sharpe", F.struct("annual_return", "sharpe")).alias("grid_best_sharpe"),
            F.max_by("realized_volatility", F.struct("annual_return", "sharpe")).alias("realized_volatility"),
        )
        folds = signals.walk_forward(p, name, COMBOS, (5, 20), 120, 40, 40)
        study = oos.research_score(oos.stability_score(folds, ["short", "long"]))
        one = study.withColumn("_one", F.lit(1)).join(best.withColumn("_one", F.lit(1)), "_one").drop("_one")
        one = one.select(
            F.lit(name).alias("strategy"), "grid_best_sharpe", "realized_volatility", F.col("avg_test_sharpe").alias("test_sharpe"),
            F.col("avg_test_max_drawdown").alias("max_drawdown"), "research_score", "stability_score", "stability_label", "research_label",
        )
        rows = one if rows is None else rows.unionByName(one)
    return p, settle(rows)


@query("o_walk_forward_stability")
def walk_forward_stability(spark, sf_dir):
    folds = signals.walk_forward(market_series(spark, sf_dir), "ma_cross", COMBOS, (5, 20), 120, 40, 40)
    out = oos.research_score(oos.stability_score(folds, ["short", "long"]))
    return show(out, ["stability_label", "research_label", "parameter_regime_count"], ["stability_score", "research_score", "positive_test_ratio"], 4)


@query("o_strategy_compare")
def strategy_compare(spark, sf_dir):
    _, rows = strategy_study(spark, sf_dir)
    return show(signals.compare(rows), ["strategy"], ["composite_score", "research_score", "stability_score"], 4)


@query("b_constrained_weights")
def constrained(spark, sf_dir):
    p, rows = strategy_study(spark, sf_dir)
    held = signals.positions(signals.ma_cross(p, 5, 20)).withColumn("strategy", F.lit("ma_cross"))
    held = held.unionByName(signals.positions(signals.channel_breakout(p, 10, 20)).withColumn("strategy", F.lit("channel_breakout")))
    pairs = signals.strategy_correlation(held, sorted(signals.GRIDS))
    out = signals.constrained_weights(signals.compare(rows), pairs)
    return show(out, ["strategy"], ["weight", "portfolio_volatility", "diversification_score"], 4)


@query(
    "b_strategy_correlation",
    f"""WITH {PANEL_SQL}, {MA}, {HELD}, s1 AS (SELECT date, avg(dr) AS a FROM er GROUP BY 1), s2 AS (SELECT date, avg(CASE WHEN b = 0 THEN dr ELSE mv - 1 END) AS b FROM er GROUP BY 1)
SELECT 'ma' AS s1, 'raw' AS s2, {r6('covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b))', 'corr')} FROM s1 JOIN s2 USING (date)""",
)
def strategy_corr(spark, sf_dir):
    held = signals.positions(signals.ma_cross(weekly_panel(spark, sf_dir).select("date", "asset", "close"), 5, 20))
    w = Window.partitionBy("asset").orderBy("date")
    move = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)), F.lit(1.0)) - 1
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    held = held.withColumn("raw", F.when(before == 0, F.col("daily_return")).otherwise(move))
    a = held.groupBy("date").agg(F.avg("daily_return").alias("daily_return")).withColumn("strategy", F.lit("ma"))
    b = held.groupBy("date").agg(F.avg("raw").alias("daily_return")).withColumn("strategy", F.lit("raw"))
    return show(signals.strategy_correlation(a.unionByName(b), ["ma", "raw"]), ["s1", "s2"], ["corr"])
