"""Factor evaluation: IC family, quantiles, turnover, exposure, scorecard, named factors, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import NUDGE, query, r6, show
from .dsl import A, steady
from .sqlkit import FOUR, corr, ic_daily, ic_stats, long_factors, named_factors, pairs_of_four, t_tail, wide_factors
from .sqlkit import t_tail as tail_sql
from ..functions.stats import t_two_sided_p
from ..operators import combine, gram, hypothesis, ic, scorecard
from ..operators.ordered import beside
from ..operators.ts import forward_return, pct_change
from ..plans import dense, tree
from ..plans.factors import EQUITY, NAMED
from ..session import settle
from ..sources.adapters import PANEL_SQL, date_is_wide, weekly_panel

EXTRA = {"label", "l1", "l5", "l10", "l20", "l40", "l60"}


def factor_frame(spark, sf_dir, names=FOUR, fields=(), labels=None, ordinal=False):
    """The panel's keys, labels and ``fields`` with one column per factor and forward-return columns; and whether dates are wide."""
    trees = {k: NAMED[k] for k in names}
    if ordinal:
        trees = {k: tree.order_core(t) for k, t in trees.items()}
    need = sorted({f for t in trees.values() for f in tree.required_fields(t)} | set(fields))
    labels = labels or {"label": 5}
    p = weekly_panel(spark, sf_dir, need).withColumns({c: forward_return(h) for c, h in labels.items()})
    wide = date_is_wide(spark, sf_dir)
    return tree.evaluate(p, trees, wide=wide, keep=["date", "asset", *labels, *fields]), wide


def factor_long(spark, sf_dir, names=FOUR, fields=(), labels=None, ordinal=False):
    labels = labels or {"label": 5}
    df, wide = factor_frame(spark, sf_dir, names, fields, labels, ordinal)
    return tree.long_form(df, names, [*labels, *fields]), wide


def tree_scores(spark, sf_dir, panel, trees, how=ic.STANDARD, horizon: int = 5):
    """``ic.frame_scores`` of trees over a panel; their columns never travel while dates fit a task."""
    wide = date_is_wide(spark, sf_dir)
    if not wide and how.ranked and dense.supports(trees):
        return ic.counted(dense.scores(panel, trees, {"label": horizon}).drop("label"), how)
    df = tree.evaluate(panel.withColumn("label", forward_return(horizon)), trees, wide=wide, keep=["date", "asset", "label"])
    return ic.frame_scores(df, list(trees), how, wide=wide)


def named_scores(spark, sf_dir, how=ic.STANDARD, horizon: int = 5):
    """``date_scores`` of all named factors."""
    trees = {k: tree.order_core(t) for k, t in NAMED.items()}
    return tree_scores(spark, sf_dir, weekly_panel(spark, sf_dir, fields_of(trees)), trees, how, horizon)


def fields_of(trees) -> list[str]:
    return sorted({f for t in trees.values() for f in tree.required_fields(t)})


def named_pairs(spark, sf_dir):
    """``gram.pair_corr`` of all named factors; their columns never travel while dates fit a task."""
    if date_is_wide(spark, sf_dir):
        return gram.pair_corr(factor_frame(spark, sf_dir, list(NAMED))[0], list(NAMED))
    return gram.corr_of(gram.whole_moments(dense.states(weekly_panel(spark, sf_dir, fields_of(NAMED)), NAMED)))


def flagship(spark, sf_dir, min_n: int = 20, digits: int = 4):
    """All named factors scored by rank IC in one job."""
    how = ic.Convention(min_n=min_n)
    scored = ic.factor_scores(named_scores(spark, sf_dir, how), how)
    return show(scored, ["factor_id", "n_dates"], ["ic_mean", "ic_ir"], digits, {"coverage": 4})


STATS = ["ic_mean", "ic_std", "ic_ir", "positive_ratio"]


def stats_sql(daily: str = "daily", extra: str = "", keys: str = "factor_id") -> str:
    cols = ", ".join(r6(c, c) for c in STATS)
    return f"SELECT {keys}, n_dates, {cols}{extra} FROM s"


IC_SQL = f"""WITH {long_factors()}, {ic_daily('facs')},
s AS (SELECT factor_id, {ic_stats()} FROM daily GROUP BY factor_id),
c AS (SELECT factor_id, count(factor_value) / count(*) AS coverage FROM facs GROUP BY factor_id)
SELECT s.factor_id, n_dates, {', '.join(r6(c, c) for c in STATS)}, {r6('coverage', 'coverage')} FROM s JOIN c USING (factor_id)"""


@query("i_batch_rank_ic", IC_SQL)
def batch_rank_ic(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(ic.batch_rank_ic(long, wide=wide), ["factor_id", "n_dates"], [*STATS, "coverage"])


@query(
    "i_evaluate_named",
    f"""WITH {named_factors(NAMED, f'lead(close, 5) OVER ({A}) / close - 1')}, {ic_daily('facs')},
s AS (SELECT factor_id, {ic_stats()} FROM daily GROUP BY 1), c AS (SELECT factor_id, count(factor_value) / count(*) AS coverage FROM facs GROUP BY 1)
SELECT factor_id, n_dates, {r6('ic_mean', 'ic_mean', 3)}, {r6('ic_ir', 'ic_ir', 3)}, {r6('coverage', 'coverage', 4)} FROM s JOIN c USING (factor_id)""",
)
def evaluate_named(spark, sf_dir):
    return flagship(spark, sf_dir, digits=3)


@query(
    "i_named_factors_ic",
    f"""WITH {named_factors(NAMED, f'lead(close, 5) OVER ({A}) / close - 1')}, {ic_daily('facs')},
s AS (SELECT factor_id, count(*) AS n_dates, avg(rank_ic) AS ic_mean FROM daily GROUP BY 1), c AS (SELECT factor_id, count(factor_value) / count(*) AS coverage FROM facs GROUP BY 1)
SELECT factor_id, n_dates, {r6('ic_mean', 'ic_mean', 3)}, {r6('coverage', 'coverage', 4)} FROM s JOIN c USING (factor_id)""",
)
def named_factors_ic(spark, sf_dir):
    scored = ic.factor_scores(named_scores(spark, sf_dir))
    share = F.round(F.col("coverage") + NUDGE * 1e-4, 4).alias("coverage")
    return show(scored.withColumn("coverage", share), ["factor_id", "n_dates", "coverage"], ["ic_mean"], 3)


@query(
    "i_rank_ic_single",
    f"""WITH {PANEL_SQL}, facs AS (SELECT 'f' AS factor_id, date, asset, close - lag(close, 5) OVER ({A}) AS factor_value,
  lead(close, 5) OVER ({A}) / close - 1 AS label FROM panel), {ic_daily('facs')},
s AS (SELECT {ic_stats()} FROM daily), c AS (SELECT count(factor_value) / count(*) AS coverage FROM facs)
SELECT {r6('ic_mean', 'ic_mean', 4)}, {r6('ic_ir', 'ic_ir', 4)}, {r6('coverage', 'coverage', 4)} FROM s, c""",
)
def rank_ic_single(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir, ["Momentum_1m"], ordinal=True)
    return show(ic.batch_rank_ic(long, wide=wide), [], ["ic_mean", "ic_ir", "coverage"], 4)


@query(
    "i_ic_sequence",
    f"""WITH {long_factors()}, {ic_daily('facs')}
SELECT factor_id, CAST(date AS VARCHAR) AS date, n, {r6('rank_ic', 'rank_ic')} FROM daily""",
)
def ic_sequence(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(ic.daily_ic(long, wide=wide), ["factor_id", "date", "n"], ["rank_ic"])


def _preset(name: str, how: ic.Convention) -> None:
    label = f", lead(close, {how.horizon}) OVER ({A}) / close - 1 AS lab"
    std = "stddev_samp" if how.sample_std else "stddev_pop"
    daily = ic_daily("facs", how.min_n, "lab", ranked=how.ranked, zero=how.zero_degenerate)

    @query(name, f"WITH {long_factors(label, ', lab')}, {daily}, s AS (SELECT factor_id, {ic_stats(std)} FROM daily GROUP BY factor_id) {stats_sql()}")
    def run(spark, sf_dir):
        long, wide = factor_long(spark, sf_dir, labels={"label": how.horizon})
        return show(ic.batch_rank_ic(long, how, wide=wide), ["factor_id", "n_dates"], STATS)


for _n, _how in {
    "i_decay_monitor_ic": ic.DECAY,
    "i_scorecard_rank_ic": ic.SCORECARD_RANK,
    "i_scorecard_linear_ic": ic.SCORECARD_LINEAR,
    "i_report_ic": ic.REPORT,
}.items():
    _preset(_n, _how)

# Three samples of every factor: complete rows of the last half year (by date), all rows with their gaps (as a whole), one asset's rows (too few).
SAMPLES = """cut AS (SELECT max(date) - INTERVAL 6 MONTH AS cutoff, min(asset) AS one FROM panel),
sm AS (SELECT facs.*, 'complete' AS sample FROM facs, cut WHERE date > cutoff AND factor_value IS NOT NULL AND label IS NOT NULL
  UNION ALL SELECT facs.*, 'gaps' FROM facs UNION ALL SELECT facs.*, 'few' FROM facs, cut WHERE asset = one AND date > cutoff)"""


def whole_sample(c: str) -> str:
    c = steady(c)
    return f"rank() OVER (PARTITION BY factor_id, sample ORDER BY {c}) + (count(*) OVER (PARTITION BY factor_id, sample, {c}) - 1) / 2.0"


@query(
    "i_oos_ic_check",
    f"""WITH {long_factors()}, {SAMPLES}, sz AS (SELECT factor_id, sample, count(*) AS n, count(factor_value + label) AS p FROM sm GROUP BY 1, 2),
v AS (SELECT factor_id, sample, date, factor_value AS x, label AS y FROM sm JOIN sz USING (factor_id, sample) WHERE factor_value IS NOT NULL AND label IS NOT NULL AND p >= 50),
d AS (SELECT v.*, rank() OVER (PARTITION BY factor_id, sample, date ORDER BY {steady('x')}) + (count(*) OVER (PARTITION BY factor_id, sample, date, {steady('x')}) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY factor_id, sample, date ORDER BY {steady('y')}) + (count(*) OVER (PARTITION BY factor_id, sample, date, {steady('y')}) - 1) / 2.0 AS ry
  FROM v JOIN sz USING (factor_id, sample) WHERE n = p),
w AS (SELECT v.*, {whole_sample('x')} AS rx, {whole_sample('y')} AS ry FROM v JOIN sz USING (factor_id, sample) WHERE n > p),
i AS (SELECT * FROM (SELECT factor_id, sample, {corr('rx', 'ry')} AS ic FROM d GROUP BY factor_id, sample, date) WHERE ic IS NOT NULL
  UNION ALL SELECT factor_id, sample, {corr('rx', 'ry')} FROM w GROUP BY 1, 2),
a AS (SELECT factor_id, sample, avg(ic) AS m, avg(ic) / (stddev_samp(ic) + 1e-10) AS r, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS p, count(*) AS k FROM i GROUP BY 1, 2)
SELECT factor_id, sample, coalesce(k, 0) AS oos_n_days, {r6('coalesce(m, 0)', 'oos_rank_ic')}, {r6('coalesce(r, 0)', 'oos_ic_ir')}, {r6('coalesce(a.p, 0)', 'oos_positive_ratio')}
FROM sz LEFT JOIN a USING (factor_id, sample)""",
)
def oos_ic_check(spark, sf_dir):
    df = settle(factor_frame(spark, sf_dir)[0])
    long = tree.long_form(df, FOUR, ["label"])
    cut = df.agg(F.add_months(F.max("date"), -6).alias("_cutoff"), F.min("asset").alias("_lowest"))
    d = beside(long, cut)
    late, pair = F.col("date") > F.col("_cutoff"), F.col("factor_value").isNotNull() & F.col("label").isNotNull()
    kinds = F.array_compact(F.array(F.when(late & pair, "complete"), F.lit("gaps"), F.when((F.col("asset") == F.col("_lowest")) & late, "few")))
    got = ic.sample_check(d.withColumn("sample", F.explode(kinds)), ["factor_id", "sample"])
    return show(got, ["factor_id", "sample", "oos_n_days"], ["oos_rank_ic", "oos_ic_ir", "oos_positive_ratio"])


WINDOWS = [5, 10, 20, 40, 60]
LEADS = "".join(f", lead(close, {h}) OVER ({A}) / close - 1 AS l{h}" for h in [1, 5, 10, 20, 40, 60])
LCOLS = ", l1, l5, l10, l20, l40, l60"
CURVE = ", ".join(ic_daily("facs", 20, f"l{h}", out=f"d{h}") for h in WINDOWS)
CURVE_ROWS = " UNION ALL ".join(
    f"SELECT factor_id, {h} AS horizon, avg(rank_ic) AS ic_mean, count(*) AS n_dates FROM d{h} GROUP BY factor_id" for h in WINDOWS
)


@query(
    "i_ic_decay_curve",
    f"""WITH {long_factors(LEADS, LCOLS)}, {CURVE}, per AS ({CURVE_ROWS}),
b AS (SELECT factor_id, arg_max(horizon, round(abs(ic_mean), 12)) AS best_window, max(abs(ic_mean)) AS peak FROM per GROUP BY factor_id),
h AS (SELECT p.factor_id, min(CASE WHEN peak > 0.001 AND abs(ic_mean) < peak * 0.5 THEN horizon END) AS half_life
  FROM per p JOIN b USING (factor_id) GROUP BY p.factor_id)
SELECT p.factor_id, horizon, n_dates, best_window, coalesce(half_life, 0) AS half_life, {r6('ic_mean', 'ic_mean')}
FROM per p JOIN b USING (factor_id) JOIN h USING (factor_id)""",
)
def decay_curve(spark, sf_dir):
    labels = {f"l{h}": h for h in WINDOWS}
    by_h = {h: c for c, h in labels.items()}
    if date_is_wide(spark, sf_dir):
        out = ic.decay_curve(factor_long(spark, sf_dir, labels=labels)[0], by_h, wide=True)
    else:
        trees = {k: NAMED[k] for k in FOUR}
        scored = ic.counted(dense.scores(weekly_panel(spark, sf_dir, fields_of(trees)), trees, labels), ic.STANDARD)
        horizon = F.substring("label", 2, 9).cast("int").alias("horizon")
        out = ic.curve_of(scored.filter(F.col("rank_ic").isNotNull()).select("factor_id", horizon, "date", "rank_ic"), by_h)
    return show(out, ["factor_id", "horizon", "n_dates", "best_window", "half_life"], ["ic_mean"])


PROFILE = [1, 5, 10, 20]


@query(
    "i_decay_profile",
    f"""WITH {long_factors(LEADS, LCOLS)}, {', '.join(ic_daily('facs', 5, f'l{h}', out=f'd{h}') for h in PROFILE)},
r AS ({' UNION ALL '.join(f"SELECT factor_id, {h} AS horizon, avg(rank_ic) AS ic_mean FROM d{h} GROUP BY factor_id" for h in PROFILE)}),
v AS (SELECT factor_id, {', '.join(f"{corr(f'CASE WHEN l{h} IS NOT NULL THEN factor_value END', f'CASE WHEN factor_value IS NOT NULL THEN l{h} END')} AS c{h}" for h in PROFILE)} FROM facs GROUP BY factor_id)
SELECT factor_id, {', '.join(r6(f'max(CASE WHEN horizon = {h} THEN ic_mean END)', f'ic_{h}') for h in PROFILE)},
{', '.join(r6(f'max(c{h})', f'corr_{h}') for h in PROFILE)} FROM r JOIN v USING (factor_id) GROUP BY factor_id""",
)
def decay_profile(spark, sf_dir):
    labels = {f"l{h}": h for h in PROFILE}
    long, wide = factor_long(spark, sf_dir, labels=labels)
    by_h = {h: c for c, h in labels.items()}
    how = ic.Convention(min_n=5)
    per = ic.ic_by_horizon(long, by_h, how, wide).groupBy("factor_id").agg(
        *[F.avg(F.when(F.col("horizon") == h, F.col("rank_ic"))).alias(f"ic_{h}") for h in PROFILE]
    )
    out = per.join(ic.pooled_corr(long, by_h), "factor_id")
    return show(out, ["factor_id"], [f"{k}_{h}" for h in PROFILE for k in ("ic", "corr")])


EDGES = ", ".join(f"quantile_cont(factor_value, {p}) OVER w AS e{i}" for i, p in enumerate([0, 0.2, 0.4, 0.6, 0.8]))
BUCKET = " + ".join(f"CASE WHEN factor_value > e{i} AND e{i} > e{i - 1} THEN 1 ELSE 0 END" for i in range(1, 5))


@query(
    "i_quantile_returns",
    f"""WITH {long_factors()}, p AS (SELECT * FROM facs WHERE factor_value IS NOT NULL AND label IS NOT NULL),
ok AS (SELECT factor_id, date FROM p GROUP BY 1, 2 HAVING count(DISTINCT factor_value) >= 5),
e AS (SELECT *, {EDGES} FROM p WINDOW w AS (PARTITION BY factor_id, date)),
m AS (SELECT factor_id, date, 1 + {BUCKET} AS b, avg(label) AS r FROM e JOIN ok USING (factor_id, date) GROUP BY ALL),
q AS (SELECT factor_id, date, {', '.join(f'coalesce(max(CASE WHEN b = {i} THEN r END), 0) AS q{i}' for i in range(1, 6))} FROM m GROUP BY 1, 2),
a AS (SELECT factor_id, {', '.join(f'avg(q{i}) AS q{i}' for i in range(1, 6))} FROM q GROUP BY 1)
SELECT factor_id, {', '.join(r6(f'q{i}', f'q{i}') for i in range(1, 6))}, {r6('q5 - q1', 'long_short')},
{r6('(' + ' + '.join(f'CASE WHEN q{i + 1} >= q{i} THEN 1 ELSE 0 END' for i in range(1, 5)) + ') / 4.0', 'monotonicity')} FROM a""",
)
def quantile_returns(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    return show(ic.frame_quantile_returns(df, FOUR, wide=wide), ["factor_id"], [*[f"q{i}" for i in range(1, 6)], "long_short", "monotonicity"])


LONG_SHORT = """ls_v AS (SELECT * FROM facs WHERE factor_value IS NOT NULL AND label IS NOT NULL),
ls_q AS (SELECT *, quantile_cont(factor_value, 0.8) OVER w AS hi, quantile_cont(factor_value, 0.2) OVER w AS lo
  FROM ls_v WINDOW w AS (PARTITION BY factor_id, date)),
ls AS (SELECT factor_id, date, avg(CASE WHEN factor_value >= hi THEN label END) - avg(CASE WHEN factor_value <= lo THEN label END) AS ls_return
  FROM ls_q GROUP BY 1, 2 HAVING count(*) >= 20)"""


@query(
    "i_long_short",
    f"""WITH {long_factors()}, {LONG_SHORT} SELECT factor_id, CAST(date AS VARCHAR) AS date, {r6('ls_return', 'ls_return')} FROM ls""",
)
def long_short(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(ic.long_short(long, wide=wide), ["factor_id", "date"], ["ls_return"])


TURNOVER = """top_r AS (SELECT factor_id, date, asset, row_number() OVER (PARTITION BY factor_id, date ORDER BY factor_value DESC, asset) AS rn,
   count(*) OVER (PARTITION BY factor_id, date) AS n FROM %s WHERE factor_value IS NOT NULL),
top_m AS (SELECT factor_id, date, asset FROM top_r WHERE rn <= greatest(1, floor(n * 0.2))),
top_d AS (SELECT factor_id, date, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS s FROM (SELECT DISTINCT factor_id, date FROM top_m)),
top_h AS (SELECT factor_id, s, asset, date FROM top_m JOIN top_d USING (factor_id, date)),
turn AS (SELECT a.factor_id, a.s, 1 - count(b.asset) / count(*) AS turnover FROM top_h a LEFT JOIN top_h b
   ON a.factor_id = b.factor_id AND a.asset = b.asset AND b.s = a.s + 1
   WHERE EXISTS (SELECT 1 FROM top_d d WHERE d.factor_id = a.factor_id AND d.s = a.s + 1) GROUP BY 1, 2)"""


@query(
    "i_top_bucket_turnover",
    f"""WITH {long_factors()}, {TURNOVER % 'facs'}
SELECT t.factor_id, CAST(d.date AS VARCHAR) AS date, {r6('turnover', 'turnover')} FROM turn t JOIN top_d d ON d.factor_id = t.factor_id AND d.s = t.s + 1""",
)
def top_bucket_turnover(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    return show(ic.member_turnover(settle(ic.frame_top_members(df, FOUR, wide=wide))), ["factor_id", "date"], ["turnover"])


CAP = "CASE WHEN factor_value IS NOT NULL THEN ln(greatest(market_cap, 1.0)) END"
EXPOSURE = f"""ex_c AS (SELECT factor_id, coalesce(abs({corr('factor_value', CAP)}), 0) AS cap_exposure FROM facs GROUP BY 1),
ex_m AS (SELECT factor_id, industry, avg(factor_value) AS m FROM facs GROUP BY 1, 2),
ex_o AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY abs(m) DESC, industry) AS p FROM ex_m WHERE m IS NOT NULL),
ex AS (SELECT factor_id, max(abs(m)) AS industry_exposure, string_agg(industry, ',' ORDER BY p) FILTER (WHERE p <= 3) AS top_industries FROM ex_o GROUP BY 1)"""


@query(
    "i_exposure",
    f"""WITH {long_factors()}, {EXPOSURE}
SELECT factor_id, top_industries, {r6('cap_exposure', 'cap_exposure')}, {r6('industry_exposure', 'industry_exposure')} FROM ex JOIN ex_c USING (factor_id)""",
)
def exposure(spark, sf_dir):
    long, _ = factor_long(spark, sf_dir, fields=("market_cap", "industry"))
    return show(ic.exposure(long), ["factor_id", "top_industries"], ["cap_exposure", "industry_exposure"])


OVERLAP = "mc AS (SELECT f AS factor_id, coalesce(max(abs(corr)), 0) AS max_corr FROM (SELECT f1 AS f, corr FROM pairs UNION ALL SELECT f2, corr FROM pairs) GROUP BY 1)"
SCORE_SQL = f"""WITH {long_factors(LEADS, LCOLS).replace('facs AS (', 'facs_all AS (')}, {pairs_of_four()}, {OVERLAP},
facs AS (SELECT * FROM facs_all WHERE factor_value IS NOT NULL AND label IS NOT NULL),
{ic_daily('facs', 3, ranked=False, zero=True, out='lin')}, {ic_daily('facs', 3, zero=True, out='rk')},
ls1 AS (SELECT factor_id, avg(rank_ic) AS ic_mean, coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0) AS ic_ir, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS pos FROM lin GROUP BY 1),
rs1 AS (SELECT factor_id, avg(rank_ic) AS rank_ic_mean, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0 END) AS rpos FROM rk GROUP BY 1),
ok AS (SELECT factor_id, date FROM facs GROUP BY 1, 2 HAVING count(DISTINCT factor_value) >= 5),
varied AS (SELECT facs.* FROM facs JOIN ok USING (factor_id, date)),
e AS (SELECT *, {EDGES} FROM varied WINDOW w AS (PARTITION BY factor_id, date)),
m AS (SELECT factor_id, date, 1 + {BUCKET} AS b, avg(label) AS r FROM e GROUP BY ALL),
q AS (SELECT factor_id, date, {', '.join(f'coalesce(max(CASE WHEN b = {i} THEN r END), 0) AS q{i}' for i in range(1, 6))} FROM m GROUP BY 1, 2),
a AS (SELECT factor_id, {', '.join(f'avg(q{i}) AS q{i}' for i in range(1, 6))} FROM q GROUP BY 1),
mono AS (SELECT factor_id, q5 - q1 AS long_short, ({' + '.join(f'CASE WHEN q{i + 1} >= q{i} THEN 1 ELSE 0 END' for i in range(1, 5))}) / 4.0 AS monotonicity FROM a),
{TURNOVER % 'varied'}, tn AS (SELECT factor_id, avg(turnover) AS turnover FROM turn GROUP BY 1),
dc AS (SELECT factor_id, {', '.join(f"coalesce({corr(f'CASE WHEN l{h} IS NOT NULL THEN factor_value END', f'CASE WHEN factor_value IS NOT NULL THEN l{h} END')}, 0) AS corr_{h}" for h in (5, 20))} FROM facs GROUP BY 1),
{EXPOSURE},
sc AS (SELECT *, least(greatest(0.45 * pos + 0.35 * rpos + 0.2 * greatest(CASE WHEN corr_5 <> 0 THEN least(greatest(corr_20 / corr_5, -1.0), 1.0) ELSE 0 END, 0.0), 0.0), 1.0) AS stability_score,
   greatest(0.0, 1.0 - least(turnover, 1.2) / 1.2) AS tradability_score
  FROM ls1 JOIN rs1 USING (factor_id) JOIN mono USING (factor_id) JOIN tn USING (factor_id) JOIN dc USING (factor_id) JOIN ex_c USING (factor_id) JOIN ex USING (factor_id)),
score AS (SELECT *, 1.0 AS coverage, greatest(0, 1 - max_corr) AS originality_score, least(1.0, 0.2 * greatest(ic_mean * 10, 0) + 0.2 * greatest(rank_ic_mean * 10, 0) + 0.15 * greatest(ic_ir, 0) + 0.15 * greatest(monotonicity, 0)
   + 0.1 * stability_score + 0.1 * tradability_score + 0.1 * greatest(0, 1 - max_corr)) AS composite_score FROM sc JOIN mc USING (factor_id))"""
SCORES = ["ic_mean", "rank_ic_mean", "ic_ir", "long_short", "monotonicity", "turnover", "coverage", "corr_5", "corr_20"]
SCORES += ["cap_exposure", "industry_exposure", "stability_score", "tradability_score", "originality_score", "composite_score"]


def scorecards(spark, sf_dir):
    labels = {"label": 5, "l5": 5, "l20": 20}
    df, wide = factor_frame(spark, sf_dir, fields=("market_cap", "industry"), labels=labels)
    df = settle(df)
    long = tree.long_form(df, FOUR, [*labels, "market_cap", "industry"])
    return scorecard.evaluate_metrics(long, {5: "l5", 20: "l20"}, wide=wide, overlap=combine.crowding_scores(gram.pair_corr(df, FOUR)), frame=df)


@query("i_scorecard", f"{SCORE_SQL} SELECT factor_id, {', '.join(r6(c, c, 5) for c in SCORES)} FROM score")
def scorecard_rows(spark, sf_dir):
    return show(scorecards(spark, sf_dir), ["factor_id"], SCORES, 5)


@query(
    "i_decision_checks",
    f"""{SCORE_SQL}, d AS (SELECT *, CASE WHEN coverage < 0.7 THEN 'rejected' WHEN originality_score < 0.45 OR ic_ir < 0.25 OR monotonicity < 0.55 THEN 'observe' ELSE 'approved' END AS decision FROM score),
c AS (SELECT factor_id, 'coverage_check' AS "check", coverage >= 0.7 AS passed FROM d UNION ALL
  SELECT factor_id, 'monotonicity_check', monotonicity >= 0.55 FROM d UNION ALL
  SELECT factor_id, 'decay_profile', true FROM d UNION ALL
  SELECT factor_id, 'neutralization_check', greatest(abs(cap_exposure), abs(industry_exposure)) < 0.35 FROM d)
SELECT factor_id, decision, "check", CAST(passed AS INT) AS passed FROM c JOIN d USING (factor_id)""",
)
def decision_checks(spark, sf_dir):
    scores = scorecards(spark, sf_dir)
    rows = scorecard.checks(scores, [5, 20]).join(scorecard.decide(scores).select("factor_id", "decision"), "factor_id")
    return rows.select("factor_id", "decision", "check", F.col("passed").cast("int").alias("passed"))


VERDICT = """CASE WHEN abs(ic_mean) >= 0.03 AND abs(ic_ir) >= 0.5 AND coverage >= 0.7 THEN 'useful'
  WHEN abs(ic_mean) >= 0.015 THEN 'marginal' ELSE 'useless' END"""
IC_CTE = IC_SQL[: IC_SQL.rindex("SELECT s.factor_id")]


@query("i_test_verdict", f"{IC_CTE} SELECT factor_id, {VERDICT} AS verdict, {r6('ic_mean', 'ic_mean')} FROM s JOIN c USING (factor_id)")
def test_verdict(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(scorecard.verdict(ic.batch_rank_ic(long, wide=wide)), ["factor_id", "verdict"], ["ic_mean"])


@query("j_panel_pair_corr", f"WITH {wide_factors()}, {pairs_of_four()} SELECT f1, f2, n, {r6('corr', 'corr')} FROM pairs")
def panel_pair_corr(spark, sf_dir):
    df, _ = factor_frame(spark, sf_dir)
    return show(gram.pair_corr(df, FOUR), ["f1", "f2", "n"], ["corr"])


@query(
    "i_library_correlation",
    f"""WITH {wide_factors()}, {pairs_of_four()}, b AS (SELECT f1, f2, corr FROM pairs UNION ALL SELECT f2, f1, corr FROM pairs)
SELECT f1 AS factor_id, arg_max(f2, abs(corr)) AS closest, count(*) AS n_compared, {r6('max(abs(corr))', 'max_corr')}
FROM b WHERE f2 IN ('Momentum_1m', 'Size_Volume') AND corr IS NOT NULL GROUP BY f1""",
)
def library_correlation(spark, sf_dir):
    df, _ = factor_frame(spark, sf_dir)
    near = scorecard.library_correlation(gram.pair_corr(df, FOUR), ["Momentum_1m", "Size_Volume"])
    return show(near, ["factor_id", "closest", "n_compared"], ["max_corr"])


def all_pairs(out: str = "pairs", min_n: int = 20) -> str:
    """CTE ``out``: pairwise-complete correlation of all named factors."""
    x, y = "a.factor_value", "b.factor_value"
    return f"""{named_factors(NAMED, 'CAST(NULL AS DOUBLE)')}, fv AS (SELECT factor_id, date, asset, factor_value FROM facs WHERE factor_value IS NOT NULL),
{out} AS (SELECT a.factor_id AS f1, b.factor_id AS f2, count(*) AS n, CASE WHEN count(*) >= {min_n} THEN {corr(x, y)} END AS corr
  FROM fv a JOIN fv b ON a.date = b.date AND a.asset = b.asset AND a.factor_id < b.factor_id GROUP BY 1, 2)"""


EQUITY_SQL = "(" + ", ".join(f"'{f}'" for f in EQUITY) + ")"


@query(
    "i_benchmark_correlation",
    f"WITH {all_pairs()} SELECT f1, f2, n, {r6('corr', 'corr', 5)} FROM pairs WHERE f1 IN {EQUITY_SQL} OR f2 IN {EQUITY_SQL}",
)
def benchmark_correlation(spark, sf_dir):
    pairs = named_pairs(spark, sf_dir).filter(F.col("f1").isin(list(EQUITY)) | F.col("f2").isin(list(EQUITY)))
    return show(pairs, ["f1", "f2", "n"], ["corr"], 5)


# -- tests ------------------------------------------------------------------------------------

P_SQL = f"""WITH {long_factors()}, {ic_daily('facs')},
s AS (SELECT factor_id, avg(rank_ic) AS ic_mean, stddev_samp(rank_ic) AS sd, count(*) AS n FROM daily GROUP BY 1)"""


@query(
    "h_ic_t_stat",
    f"""{P_SQL} SELECT factor_id, n AS n_dates, {r6('ic_mean', 'ic_mean')}, {r6('sd', 'ic_std')}, {r6('ic_mean / greatest(sd, 1e-10) * sqrt(n)', 't_stat')} FROM s""",
)
def ic_t_stat(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(hypothesis.ic_p_value(ic.daily_ic(long, wide=wide)), ["factor_id", "n_dates"], ["ic_mean", "ic_std", "t_stat"])


# The second p is that of the mean IC and its spread over a hundred dates; its family is all factors.
FDR = f"""s AS (SELECT factor_id, avg(rank_ic) AS m, coalesce(stddev_samp(rank_ic), 0) AS sd, count(*) AS n FROM daily GROUP BY 1),
q AS (SELECT factor_id, m / greatest(sd, 1e-10) * sqrt(n) AS t, greatest(n - 1, 1) AS nu, m / greatest(sd, 1e-10) * 10 AS t2, 99 AS nu2 FROM s),
pv AS (SELECT factor_id, {t_tail('t', 'nu')} AS p, {t_tail('t2', 'nu2')} AS p2 FROM q),
o AS (SELECT *, row_number() OVER (ORDER BY p2, factor_id) AS r, count(*) OVER () AS n FROM pv),
j AS (SELECT *, min(least(1.0, p2 * n / r)) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj FROM o)"""


@query(
    "h_ic_p_value_fdr",
    f"WITH {named_factors(NAMED, f'lead(close, 5) OVER ({A}) / close - 1')}, {ic_daily('facs')}, {FDR} SELECT factor_id, {r6('p', 'p_value', 5)}, {r6('adj', 'screened_p', 5)} FROM j",
)
def ic_p_value_fdr(spark, sf_dir):
    scored = named_scores(spark, sf_dir).filter(F.col("rank_ic").isNotNull())
    tested = hypothesis.ic_p_value(scored.select("factor_id", "date", "n", "rank_ic"))
    out = hypothesis.screen_with_fdr(hypothesis.apply_fdr(tested, "p_value").select("factor_id", "ic_mean", "ic_std", "p_value", "adjusted_p"), 100)
    return show(out.withColumnRenamed("adjusted_p", "screened_p"), ["factor_id"], ["p_value", "screened_p"], 5)


# A p-like score per factor and date: each factor's dates are one family, as long as the calendar.
RAW_P = f"""{long_factors()}, {ic_daily('facs')}, pv AS (SELECT factor_id, date, pow(1 - abs(rank_ic), 40) AS p FROM daily)"""
BH = """o AS (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY p, date) AS r, count(*) OVER (PARTITION BY factor_id) AS n FROM pv),
j AS (SELECT *, min(least(1.0, p * n / r)) OVER (PARTITION BY factor_id ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS adj,
  max(CASE WHEN p <= 0.05 * r / n THEN r END) OVER (PARTITION BY factor_id) AS last FROM o)"""


def raw_p(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return ic.daily_ic(long, wide=wide).select("factor_id", "date", F.pow(1 - F.abs("rank_ic"), F.lit(40.0)).alias("p"))


@query(
    "h_benjamini_hochberg",
    f"""WITH {RAW_P}, {BH} SELECT factor_id, CAST(date AS VARCHAR) AS date, CAST(r <= coalesce(last, 0) AS INT) AS rejected, n AS n_total, {r6('adj', 'adjusted_p')},
CAST(sum(CASE WHEN r <= coalesce(last, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY factor_id) AS BIGINT) AS n_rejected FROM j""",
)
def bh(spark, sf_dir):
    out = hypothesis.benjamini_hochberg(raw_p(spark, sf_dir), "p", "date", by=["factor_id"])
    out = out.withColumn("rejected", F.col("rejected").cast("int"))
    return show(out, ["factor_id", "date", "rejected", "n_total", "n_rejected"], ["adjusted_p"])


@query(
    "h_bonferroni",
    f"""WITH {RAW_P}, n AS (SELECT *, count(*) OVER (PARTITION BY factor_id) AS n FROM pv)
SELECT factor_id, CAST(date AS VARCHAR) AS date, CAST(p < 0.05 / n AS INT) AS rejected, {r6('least(1.0, p * n)', 'adjusted_p')}, {r6('1000 * 0.05 / n', 'threshold')} FROM n""",
)
def bonf(spark, sf_dir):
    out = hypothesis.bonferroni(raw_p(spark, sf_dir), "p", by=["factor_id"]).withColumns(
        {"rejected": F.col("rejected").cast("int"), "threshold": 1000 * F.col("threshold")}
    )
    return show(out, ["factor_id", "date", "rejected"], ["adjusted_p", "threshold"])


@query(
    "h_t_two_sided_p",
    f"""WITH {PANEL_SQL}, r AS (SELECT asset, close / lag(close) OVER ({A}) - 1 AS r FROM panel),
q AS (SELECT asset, count(r) AS n, avg(r) / greatest(stddev_samp(r), 1e-10) * sqrt(count(r)) AS t, count(r) - 1 AS nu FROM r GROUP BY 1)
SELECT asset, n, {r6('t', 't')}, {r6(t_tail('t', 'nu'), 'p_value')} FROM q""",
)
def t_tail(spark, sf_dir):
    p = weekly_panel(spark, sf_dir).withColumn("r", pct_change("close"))
    per = p.groupBy("asset").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    per = per.withColumn("t", hypothesis.mean_t("m", "s", "n"))
    return show(per.withColumn("p_value", t_two_sided_p("t", F.col("n") - 1)), ["asset", "n"], ["t", "p_value"])


@query(
    "h_ols_fit",
    f"""WITH {PANEL_SQL}, k AS (SELECT asset, close AS y, CAST(row_number() OVER ({A}) AS DOUBLE) AS x FROM panel),
f AS (SELECT asset, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) - 2 AS nu FROM k GROUP BY asset),
t AS (SELECT *, sqrt(r2 * nu / (1 - r2)) AS t FROM f WHERE n >= 3 AND r2 < 1), p AS (SELECT asset, {tail_sql('t', 'nu')} AS p FROM t)
SELECT f.asset, n, {r6('slope', 'slope', 4)}, {r6('intercept', 'intercept', 4)}, {r6('r2', 'r2')}, {r6('CASE WHEN n >= 3 AND r2 >= 1 THEN 0 ELSE p END', 'p_value', 5)} FROM f LEFT JOIN p USING (asset)""",
)
def ols_fit(spark, sf_dir):
    from pyspark.sql import Window

    p = weekly_panel(spark, sf_dir).withColumn("x", F.row_number().over(Window.partitionBy("asset").orderBy("date")).cast("double"))
    fit = hypothesis.trend_fit(p, "close", "x", ["asset"])
    return show(fit, ["asset", "n"], ["slope", "intercept"], 4, {"r2": 6, "p_value": 5})
