"""Validation, neutralisation, combination, regimes, decay and health of factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import query, r6, show
from .book import IMPACT
from .dsl import A, D, G
from .evaluation import LONG_SHORT, all_pairs, factor_frame, factor_long, fields_of, named_pairs, named_scores, tree_scores
from .sqlkit import FOUR, corr, ic_daily, long_factors, named_factors, pairs_of_four, t_tail, wide_factors
from ..operators import combine, gram, health, ic, oos, portfolio, regime
from ..operators.ts import forward_return, running_product
from ..plans import sweep, tree
from ..plans.factors import NAMED
from ..session import settle
from ..sources.adapters import DAILY_SQL, PANEL_SQL, daily_panel, date_is_wide, weekly_panel

# -- splits and validation --------------------------------------------------------------------


@query(
    "o_oos_split",
    f"""WITH {PANEL_SQL}, c AS (SELECT max(date) - INTERVAL 6 MONTH AS cutoff FROM panel),
p AS (SELECT *, date > cutoff AS t FROM panel, c)
SELECT CAST(CAST(max(cutoff) AS DATE) AS VARCHAR) AS cutoff, CAST(min(date) AS VARCHAR) AS train_start, CAST(max(date) AS VARCHAR) AS test_end,
 count(DISTINCT CASE WHEN NOT t THEN date END) AS train_dates, count(DISTINCT CASE WHEN t THEN date END) AS test_dates,
 count(DISTINCT CASE WHEN NOT t THEN asset END) AS train_assets, count(DISTINCT CASE WHEN t THEN asset END) AS test_assets,
 count(*) FILTER (WHERE NOT t) AS train_rows, count(*) FILTER (WHERE t) AS test_rows,
 CAST(count(DISTINCT CASE WHEN NOT t THEN date END) >= 120 AND count(DISTINCT CASE WHEN t THEN date END) >= 40 AS INT) AS sufficient FROM p""",
)
def oos_split(spark, sf_dir):
    out = oos.split_summary(oos.oos_split(weekly_panel(spark, sf_dir)))
    dates = {c: F.col(c).cast("string") for c in ("cutoff", "train_start", "test_end")}
    return out.withColumns({**dates, "sufficient": F.col("sufficient").cast("int")})


@query(
    "o_positional_split",
    f"""WITH {PANEL_SQL}, p AS (SELECT asset, row_number() OVER ({A}) AS i, count(*) OVER (PARTITION BY asset) AS n FROM panel)
SELECT asset, count(*) FILTER (WHERE i <= least(greatest(floor(n * 0.7), 30), n - 30)) AS train_rows,
 count(*) FILTER (WHERE i > least(greatest(floor(n * 0.7), 30), n - 30)) AS test_rows FROM p WHERE n >= 60 GROUP BY asset""",
)
def positional(spark, sf_dir):
    d = oos.positional_split(weekly_panel(spark, sf_dir), 0.7)
    return d.groupBy("asset").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"))


FOLDS = """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS t FROM (SELECT DISTINCT date FROM panel)),
folds AS (SELECT CAST(f AS INT) AS fold, date, CASE WHEN p - f * 40 < 120 THEN 'train' ELSE 'test' END AS part FROM days, range(0, 100) r(f)
  WHERE p >= f * 40 AND p < f * 40 + 160 AND f * 40 + 160 <= t)"""


@query(
    "o_walk_forward_folds",
    f"WITH {PANEL_SQL}, {FOLDS} SELECT fold, CAST(date AS VARCHAR) AS date, part FROM folds",
)
def folds(spark, sf_dir):
    d = oos.walk_forward_folds(weekly_panel(spark, sf_dir), 120, 40, 40)
    return d.select("fold", F.col("date").cast("string").alias("date"), "part")


def sampled_factors(panel, parts, wide):
    """The four factors computed separately inside each sample, and their IC per date.

    ``parts`` labels dates (fold, date, part).  A sample's rows form their own series and
    cross-sections, so rolling windows and labels never cross a sample's edge.
    """
    trees = {k: tree.order_core(NAMED[k]) for k in FOUR}
    rest = [c for c in panel.columns if c not in ("date", "asset")]
    d = panel.join(parts, "date").select(
        F.struct("fold", "part", "date").alias("date"), F.struct("fold", "part", "asset").alias("asset"), *rest
    )
    d = tree.evaluate(d.withColumn("label", forward_return(5)), trees, wide=wide)
    return tree.long_form(d, trees, ["label"])


def sampled_sql(parts: str, by: str = "fold, part") -> str:
    """The same in SQL: factors per (fold, part) from a CTE ``folds``."""
    text = long_factors(cols=", " + by).replace("PARTITION BY asset", f"PARTITION BY asset, {by}").replace("PARTITION BY date", f"PARTITION BY date, {by}")
    text = text.replace("FROM panel),\nwide", "FROM sampled),\nwide")
    head, tail = text.split("raw AS", 1)
    return f"{head}{parts}, sampled AS (SELECT panel.*, {by} FROM panel JOIN folds USING (date)), raw AS{tail}"


SIDES = "avg(CASE WHEN part = 'train' THEN rank_ic END) AS a, avg(CASE WHEN part = 'test' THEN rank_ic END) AS b"
SPLIT = """folds AS (SELECT DISTINCT date, 0 AS fold, CASE WHEN date > (SELECT max(date) - INTERVAL 6 MONTH FROM panel) THEN 'test' ELSE 'train' END AS part FROM panel)"""
CHECKS = f"""i AS (SELECT factor_id, coalesce(avg(CASE WHEN part = 'train' THEN rank_ic END), 0) AS train_ic, coalesce(avg(CASE WHEN part = 'test' THEN rank_ic END), 0) AS test_ic
  FROM daily GROUP BY 1),
v AS (SELECT *, CASE WHEN train_ic > 0 THEN 1 - test_ic / (train_ic + 1e-10) ELSE 0 END AS oos_decay,
  test_ic > 0 AND (train_ic <= 0 OR test_ic / (train_ic + 1e-10) > 0.5) AS passed FROM i),
g AS (SELECT *, CASE WHEN test_ic > train_ic * 1.1 OR (oos_decay < 0.3 AND passed) THEN 'healthy' WHEN passed AND oos_decay > 0.5 THEN 'overfit'
    WHEN test_ic < 0 AND train_ic > 0.02 THEN 'structural_break' ELSE 'weak_signal' END AS diagnosis,
  CASE WHEN test_ic > train_ic * 1.1 THEN 'strong' WHEN oos_decay < 0.3 AND passed THEN 'solid' ELSE 'marginal' END AS robustness FROM v)"""
BY_PART = ic_daily("facs", by="factor_id, fold, part")


def validated(spark, sf_dir):
    wide = date_is_wide(spark, sf_dir)
    p = weekly_panel(spark, sf_dir)
    split = oos.oos_split(p).select("date", "is_test").distinct()
    parts = split.select(F.lit(0).alias("fold"), "date", F.when(F.col("is_test"), "test").otherwise("train").alias("part"))
    long = sampled_factors(p, parts, wide)
    daily = ic.daily_ic(long, wide=wide)
    ics = daily.withColumn("part", F.col("date.part")).groupBy("factor_id").agg(
        *[F.coalesce(F.avg(F.when(F.col("part") == s, F.col("rank_ic"))), F.lit(0.0)).alias(f"{s}_ic") for s in ("train", "test")]
    )
    return oos.validate(ics), long, wide


TEST_IMPACT = "tf AS (SELECT * FROM facs WHERE part = 'test'), " + IMPACT.replace("facs", "tf")
USABLE = """us AS (SELECT fold, count(*) FILTER (WHERE part = 'train') >= 100 AND count(*) FILTER (WHERE part = 'test') >= 40 AS usable FROM panel JOIN folds USING (date) GROUP BY 1)"""


@query(
    "o_oos_validation",
    f"""WITH {sampled_sql(SPLIT)}, {BY_PART}, {CHECKS}, {TEST_IMPACT}
SELECT factor_id, CAST(passed AS INT) AS passed, diagnosis, robustness,
 CASE WHEN robustness = 'strong' THEN 'promote' WHEN diagnosis = 'overfit' THEN 'iterate' ELSE 'observe' END AS recommendation,
 {r6('train_ic', 'train_ic')}, {r6('test_ic', 'test_ic')}, {r6('oos_decay', 'oos_decay', 4)}, {r6('test_ic - coalesce(ic_penalty, 0)', 'cost_adj_ic', 4)},
 {r6('coalesce(turnover, 0)', 'turnover')}, {r6('coalesce(cost_impact_bps, 0)', 'cost_impact_bps', 4)} FROM g LEFT JOIN im USING (factor_id)""",
)
def oos_validation(spark, sf_dir):
    checks, long, wide = validated(spark, sf_dir)
    test = long.filter(F.col("date.part") == "test").withColumns({"date": F.col("date.date"), "asset": F.col("asset.asset")})
    checks = oos.with_cost(checks, portfolio.turnover_cost_impact(test, wide=wide))
    out = oos.diagnose(checks).withColumn("passed", F.col("passed").cast("int"))
    keys = ["factor_id", "passed", "diagnosis", "robustness", "recommendation"]
    return show(out, keys, ["train_ic", "test_ic", "turnover"], other={"oos_decay": 4, "cost_adj_ic": 4, "cost_impact_bps": 4})


@query(
    "g_oos_family_summary",
    f"""WITH {sampled_sql(SPLIT)}, {BY_PART}, {CHECKS},
f AS (SELECT split_part(factor_id, '_', 1) AS family, count(*) FILTER (WHERE passed) AS good, count(*) FILTER (WHERE NOT passed) AS bad FROM v GROUP BY 1),
gr AS (SELECT *, row_number() OVER (ORDER BY good DESC, family) AS rg, row_number() OVER (ORDER BY bad DESC, family) AS rb FROM f)
SELECT coalesce(string_agg(family, ',' ORDER BY rg) FILTER (WHERE rg <= 3 AND good > 0), '') AS top_families,
 coalesce(string_agg(family, ',' ORDER BY rb) FILTER (WHERE rb <= 3 AND bad > 0), '') AS worst_families, {r6('sum(good) / sum(good + bad)', 'pass_rate')} FROM gr""",
)
def oos_family(spark, sf_dir):
    checks, _, _ = validated(spark, sf_dir)
    return show(oos.family_summary(checks), ["top_families", "worst_families"], ["pass_rate"])


@query(
    "o_walk_forward_ic",
    f"""WITH {sampled_sql(FOLDS)}, {BY_PART},
{USABLE},
f AS (SELECT factor_id, fold, coalesce(avg(CASE WHEN part = 'train' THEN rank_ic END), 0) AS train_ic, coalesce(avg(CASE WHEN part = 'test' THEN rank_ic END), 0) AS test_ic
  FROM daily JOIN us USING (fold) WHERE usable GROUP BY 1, 2),
c AS (SELECT *, sum(test_ic) OVER (PARTITION BY factor_id ORDER BY fold) AS cum FROM f),
m AS (SELECT *, max(cum) OVER (PARTITION BY factor_id ORDER BY fold) AS peak FROM c)
SELECT *, {r6('avg(CAST(stable AS DOUBLE)) OVER ()', 'stability_ratio', 4)} FROM (SELECT factor_id, count(*) AS n_windows, {r6('avg(test_ic)', 'mean_oos_ic')}, {r6('stddev_samp(test_ic)', 'std_oos_ic')},
 {r6('avg(CASE WHEN test_ic > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r6('max(peak - cum)', 'max_ic_drawdown')},
 CAST(avg(CASE WHEN test_ic > 0 THEN 1.0 ELSE 0 END) >= 0.6 AND avg(test_ic) > 0 AS INT) AS stable FROM m GROUP BY 1 HAVING count(*) >= 2)""",
)
def walk_forward_ic(spark, sf_dir):
    wide = date_is_wide(spark, sf_dir)
    p = weekly_panel(spark, sf_dir)
    parts = oos.usable_folds(p, oos.walk_forward_folds(p, 120, 40, 40))
    daily = ic.daily_ic(sampled_factors(p, parts, wide), wide=wide).withColumns({"fold": F.col("date.fold"), "part": F.col("date.part")})
    ics = daily.groupBy("factor_id", "fold").agg(
        *[F.coalesce(F.avg(F.when(F.col("part") == s, F.col("rank_ic"))), F.lit(0.0)).alias(f"{s}_ic") for s in ("train", "test")]
    )
    out = oos.with_stability_ratio(oos.walk_forward_summary(ics)).withColumn("stable", F.col("stable").cast("int"))
    return show(out, ["factor_id", "n_windows", "stable"], ["mean_oos_ic", "std_oos_ic", "win_rate", "max_ic_drawdown"], other={"stability_ratio": 4})


# Folds of eight and three days over the thin panel of events: on small tables some have too few rows.
THIN = """days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS t FROM (SELECT DISTINCT date FROM daily)),
folds AS (SELECT CAST(f AS INT) AS fold, date, CASE WHEN p - f * 3 < 8 THEN 'train' ELSE 'test' END AS part FROM days, range(0, 1000) r(f)
  WHERE p >= f * 3 AND p < f * 3 + 11 AND f * 3 + 11 <= t)"""


@query(
    "o_usable_folds",
    f"""WITH {DAILY_SQL}, {THIN}, rw AS (SELECT fold, count(*) FILTER (WHERE part = 'train') AS train_rows, count(*) FILTER (WHERE part = 'test') AS test_rows FROM daily JOIN folds USING (date) GROUP BY 1)
SELECT fold, train_rows, test_rows, CAST(train_rows >= 100 AND test_rows >= 40 AS INT) AS usable FROM rw""",
)
def usable_folds(spark, sf_dir):
    p = daily_panel(spark, sf_dir)
    return oos.fold_sizes(p, oos.walk_forward_folds(p, 8, 3, 3)).withColumn("usable", F.col("usable").cast("int"))


SWEEP_WINDOWS = [5, 10, 20]
SWEEP_FACS = " UNION ALL ".join(
    f"SELECT 'window={w}' AS factor_id, date, asset, close - lag(close, {w}) OVER ({A}) AS factor_value, lead(close, 5) OVER ({A}) / close - 1 AS label FROM panel"
    for w in SWEEP_WINDOWS
)


def swept(spark, sf_dir, base, space):
    variants = sweep.variants(base, space)
    p = weekly_panel(spark, sf_dir, fields_of(variants))
    return ic.factor_scores(tree_scores(spark, sf_dir, p, {k: tree.order_core(t) for k, t in variants.items()}))


@query(
    "o_parameter_sensitivity",
    f"""WITH {PANEL_SQL}, facs AS ({SWEEP_FACS}), {ic_daily('facs')},
s AS (SELECT factor_id, avg(rank_ic) AS ic_mean, coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0) AS ic_ir FROM daily GROUP BY 1)
SELECT factor_id AS params, {r6('ic_mean', 'ic_mean')}, {r6('ic_ir', 'ic_ir')}, CAST(row_number() OVER (ORDER BY ic_ir DESC, ic_mean DESC, factor_id) = 1 AS INT) AS best,
 CAST(row_number() OVER (ORDER BY ic_ir, ic_mean, factor_id) = 1 AS INT) AS worst FROM s""",
)
def sensitivity(spark, sf_dir):
    scored = swept(spark, sf_dir, NAMED["Momentum_12m1m"], {"window": SWEEP_WINDOWS})
    return show(sweep.ranked(scored), ["params", "best", "worst"], ["ic_mean", "ic_ir"])


SWEPT = sweep.variants(NAMED["A_Share_Vol_Price_Coupling"], sweep.default_space(NAMED["A_Share_Vol_Price_Coupling"]))


@query(
    "o_parameter_sweep",
    f"""WITH {named_factors(SWEPT, f'lead(close, 5) OVER ({A}) / close - 1')}, {ic_daily('facs')},
s AS (SELECT factor_id, avg(rank_ic) AS ic_mean, coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0) AS ic_ir FROM daily GROUP BY 1)
SELECT factor_id AS params, {r6('ic_mean', 'ic_mean', 4)}, {r6('ic_ir', 'ic_ir', 4)}, CAST(row_number() OVER (ORDER BY ic_ir DESC, ic_mean DESC, factor_id) = 1 AS INT) AS best,
 CAST(row_number() OVER (ORDER BY ic_ir, ic_mean, factor_id) = 1 AS INT) AS worst FROM s""",
)
def parameter_sweep(spark, sf_dir):
    base = NAMED["A_Share_Vol_Price_Coupling"]
    return show(sweep.ranked(swept(spark, sf_dir, base, sweep.default_space(base))), ["params", "best", "worst"], ["ic_mean", "ic_ir"], 4)


@query("o_template_grid")
def template_grid(spark, sf_dir):
    trees = sweep.template_grid(["close", "volume", "turnover"], [5, 10, 20])
    scored = tree_scores(spark, sf_dir, weekly_panel(spark, sf_dir, ["industry"]), {k: tree.order_core(t) for k, t in trees.items()})
    return show(ic.factor_scores(scored), ["factor_id", "n_dates"], ["ic_mean", "ic_ir"])


# -- risk neutralisation ----------------------------------------------------------------------


def neutral_frame(spark, sf_dir):
    p = weekly_panel(spark, sf_dir, ["industry", "market_cap"])
    return p.withColumn("x", F.col("turnover")), date_is_wide(spark, sf_dir)


def resid(y: str, x: str, out: str, src: str) -> str:
    """CTE ``out``: per-date residual of y on x (at least 10 pairs), 0 otherwise."""
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"""{out}_m AS (SELECT *, count({x} + {y}) OVER ({D}) AS pn, covar_pop({a}, {b}) OVER ({D}) AS pc, var_pop({a}) OVER ({D}) AS pv,
  avg({a}) OVER ({D}) AS pa, avg({b}) OVER ({D}) AS pb0 FROM {src}),
{out} AS (SELECT * EXCLUDE (pn, pc, pv, pa, pb0), CASE WHEN pn >= 10 THEN pc / nullif(pv, 0) END AS {out}_slope,
  coalesce({y} - pb0 - CASE WHEN pn >= 10 THEN pc / nullif(pv, 0) END * ({x} - pa), 0) AS {out}_v FROM {out}_m)"""


NEUTRAL = f"""{PANEL_SQL}, n0 AS (SELECT *, turnover AS x, turnover - avg(turnover) OVER ({G}) AS v0, ln(greatest(market_cap, 1.0)) AS lncap,
  close / lag(close, 20) OVER ({A}) - 1 AS past FROM panel), {resid('v0', 'lncap', 'n1', 'n0')}, {resid('n1_v', 'past', 'n2', 'n1')}"""


@query("r_residualize", f"WITH {PANEL_SQL}, n0 AS (SELECT *, turnover AS x FROM panel), {resid('x', 'close', 'n1', 'n0')} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('n1_v', 'value')} FROM n1")
def residualize(spark, sf_dir):
    d, wide = neutral_frame(spark, sf_dir)
    return show(combine.residualize(d, "x", "close", "value", wide=wide), ["date", "asset"], ["value"])


@query("r_risk_neutralize", f"WITH {NEUTRAL} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('n2_v', 'value')} FROM n2")
def risk_neutralize(spark, sf_dir):
    d, wide = neutral_frame(spark, sf_dir)
    return show(combine.risk_neutralize(d, "x", "value", wide=wide), ["date", "asset"], ["value"])


@query(
    "r_risk_exposures",
    f"""WITH {NEUTRAL}, i AS (SELECT avg(x) AS m FROM n2 GROUP BY industry), s AS (SELECT date, max(n1_slope) AS a, max(n2_slope) AS b FROM n2 GROUP BY date)
SELECT {r6('(SELECT max(abs(m)) FROM i)', 'industry')}, {r6('avg(abs(a))', 'market_cap')}, {r6('avg(abs(b))', 'momentum')} FROM s""",
)
def risk_exposures(spark, sf_dir):
    d, wide = neutral_frame(spark, sf_dir)
    return show(combine.risk_exposures(combine.risk_neutralize(d, "x", "value", wide=wide), "x"), [], ["industry", "market_cap", "momentum"])


# -- combination and crowding -------------------------------------------------------------------

WEIGHTS = f"""{ic_daily('facs')}, sc AS (SELECT factor_id, avg(rank_ic) AS ic_mean, coalesce(avg(rank_ic) / nullif(stddev_pop(rank_ic), 0), 0) AS ic_ir FROM daily GROUP BY 1),
wt AS (SELECT factor_id, round(0.25, 4) AS equal_weight, round(greatest(ic_mean, 0.001) / sum(greatest(ic_mean, 0.001)) OVER (), 4) AS ic_weight,
  round(greatest(ic_ir, 0.001) / sum(greatest(ic_ir, 0.001)) OVER (), 4) AS icir_weight FROM sc)"""


@query(
    "c_factor_weights",
    f"WITH {long_factors()}, {WEIGHTS} SELECT factor_id, {r6('equal_weight', 'equal_weight', 4)}, {r6('ic_weight', 'ic_weight', 4)}, {r6('icir_weight', 'icir_weight', 4)} FROM wt",
)
def factor_weights(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    s = ic.batch_rank_ic(long, wide=wide)
    d = combine.weigh(s, "equal").withColumnRenamed("weight", "equal_weight")
    for method, name in (("ic_weighted", "ic_weight"), ("max_icir", "icir_weight")):
        d = combine.weigh(d, method).withColumnRenamed("weight", name)
    return show(d, ["factor_id"], ["equal_weight", "ic_weight", "icir_weight"], 4)


CROWD = """cr AS (SELECT f1 AS factor_id, avg(abs(corr)) AS crowding, max(abs(corr)) AS max_corr, count(corr) AS n_pairs FROM
  (SELECT f1, corr FROM pairs UNION ALL SELECT f2, corr FROM pairs) GROUP BY 1)"""


@query(
    "c_crowding_scores",
    f"WITH {wide_factors()}, {pairs_of_four()}, {CROWD} SELECT factor_id, n_pairs, CAST(crowding > 0.2 AS INT) AS crowded, {r6('crowding', 'crowding')}, {r6('max_corr', 'max_corr')} FROM cr",
)
def crowding(spark, sf_dir):
    df, _ = factor_frame(spark, sf_dir)
    out = combine.crowding_scores(gram.pair_corr(df, FOUR), 0.2).withColumn("crowded", F.col("crowded").cast("int"))
    return show(out, ["factor_id", "n_pairs", "crowded"], ["crowding", "max_corr"])


@query(
    "c_crowding_penalty",
    f"""WITH {long_factors()}, {WEIGHTS}, {pairs_of_four()}, {CROWD},
h AS (SELECT factor_id, CASE WHEN crowding > 0.2 THEN ic_weight * 0.5 ELSE ic_weight END AS w, max(CASE WHEN crowding > 0.2 THEN 1 ELSE 0 END) OVER () AS anyc FROM wt JOIN cr USING (factor_id))
SELECT factor_id, {r6('CASE WHEN anyc = 1 THEN round(w / sum(w) OVER (), 4) ELSE w END', 'weight', 4)} FROM h""",
)
def penalty(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    df = settle(df)
    w = combine.weigh(ic.frame_rank_ic(df, FOUR, wide=wide))
    return show(combine.crowding_penalty(w, combine.crowding_scores(gram.pair_corr(df, FOUR)), 0.2), ["factor_id"], ["weight"], 4)


@query(
    "c_crowding_clusters",
    f"""WITH RECURSIVE {all_pairs()}, e AS (SELECT f1 AS a, f2 AS b FROM pairs WHERE abs(corr) > 0.6), ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, other) AS (SELECT DISTINCT a, a FROM ways UNION SELECT reach.node, ways.b FROM reach JOIN ways ON reach.other = ways.a),
l AS (SELECT node AS factor_id, min(other) AS cluster FROM reach GROUP BY 1)
SELECT cluster, factor_id, count(*) OVER (PARTITION BY cluster) AS size FROM l""",
)
def crowding_clusters(spark, sf_dir):
    return combine.clusters(named_pairs(spark, sf_dir).filter(F.abs("corr") > 0.6))


# A fold over the factors in order; the state is the list of kept ones.
KEPT = """nb AS (SELECT f, list(g) AS near FROM (SELECT f1 AS f, f2 AS g FROM pairs WHERE abs(corr) > 0.6 UNION ALL SELECT f2, f1 FROM pairs WHERE abs(corr) > 0.6) GROUP BY f),
ord AS (SELECT o.f, coalesce(near, []) AS near, row_number() OVER (ORDER BY o.f) AS i FROM (SELECT DISTINCT factor_id AS f FROM facs) o LEFT JOIN nb ON nb.f = o.f),
fold(i, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT ord.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, ord.f) END FROM fold JOIN ord ON ord.i = fold.i + 1),
kept AS (SELECT unnest(kept) AS factor_id FROM fold WHERE i = (SELECT max(i) FROM ord))"""


@query(
    "c_orthogonal_select",
    f"WITH RECURSIVE {all_pairs()}, {CROWD}, {KEPT} SELECT factor_id, n_pairs FROM kept JOIN cr USING (factor_id)",
)
def orthogonal(spark, sf_dir):
    names = list(NAMED)
    pairs = settle(named_pairs(spark, sf_dir))
    kept = combine.orthogonal_select(pairs, spark.createDataFrame([(n,) for n in names], "factor_id string"), 0.6)
    return combine.crowding_scores(pairs).join(kept, "factor_id").select("factor_id", "n_pairs")


@query(
    "c_weighted_combine",
    f"WITH {wide_factors()} SELECT CAST(date AS VARCHAR) AS date, asset, {r6('0.4 * coalesce(f0, 0) + 0.3 * coalesce(f1, 0) + 0.2 * coalesce(f2, 0) + 0.1 * coalesce(f3, 0)', 'factor_value')} FROM wide",
)
def weighted(spark, sf_dir):
    df, _ = factor_frame(spark, sf_dir)
    out = combine.weighted_combine(df, dict(zip(FOUR, (0.4, 0.3, 0.2, 0.1))))
    return show(out, ["date", "asset"], ["factor_value"])


COMBINED = f"""{wide_factors()}, mix AS (SELECT 'combined' AS factor_id, date, asset, label,
  0.25 * coalesce(f0, 0) + 0.25 * coalesce(f1, 0) + 0.25 * coalesce(f2, 0) + 0.25 * coalesce(f3, 0) AS factor_value FROM wide)"""


@query(
    "c_combine_equal",
    f"""WITH {COMBINED}, {ic_daily('mix')} SELECT 'combined' AS factor_id, '{",".join(FOUR)}' AS factor_ids, {r6('avg(rank_ic)', 'ic_mean')},
 {r6('avg(rank_ic) / stddev_pop(rank_ic)', 'ic_ir')} FROM daily""",
)
def combine_equal(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    return show(combine.combine(df, FOUR, "equal", threshold=0.95, wide=wide), ["factor_id", "factor_ids"], ["ic_mean", "ic_ir"])


@query("c_combine_ridge")
def combine_ridge(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    return show(combine.combine(df, FOUR, "ridge", threshold=0.95, wide=wide), ["factor_id", "factor_ids", "weights"], ["ic_mean", "ic_ir"])


RANKED = """rk AS (SELECT date, asset, CASE WHEN factor_value IS NOT NULL THEN (rank() OVER (PARTITION BY factor_id, date ORDER BY factor_value NULLS LAST)
  + (count(*) OVER (PARTITION BY factor_id, date, factor_value) - 1) / 2.0) / count(factor_value) OVER (PARTITION BY factor_id, date) END AS r FROM facs)"""


@query(
    "c_combine_rank_mean",
    f"WITH {long_factors()}, {RANKED} SELECT CAST(date AS VARCHAR) AS date, asset, count(r) AS n_factors, {r6('avg(r)', 'score')} FROM rk GROUP BY date, asset",
)
def rank_mean(spark, sf_dir):
    df, wide = factor_frame(spark, sf_dir)
    return show(combine.frame_rank_mean(df, FOUR, wide), ["date", "asset", "n_factors"], ["score"])


@query(
    "i_benchmark_compare",
    f"""WITH {wide_factors()}, medians AS (SELECT *, coalesce(market_cap, quantile_cont(market_cap, 0.5) OVER ({D})) AS cap FROM wide),
facs AS (SELECT 'combined' AS factor_id, date, label, 0.25 * coalesce(f0, 0) + 0.25 * coalesce(f1, 0) + 0.25 * coalesce(f2, 0) + 0.25 * coalesce(f3, 0) AS factor_value FROM wide
  UNION ALL SELECT 'market_cap', date, label, cap FROM medians), {ic_daily('facs')},
s AS (SELECT max(CASE WHEN factor_id = 'combined' THEN m END) AS c, max(CASE WHEN factor_id = 'market_cap' THEN m END) AS k FROM (SELECT factor_id, avg(rank_ic) AS m FROM daily GROUP BY 1))
SELECT {r6('c', 'combined_ic')}, {r6('c - 0', 'vs_equal')}, {r6('c - k', 'vs_market_cap')} FROM s""",
)
def benchmark_compare(spark, sf_dir):
    from ..operators.xsec import fill_missing

    df, wide = factor_frame(spark, sf_dir, fields=("market_cap",))
    d = combine.weighted_combine(df, {f: 0.25 for f in FOUR}, "combined").withColumn("equal", F.lit(1.0))
    d = fill_missing(d, "market_cap", "market_cap", wide=wide)
    s = ic.batch_rank_ic(tree.long_form(d, ["combined", "equal", "market_cap"], ["label"]), wide=wide)
    one = s.agg(*[F.max(F.when(F.col("factor_id") == n, F.col("ic_mean"))).alias(n) for n in ("combined", "equal", "market_cap")])
    out = one.select(
        F.col("combined").alias("combined_ic"),
        (F.col("combined") - F.col("equal")).alias("vs_equal"),
        (F.col("combined") - F.col("market_cap")).alias("vs_market_cap"),
    )
    return show(out, [], ["combined_ic", "vs_equal", "vs_market_cap"])


# -- regimes, decay, health -----------------------------------------------------------------------

MARKET = f"""mr AS (SELECT date, avg(r) AS m FROM (SELECT date, close / lag(close) OVER ({A}) - 1 AS r FROM panel) GROUP BY date HAVING avg(r) IS NOT NULL)"""
REGIME = f"""{MARKET}, nv AS (SELECT *, exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS nav, row_number() OVER (ORDER BY date) - 1 AS i FROM mr),
mv AS (SELECT *, avg(nav) OVER (ORDER BY date ROWS 19 PRECEDING) / (avg(nav) OVER (ORDER BY date ROWS 59 PRECEDING) + 1e-10) - 1 AS sp FROM nv),
rg AS (SELECT *, CASE WHEN i < 60 THEN 'sideways' WHEN sp > 0.02 THEN 'bull' WHEN sp < -0.02 THEN 'bear' ELSE 'sideways' END AS regime FROM mv),
rs AS (SELECT *, CASE WHEN i > 60 AND regime <> lag(regime) OVER (ORDER BY date) THEN 1 ELSE 0 END AS switched FROM rg)"""


@query("g_market_return", f"WITH {PANEL_SQL}, {MARKET} SELECT CAST(date AS VARCHAR) AS date, {r6('m', 'market_return')} FROM mr")
def market_return(spark, sf_dir):
    return show(regime.market_return(weekly_panel(spark, sf_dir)), ["date"], ["market_return"])


@query("m_regime_detect", f"WITH {PANEL_SQL}, {REGIME} SELECT CAST(date AS VARCHAR) AS date, regime, switched FROM rs")
def regimes(spark, sf_dir):
    d = regime.detect(regime.market_return(weekly_panel(spark, sf_dir)))
    return d.select(F.col("date").cast("string").alias("date"), "regime", F.col("switched").cast("int").alias("switched"))


@query(
    "m_regime_stats",
    f"""WITH {PANEL_SQL}, {REGIME}, n AS (SELECT unnest(['bear', 'bull', 'sideways']) AS regime)
SELECT n.regime, (SELECT arg_max(regime, date) FROM rs) AS current_regime, count(m) AS n_days, {r6('coalesce(avg(m), 0)', 'avg_return')},
 {r6('coalesce(stddev_samp(m), 0)', 'volatility')}, {r6('count(m) / (SELECT count(*) FROM rs)', 'pct_days')} FROM n LEFT JOIN rs USING (regime) GROUP BY n.regime""",
)
def regime_stats(spark, sf_dir):
    d = regime.regime_stats(regime.detect(regime.market_return(weekly_panel(spark, sf_dir))))
    return show(d, ["regime", "current_regime", "n_days"], ["avg_return", "volatility", "pct_days"])


@query(
    "m_regime_transitions",
    f"WITH {PANEL_SQL}, {REGIME} SELECT CAST(date AS VARCHAR) AS date, regime FROM rs WHERE switched = 1 ORDER BY date DESC LIMIT 10",
)
def transitions(spark, sf_dir):
    d = regime.last_transitions(regime.detect(regime.market_return(weekly_panel(spark, sf_dir))))
    return d.select(F.col("date").cast("string").alias("date"), "regime")


@query(
    "m_regime_adjusted_ic",
    f"""WITH {long_factors()}, {ic_daily('facs')}, {REGIME}, j AS (SELECT d.*, coalesce(regime, 'sideways') AS regime FROM daily d LEFT JOIN rs USING (date))
SELECT factor_id, {r6('avg(rank_ic)', 'regime_adj_ic')}, {r6('avg(rank_ic) / (stddev_pop(rank_ic) + 1e-10)', 'regime_adj_icir')},
 {', '.join(r6(f"coalesce(avg(CASE WHEN regime = '{r}' THEN rank_ic END), 0)", f'{r}_ic') for r in ('bull', 'bear', 'sideways'))} FROM j GROUP BY 1""",
)
def regime_ic(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    labels = regime.detect(regime.market_return(weekly_panel(spark, sf_dir)))
    out = regime.regime_ic(ic.daily_ic(long, wide=wide), labels)
    return show(out, ["factor_id"], ["regime_adj_ic", "regime_adj_icir", "bull_ic", "bear_ic", "sideways_ic"])


NEXT = f", lead(close, 1) OVER ({A}) / close - 1 AS lab"


@query("m_ic_trend", f"""WITH {long_factors(NEXT, ', lab')}, {ic_daily('facs', 5, 'lab')}, k AS (SELECT factor_id, rank_ic AS y, row_number() OVER (PARTITION BY factor_id ORDER BY date) AS x FROM daily),
f AS (SELECT factor_id, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM k GROUP BY 1),
t AS (SELECT *, sqrt(r2 * (n - 2) / (1 - r2)) AS t, n - 2 AS nu FROM f), p AS (SELECT *, {t_tail('t', 'nu')} AS p FROM t)
SELECT factor_id, n, CASE WHEN n < 20 THEN 'insufficient' WHEN round(slope, 6) < -0.001 AND round(p, 6) < 0.05 THEN 'decaying' ELSE 'stable' END AS trend_status,
 {r6('slope', 'slope', 8)}, {r6('r2', 'r2')}, {r6('p', 'p_value')} FROM p""")
def ic_trend(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir, labels={"label": 1})
    out = health.ic_trend(ic.daily_ic(long, ic.DECAY, wide=wide))
    return show(out, ["factor_id", "n", "trend_status"], ["slope"], 8, {"r2": 6, "p_value": 6})


@query("m_decay_check")
def decay_check(spark, sf_dir):
    scored = settle(named_scores(spark, sf_dir, ic.DECAY, 1))  # one row for each factor and date, read twice
    out = health.decay_check(scored, health.ic_trend(scored.filter(F.col("rank_ic").isNotNull())))
    return show(out, ["factor_id", "status", "action", "reasons"], ["full_ic", "recent_ic", "ic_decay"], 5)


@query(
    "m_record_daily_ic",
    f"""WITH {long_factors(NEXT, ', lab')}, {ic_daily('facs', 5, 'lab')} SELECT factor_id, (SELECT CAST(max(date) AS VARCHAR) FROM panel) AS date, {r6('avg(rank_ic)', 'rank_ic', 5)} FROM daily GROUP BY 1""",
)
def record_ic(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir, labels={"label": 1})
    last = weekly_panel(spark, sf_dir).agg(F.max("date").cast("string").alias("date"))
    log = health.record_daily_ic(long, None, wide).drop("date").withColumn("_one", F.lit(1))
    return show(log.join(last.withColumn("_one", F.lit(1)), "_one"), ["factor_id", "date"], ["rank_ic"], 5)


ROLL = "OVER (PARTITION BY factor_id ORDER BY date ROWS 59 PRECEDING)"
DRIFT = f"""dr AS (SELECT factor_id, rank_ic, CASE WHEN count(*) {ROLL} >= 30 THEN avg(rank_ic) {ROLL} END AS roll,
  row_number() OVER (PARTITION BY factor_id ORDER BY date DESC) AS back FROM daily),
dx AS (SELECT factor_id, count(*) AS n_dates, avg(CASE WHEN back <= 60 THEN rank_ic END) AS cur, max(roll) AS pk FROM dr GROUP BY 1 HAVING count(*) >= 60),
dd AS (SELECT *, CASE WHEN pk > 0 AND cur > 0 THEN (pk - cur) / pk * 100 WHEN pk <= 0 AND cur <= 0 THEN 0 ELSE 100 END AS dec FROM dx)"""


@query(
    "v_ic_drift",
    f"""WITH {long_factors()}, {ic_daily('facs')}, {DRIFT} SELECT factor_id, n_dates, {r6('cur', 'current_ic')}, {r6('pk', 'peak_ic')}, {r6('dec', 'decline_pct', 4)},
 CASE WHEN dec > 70 THEN 'critical' WHEN dec > 50 THEN 'warning' ELSE 'normal' END AS drift_severity FROM dd""",
)
def ic_drift(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    out = health.ic_drift(ic.daily_ic(long, wide=wide))
    return show(out, ["factor_id", "n_dates", "drift_severity"], ["current_ic", "peak_ic"], other={"decline_pct": 4})


@query(
    "v_ic_autocorrelation",
    f"""WITH {long_factors()}, {ic_daily('facs')}, l AS (SELECT *, {', '.join(f'lag(rank_ic, {k}) OVER (PARTITION BY factor_id ORDER BY date) AS l{k}' for k in range(1, 6))} FROM daily),
c AS (SELECT factor_id, {', '.join(f"{corr(f'CASE WHEN l{k} IS NOT NULL THEN rank_ic END', f'l{k}')} AS lag_{k}" for k in range(1, 6))} FROM l GROUP BY 1)
SELECT factor_id, {', '.join(r6(f'lag_{k}', f'lag_{k}') for k in range(1, 6))}, {r6('(' + ' + '.join(f'coalesce(lag_{k}, 0)' for k in range(1, 6)) + ') / 5', 'stability')} FROM c""",
)
def ic_autocorr(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(ic.ic_autocorrelation(ic.daily_ic(long, wide=wide)), ["factor_id"], [*[f"lag_{k}" for k in range(1, 6)], "stability"])


MONTHS = """hm AS (SELECT factor_id, CAST(date_trunc('month', date) AS DATE) AS date, avg(abs(rank_ic)) AS s FROM daily GROUP BY 1, 2),
hu AS (SELECT *, s > lag(s) OVER (PARTITION BY factor_id ORDER BY date) AS up, row_number() OVER (PARTITION BY factor_id ORDER BY date DESC) AS b FROM hm),
hs AS (SELECT factor_id, count(*) AS n_scores, arg_max(s, date) AS cur, min(CASE WHEN NOT coalesce(up, false) THEN b END) - 1 AS inc,
  regr_slope(CASE WHEN b <= 5 THEN s END, CASE WHEN b <= 5 THEN -b END) AS sl FROM hu GROUP BY 1)"""


def monthly_scores(daily):
    return daily.groupBy("factor_id", F.trunc("date", "MM").alias("date")).agg(F.avg(F.abs("rank_ic")).alias("crowding_score"))


@query(
    "v_crowding_trend",
    f"""WITH {long_factors()}, {ic_daily('facs')}, {MONTHS} SELECT factor_id, n_scores, inc AS consecutive_increases, {r6('cur', 'current_crowding')},
 CASE WHEN sl > 0.005 THEN 'increasing' WHEN sl < -0.005 THEN 'decreasing' ELSE 'stable' END AS trend_direction FROM hs""",
)
def crowding_trend(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    out = health.crowding_trend(monthly_scores(ic.daily_ic(long, wide=wide)))
    out = out.withColumn("consecutive_increases", F.col("consecutive_increases").cast("bigint"))
    return show(out, ["factor_id", "n_scores", "consecutive_increases", "trend_direction"], ["current_crowding"])


SHARPE = f"""rt AS (SELECT factor_id, date, ls_return AS r FROM ls QUALIFY row_number() OVER (PARTITION BY factor_id ORDER BY date) > 1),
sp AS (SELECT factor_id, date, CASE WHEN count(r) {ROLL} >= 30 THEN avg(r) {ROLL} / nullif(stddev_samp(r) {ROLL}, 0) * sqrt(252) END AS s FROM rt),
sx AS (SELECT factor_id, count(*) AS n_returns, arg_max(s, date) AS cur_s, max(s) AS pk_s FROM sp GROUP BY 1 HAVING count(*) >= 60)"""


def ls_nav(long, wide):
    w = Window.partitionBy("factor_id").orderBy("date")
    return ic.long_short(long, wide=wide).withColumn("nav", running_product("ls_return", w))


@query(
    "v_rolling_sharpe",
    f"""WITH {long_factors()}, {LONG_SHORT}, {SHARPE} SELECT factor_id, n_returns, {r6('cur_s', 'current_sharpe', 5)}, {r6('pk_s', 'peak_sharpe', 5)},
 {r6('CASE WHEN pk_s > 0 THEN greatest(0, (pk_s - cur_s) / pk_s * 100) ELSE 0 END', 'sharpe_decline_pct', 5)} FROM sx""",
)
def rolling_sharpe(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    return show(health.rolling_sharpe(ls_nav(long, wide)), ["factor_id", "n_returns"], ["current_sharpe", "peak_sharpe", "sharpe_decline_pct"], 5)


@query(
    "m_factor_health",
    f"""WITH {long_factors()}, {ic_daily('facs')}, {DRIFT}, {MONTHS}, {LONG_SHORT}, {SHARPE},
j AS (SELECT factor_id, dec > 70 AS ic_bad, dec > 50 AND dec <= 70 AND cur0 > 0 AS ic_weak, inc >= 8 AS cb, inc >= 5 AND inc < 8 AS cw, cur_s < 0 AS sb,
   NOT (cur_s < 0) AND pk_s > 0 AND greatest(0, (pk_s - cur_s) / pk_s * 100) > 50 AS sw
  FROM (SELECT factor_id, dec, cur AS cur0 FROM dd) JOIN hs USING (factor_id) JOIN sx USING (factor_id)),
k AS (SELECT factor_id, CAST(ic_bad AS INT) + CAST(cb AS INT) + CAST(sb AS INT) AS critical_count, CAST(ic_weak AS INT) + CAST(cw AS INT) + CAST(sw AS INT) AS warning_count FROM j)
SELECT *, CASE WHEN critical_count >= 2 THEN 'critical' WHEN critical_count >= 1 OR warning_count >= 2 THEN 'warning' ELSE 'healthy' END AS overall_health FROM k""",
)
def factor_health(spark, sf_dir):
    long, wide = factor_long(spark, sf_dir)
    daily = ic.daily_ic(long, wide=wide)
    out = health.factor_health(health.ic_drift(daily), health.crowding_trend(monthly_scores(daily)), health.rolling_sharpe(ls_nav(long, wide)))
    return out.select("factor_id", "critical_count", "warning_count", "overall_health")
