"""Operators against pandas, NumPy and hand-made cases."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions.stats import t_two_sided_p
from factorloom.operators import combine, gram, health, hypothesis, ic, library, lifecycle, portfolio, quality, signals, ts
from factorloom.sources import ingest
from factorloom.streaming import panel_stream


def by_asset(df, *cols):
    return df.select("date", "asset", *cols).toPandas().sort_values(["asset", "date"], ignore_index=True)


def test_rolling_operators_match_pandas(panel, panel_pdf):
    pdf = panel_pdf.sort_values(["asset", "date"], ignore_index=True)
    w = 6
    cols = {
        "rank": (ts.ts_rank("x", w), lambda s: s.rolling(w, min_periods=1).rank(pct=True)),
        "skew": (ts.ts_skew("x", w), lambda s: s.rolling(w, min_periods=w // 2).skew()),
        "kurt": (ts.ts_kurt("x", w), lambda s: s.rolling(w, min_periods=w // 2).kurt()),
        "amax": (ts.ts_argmax("x", w), lambda s: s.rolling(w, min_periods=1).apply(np.argmax, raw=True) / w),
        "amin": (ts.ts_argmin("x", w), lambda s: s.rolling(w, min_periods=1).apply(np.argmin, raw=True) / w),
        "std": (ts.ts_std("x", w), lambda s: s.rolling(w, min_periods=1).std()),
    }
    got = by_asset(panel.withColumns({k: c for k, (c, _) in cols.items()}), *cols)
    for k, (_, fn) in cols.items():
        want = pdf.groupby("asset")["x"].transform(fn).to_numpy()
        assert np.allclose(got[k].to_numpy(float), want, atol=1e-6, equal_nan=True), k


def test_ema_matches_pandas(panel, panel_pdf):
    pdf = panel_pdf.sort_values(["asset", "date"], ignore_index=True)
    want = pdf.groupby("asset")["x"].transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean())
    got = by_asset(ts.ema(panel, "x", "e", 0.3), "e")["e"]
    assert np.allclose(got, want, atol=1e-12, equal_nan=True)


def test_forward_return_with_shift_one_is_zero(panel):
    v = panel.withColumn("r", ts.forward_return(1, 1)).agg(F.max(F.abs("r"))).first()[0]
    assert v == 0.0


def test_drawdown_survives_total_loss(spark):
    rows = [(dt.date(2024, 1, d), r) for d, r in ((1, 0.1), (2, -1.0), (3, 0.5), (4, 0.2))]
    d = ts.nav_and_drawdown(spark.createDataFrame(rows, "date date, r double"), "r").orderBy("date").collect()
    assert [round(x["nav"], 6) for x in d] == [1.1, 0.0, 0.0, 0.0]


def t_tail(t, df):
    """Two-sided Student t tail by numeric integration."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, abs(t), 200001)
    y = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0]))


def test_t_tail(spark):
    cases = [(t, df) for t in (0.0, 0.5, 1.96, -3.3) for df in (1, 2, 3, 10, 11, 99, 100, 355)]
    d = spark.createDataFrame([(float(t), df) for t, df in cases], "t double, df int").withColumn("p", t_two_sided_p("t", "df"))
    for r in d.collect():
        assert abs(r["p"] - t_tail(r["t"], r["df"])) < 1e-7


def test_corrections(spark):
    rng = np.random.default_rng(3)
    p = np.append(rng.uniform(0, 1, 40) ** 4, [np.nan])
    df = spark.createDataFrame([(f"f{i:02d}", float(v)) for i, v in enumerate(p)], "factor_id string, p double")
    got = hypothesis.apply_fdr(df, "p").orderBy("factor_id").toPandas()
    q = np.nan_to_num(p, nan=1.0)
    order = np.argsort(q, kind="stable")
    adj = np.minimum(1, q[order] * len(q) / np.arange(1, len(q) + 1))
    adj = np.minimum.accumulate(adj[::-1])[::-1]
    want = np.empty_like(adj)
    want[order] = adj
    assert np.allclose(got["adjusted_p"], want)
    assert (got["rejected"].to_numpy() == (want <= 0.05)).all()
    assert got["n_rejected"].iloc[0] == (want <= 0.05).sum()
    with pytest.raises(ValueError):
        hypothesis.apply_fdr(df, "p", "holm")


def test_trend_fit_decaying(spark):
    rng = np.random.default_rng(1)
    rows = [("down", i, 0.05 - 0.0025 * i + rng.normal(0, 0.003)) for i in range(30)]
    rows += [("flat", i, 0.03 + rng.normal(0, 0.005)) for i in range(30)] + [("short", i, 0.01) for i in range(5)]
    df = spark.createDataFrame(rows, "factor_id string, day int, rank_ic double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), "day"))
    got = {r["factor_id"]: r["trend_status"] for r in health.ic_trend(df).collect()}
    assert got == {"down": "decaying", "flat": "stable", "short": "insufficient"}


def test_gram_matches_pandas(panel, panel_pdf):
    df = panel.withColumn("flat", F.lit(2.0)).repartition(5)
    got = {(r["f1"], r["f2"]): (r["n"], r["corr"]) for r in gram.pair_corr(df, ["x", "y", "close", "flat"]).collect()}
    for a, b in (("close", "x"), ("x", "y"), ("close", "y")):
        both = panel_pdf[[a, b]].dropna()
        assert got[a, b][0] == len(both)
        assert abs(got[a, b][1] - both[a].corr(both[b])) < 1e-12
    assert got["flat", "x"][1] is None


def test_clusters_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = {tuple(sorted((f"n{a:02d}", f"n{b:02d}"))) for a, b in rng.integers(0, 60, (45, 2)) if a != b}
    edges |= {(f"z{i:02d}", f"z{i + 1:02d}") for i in range(30)}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["factor_id"]: r["cluster"] for r in combine.clusters(spark.createDataFrame(sorted(edges), "f1 string, f2 string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_orthogonal_select(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.8), ("c", "d", -0.7)], "f1 string, f2 string, corr double")
    names = spark.createDataFrame([("d",), ("c",), ("b",), ("a",)], "factor_id string")
    assert sorted(r[0] for r in combine.orthogonal_select(pairs, names, 0.6).collect()) == ["a", "c"]


def test_orthogonal_select_is_the_greedy_pass(spark):
    """A random graph, and a chain in which every other factor stays."""
    import random

    rng = random.Random(4)
    names = [f"f{i:02d}" for i in range(40)]
    edges = [(a, b, 0.9) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.08]
    for edges in (edges, [(a, b, -0.7) for a, b in zip(names, names[1:], strict=False)], []):
        near = {frozenset(e[:2]) for e in edges}
        want = []
        for f in names:
            if not any(frozenset((f, k)) in near for k in want):
                want.append(f)
        got = combine.orthogonal_select(spark.createDataFrame(edges, "f1 string, f2 string, corr double"), spark.createDataFrame([(n,) for n in names], "factor_id string"))
        assert sorted(r[0] for r in got.collect()) == want


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.02, (40, 3))
    rows = [(f"f{j}", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x[i, j])) for i in range(40) for j in range(3)]
    got = combine.ridge_weights(spark.createDataFrame(rows, "factor_id string, date date, ls_return double"), ["f0", "f1", "f2"])
    aug = np.vstack([x, math.sqrt(0.1) * np.eye(3)])
    w = np.abs(np.linalg.lstsq(aug, np.append(x.mean(axis=1), np.zeros(3)), rcond=None)[0])
    assert np.allclose([got[f"f{j}"] for j in range(3)], w / w.sum(), atol=1e-4)


def test_lineage_with_cycle(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")]
    got = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in lifecycle.lineage(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert got["c"] == ("a", 2, False) and got["a"] == ("a", 0, False) and got["o"] == ("o", 0, False)
    assert all(got[n][2] and got[n][0] is None for n in "xyz")


def test_costs(spark):
    r = spark.range(1).select(
        portfolio.buy_rate(1e6).alias("b"), portfolio.sell_rate(1e6).alias("s"), portfolio.buy_rate(100.0).alias("tiny"), portfolio.buy_rate(1e6, 0.04).alias("moved")
    ).first()
    assert abs(r["b"] - 0.0005) < 1e-12 and abs(r["s"] - 0.0015) < 1e-12
    assert abs(r["tiny"] - 0.0502) < 1e-12 and abs(r["moved"] - 0.0205) < 1e-12


def test_weights_sum_to_one(panel):
    chosen = portfolio.select_side(panel.withColumn("factor_value", F.col("y")), 20, 10)
    for scheme in ("equal", "score", "ic_rank", "sector_neutral"):
        sums = portfolio.weigh(chosen, scheme, -0.01).groupBy("date", "side").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        assert all(abs(abs(s["w"]) - 1) < 1e-9 for s in sums)
        assert {s["n"] for s in sums} == {20, 10}


def simulate(closes, sigs, c=0.0003, s=0.0002):
    cash, shares, pos, out = 1.0, 0.0, 0, []
    for p, g in zip(closes, sigs):
        if g == 1 and not pos:
            shares, cash, pos = cash / (p * (1 + c + s)), 0.0, 1
        elif g == -1 and pos:
            cash, shares, pos = shares * p * (1 - c - s), 0.0, 0
        out.append(cash + shares * p)
    return out


def test_signal_returns_match_row_by_row(panel):
    sig = signals.ma_cross(panel.select("date", "asset", "close"), 2, 4)
    held = by_asset(signals.positions(sig), "close", "signal", "equity")
    for _, g in held.groupby("asset"):
        assert np.allclose(g["equity"], simulate(g["close"], g["signal"]), rtol=1e-10)
    grid = signals.ma_grid(panel.select("date", "asset", "close"), [(2, 4), (3, 5)])
    one = by_asset(grid.filter("short = 2"), "signal")
    assert (one["signal"] == held["signal"]).all()



def test_grid_metrics_are_those_of_every_place_by_itself(spark, panel_pdf):
    rows = [(d, a, None if i % 37 == 0 else c) for i, (d, a, c) in enumerate(panel_pdf[["date", "asset", "close"]].itertuples(index=False))]
    rows += [(None, "000003", 9.0), (rows[0][0], None, 8.0), (rows[-1][0], None, 7.0), (rows[0][0], "alone", 3.0), (rows[-1][0], "blank", None)]
    p = spark.createDataFrame(rows, "date date, asset string, close double")
    grid = {"ma_cross": [(2, 4), (3, 5)], "channel_breakout": [(2, 3)]}
    by = ["asset", "strategy", "short", "long", "filters"]
    made = signals.grid_metrics(*signals.strategy_signals(p, grid, 0.6))
    # no row for each place before the asset's rows are taken together
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    want = signals.signal_metrics(signals.positions(signals.strategy_grid(p, grid, 0.6), by), by).toPandas()
    got = made.toPandas()
    assert set(got.columns) == set(want.columns)
    got, want = (d.fillna({"asset": ""}).sort_values(by).reset_index(drop=True) for d in (got, want))
    assert len(got) == 12 * p.select("asset").distinct().count() and (got["trade_count"] > 0).any() and (got["win_rate"] > 0).any()
    named = want["asset"] != ""  # a null asset has no win rate in a join
    assert np.allclose(got["win_rate"][named], want["win_rate"][named])
    for c in want.columns:
        if c in by:
            assert (got[c] == want[c]).all()
        elif c != "win_rate":
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, equal_nan=True), c



def test_exposure_reads_its_rows_once(spark):
    rng = np.random.default_rng(3)
    rows = [("a", g, None if i % 9 == 0 else float(rng.normal()), float(rng.uniform(1, 9))) for i, g in enumerate(["x", "y", "z", "w", None] * 20)]
    rows += [("b", "x", 2.0, 3.0), ("b", "y", None, 4.0), ("c", "x", None, 5.0)]
    long = spark.createDataFrame(rows, "factor_id string, industry string, factor_value double, market_cap double")
    d = ic.exposure(long)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {r["factor_id"]: r for r in d.collect()}
    pdf = pd.DataFrame(rows, columns=["factor_id", "g", "v", "cap"])
    a = pdf[(pdf.factor_id == "a") & pdf.v.notna()]
    m = a.groupby("g", dropna=False)["v"].mean()
    assert np.isclose(got["a"]["industry_exposure"], m.abs().max())
    assert got["a"]["top_industries"] == ",".join(g for g in m.abs().sort_values(ascending=False).index[:3] if isinstance(g, str))
    assert np.isclose(got["a"]["cap_exposure"], abs(np.corrcoef(a.v, np.log(a.cap))[0, 1]))
    assert tuple(got["b"]) == ("b", 0.0, 2.0, "x")
    assert tuple(got["c"]) == ("c", 0.0, None, None)


def test_walk_forward_folds_restart(panel):
    d = signals.walk_forward(panel.select("date", "asset", "close"), "ma_cross", [(2, 3), (2, 4)], (2, 4), 10, 5, 5).toPandas()
    assert set(d["fold"]) == {0, 1, 2}
    pdf = panel.filter("asset = '000003'").select("date", "close").toPandas().sort_values("date", ignore_index=True)
    row = d[(d["asset"] == "000003") & (d["fold"] == 1)].iloc[0]
    test = pdf["close"].iloc[15:20].reset_index(drop=True)
    short, long = test.rolling(row["short"], min_periods=1).mean(), test.rolling(row["long"], min_periods=1).mean()
    sig = np.where((short > long) & (short.shift(1) <= long.shift(1)), 1, np.where((short < long) & (short.shift(1) >= long.shift(1)), -1, 0))
    total = simulate(test, sig)[-1] - 1
    assert abs(row["test_annual_return"] - ((1 + total) ** (252 / 5) - 1)) < 1e-9


def test_constrained_weights(spark):
    ranking = spark.createDataFrame([("a", 0.8, 0.2, -0.1), ("b", 0.4, 0.3, -0.2), ("c", 0.1, 0.1, -0.05)], "strategy string, composite_score double, realized_volatility double, max_drawdown double")
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", -0.2), ("b", "c", 0.1)], "s1 string, s2 string, corr double")
    d = signals.constrained_weights(ranking, pairs).orderBy("strategy").toPandas()
    corr = np.array([[1, 0.5, -0.2], [0.5, 1, 0.1], [-0.2, 0.1, 1]])
    score = np.array([0.8, 0.4, 0.1]) / 1.3 * np.clip(1 - np.abs(corr).mean(axis=0), 0.1, None)
    w = np.clip(score / score.sum(), 0.1, 0.45)
    w = w / w.sum()
    vol = np.array([0.2, 0.3, 0.1])
    target = round(min(0.25, max(0.08, vol.mean() * 0.9)), 4)
    if w @ vol > target:
        w = np.maximum(w * target / (w @ vol), 0.05)
        w = w / w.sum()
    assert np.allclose(d["weight"], w, atol=1e-4)
    assert abs(d["diversification_score"].iloc[0] - max(0, min(1, 1 - max(0, w @ corr @ w)))) < 1e-4


def test_suspension_and_gap_detection(spark):
    base = dt.date(2024, 1, 1)
    rows = [("a", base + dt.timedelta(days=i), 10.0, 0.0 if 3 <= i < 9 else 5.0) for i in range(12)]
    rows += [("b", base + dt.timedelta(days=i), 10.0 if i < 5 else 4.0, 5.0 if i != 5 else 50.0) for i in range(12)]
    df = spark.createDataFrame(rows, "asset string, date date, close double, volume double")
    run = quality.suspensions(df).collect()
    assert [(r["asset"], r["run_length"]) for r in run] == [("a", 6)]
    assert [r["asset"] for r in quality.price_gaps(df).collect()] == ["b"]
    assert [(r["asset"], r["action"]) for r in quality.corporate_actions(df).collect()] == [("b", "split")]


def test_csv_round_trip(spark, tmp_path):
    text = "date,ts_code,close,volume,industry\n20240102,000001.SZ,10.5,100,bank\n20240102,000001.SZ,10.5,100,bank\n20240103,000001.SZ,x,100,bank\n2024-01-04,600000.SH,9,50,nan\n"
    (tmp_path / "p.csv").write_text(text)
    d = ingest.clean_panel(ingest.read_table(spark, str(tmp_path / "p.csv"))).orderBy("asset").toPandas()
    assert list(d["asset"]) == ["000001", "600000"] and list(d["industry"]) == ["bank", "unknown"]
    assert list(d["market_cap"]) == [1050.0, 450.0]
    panel = spark.createDataFrame(d)
    for fmt in ("csv", "parquet"):
        ingest.export_panel(panel, str(tmp_path / fmt), fmt)
        assert ingest.read_table(spark, str(tmp_path / fmt), fmt).count() == 2
    ingest.export_results({"metrics": panel, "trades": panel}, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "trades")).count() == 2
    with pytest.raises(ValueError):
        ingest.export_panel(panel, str(tmp_path / "no"), "xlsx")
    with pytest.raises(ValueError):
        ingest.clean_panel(panel.drop("close"))


def test_json_readers(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps({"entries": [{"factor_id": "a", "scorecard": {"rank_ic": 0.1}}, {"factor_id": "b", "scorecard": None}]}))
    assert {r["factor_id"] for r in library.read_library(spark, str(tmp_path / "lib.json")).collect()} == {"a", "b"}
    (tmp_path / "exp").mkdir()
    for i in range(3):
        doc = {"experiment_id": f"e{i}", "timestamp": f"2024-01-0{i + 1}", "experiment_type": "grid", "metrics": {"annual_return": 0.0, "train_annual_return": 0.1 * i}, "notes": {"k": 1}}
        (tmp_path / "exp" / f"{i}.json").write_text(json.dumps(doc, indent=1))
    d = library.experiments(library.read_experiments(spark, str(tmp_path / "exp"))).collect()
    assert [r["experiment_id"] for r in d] == ["e2", "e1", "e0"] and d[0]["primary_metric"] == pytest.approx(0.2)


def test_ic_log_stream_replay(spark, tmp_path):
    log, ckpt, out = (str(tmp_path / n) for n in ("log", "ckpt", "out"))
    for day in (1, 2, 3):
        rows = spark.createDataFrame([("a", dt.date(2024, 1, day), 0.1 * day), ("b", dt.date(2024, 1, day), None)], panel_stream.IC_LOG)
        panel_stream.append_ic(rows, log)
        panel_stream.run_ic_log(spark, log, ckpt, out).awaitTermination()
    got = {r["factor_id"]: (r["n"], r["mean_ic"]) for r in spark.read.parquet(out).collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 0.2) < 1e-12 and got["b"][0] == 0


def test_survivorship_ends_with_all_rows(spark):
    """Assets that end 40 days before a late lister are delisted, though the late lister is dropped itself."""
    from factorloom.operators import quality

    days = [(f"2024-{m:02d}-{d:02d}") for m in range(1, 7) for d in range(1, 29)]
    rows = [(t, a, 10.0) for t in days[:100] for a in "abcd"] + [(t, "late", 10.0) for t in days[90:140]]
    df = spark.createDataFrame(rows, "date string, asset string, close double").withColumn("date", F.col("date").cast("date"))
    assert quality.survivorship_filter(df, 60, 20, 1).count() == 0
    assert quality.survivorship_filter(df.filter("asset != 'late'"), 60, 20, 1).select("asset").distinct().count() == 4


def test_clean_panel_keeps_the_first_usable_copy(spark):
    from factorloom.sources import ingest

    rows = [("2024-01-01", "1", "n/a", "5", 1), ("2024-01-01", "1", "10.5", "5", 2), ("2024-01-02", "1", "3", "5", 1), ("2024-01-02", "1", "n/a", "5", 2), ("2024-01-03", "1", "9", "5", 1), ("2024-01-03", "1", "8", "5", 2)]
    df = spark.createDataFrame(rows, "date string, asset string, close string, volume string, seq int")
    got = [r["close"] for r in ingest.clean_panel(df, arrival=["seq"]).orderBy("date").collect()]
    assert got == [10.5, 3.0, 9.0]
    assert [r["close"] for r in ingest.clean_panel(df.drop("seq")).orderBy("date").collect()] == [10.5, 3.0, 8.0]


def test_decay_curve_counts_a_window_without_dates_as_zero(panel):
    from factorloom.operators import ic

    long = panel.select(F.lit("f").alias("factor_id"), "date", "asset", F.col("x").alias("factor_value"), F.col("y").alias("l1"), F.lit(None).cast("double").alias("l2"))
    got = {r["horizon"]: (r["ic_mean"], r["n_dates"]) for r in ic.decay_curve(long, {1: "l1", 2: "l2"}).collect()}
    assert got[2] == (0.0, 0) and got[1][1] == 25
    assert {r["half_life"] for r in ic.decay_curve(long, {1: "l1", 2: "l2"}).collect()} == {2}


def test_sweep_searches_each_operator_by_itself():
    from factorloom.plans import sweep
    from factorloom.plans.factors import field, over, rank

    t = rank(over("ts_mean", over("delta", field("close"), 5), 20)).node
    space = sweep.default_space(t)
    assert space == {"ts_mean__window": sweep.SPACES["window"], "delta__window": sweep.SPACES["window"]}
    assert len(sweep.variants(t, space)) == 36
    both = sweep.with_parameters(t, {"delta__window": 3})
    assert {n["op"]: n["params"].get("window") for n in sweep.nodes_of(both) if n.get("params")} == {"ts_mean": 20, "delta": 3}
