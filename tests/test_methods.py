"""Operators that were built for tables of any size, against pandas, numpy or nested loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import contain, gram, hypothesis, ic, library, oos, ranges, ts
from factorloom.operators.portfolio import recent_ic


def test_correlation_far_from_zero(spark):
    """A mean of 10^9 with a spread of 1, gaps, a constant column; many tasks."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=4000)
    x = {"a": 1e9 + base, "b": -1e9 + 0.3 * base + rng.normal(size=4000), "c": rng.normal(size=4000), "d": np.full(4000, 7.7)}
    pdf = pd.DataFrame(x)
    pdf.loc[rng.random(4000) < 0.2, "b"] = np.nan
    pdf.loc[:100, "c"] = np.nan
    got = {(r["f1"], r["f2"]): r for r in gram.pair_corr(spark.createDataFrame(pdf).repartition(130), list(pdf)).collect()}
    centred = pdf - pdf.mean()
    for (f, g), r in got.items():
        pair = centred[[f, g]].dropna()
        assert r["n"] == len(pair)
        if "d" in (f, g):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(pair[f].corr(pair[g]), abs=1e-10)
    assert gram.pair_corr(spark.createDataFrame(pdf).limit(0), list(pdf)).count() == 0


def test_step_up_by_family(spark):
    rng = random.Random(5)
    rows = [(fam, f"k{i:03d}", rng.choice([0.001, 0.01, 0.02, 0.3, 0.9, None]) if i % 3 else rng.random() ** 3) for fam in "ab" for i in range(120)] + [(None, "x", 0.04)]
    df = spark.createDataFrame(rows, "family string, factor_id string, p double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    got = {(r["family"], r["factor_id"]): r for r in hypothesis.benjamini_hochberg(df, "p", by=["family"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    for fam in ("a", "b", None):
        mine = sorted(((1.0 if p is None else p), k) for f, k, p in rows if f == fam)
        n, last = len(mine), 0
        raw = [min(1.0, p * n / (i + 1)) for i, (p, _) in enumerate(mine)]
        for i, (p, _) in enumerate(mine):
            last = i + 1 if p <= 0.05 * (i + 1) / n else last
        for i, (_, k) in enumerate(mine):
            r = got[fam, k]
            assert r["adjusted_p"] == pytest.approx(min(raw[i:])) and r["rejected"] == (i < last)
            assert r["n_rejected"] == last and r["n_total"] == n and r["threshold"] == pytest.approx(mine[last - 1][0] if last else 0.0)


def test_ranks_where_one_value_crosses_many_ranges(spark):
    rows = [("g", i, 1.0 if 20 <= i < 480 else float(i)) for i in range(500)] + [("h", i, 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(6)
    got = {(r["k"], r["i"]): r for r in ranges.group_ranks(df, ["k"], "v", ["i"], "o").collect()}
    for k in "gh":
        values = pd.Series({i: v for g, i, v in rows if g == k})
        low, high, first = values.rank(method="min"), values.rank(method="max"), values.sort_index().rank(method="first")
        for i in values.index:
            r = got[k, i]
            assert (r["o_n"], r["o_lt"], r["o_eq"], r["o_rn"]) == (len(values), low[i] - 1, high[i] - low[i] + 1, first[i])


def test_contained_strings(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAé ") for _ in range(n))
    a, b = [word(rng.randint(0, 6)) for _ in range(60)] + ["", "ab", None], [word(rng.randint(0, 12)) for _ in range(60)] + ["ab", "", None]
    df = lambda v, c: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = {tuple(r) for r in contain.either_way(df(a, "x"), df(b, "y"), "x", "y").collect()}
    assert got == {(x, y) for x in a for y in b if x is not None and y is not None and (x in y or y in x)}


def test_ema_over_blocks_and_gaps(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for asset, n in (("a", 300), ("b", 3), ("c", 65)):
        x = rng.normal(size=n)
        x[rng.random(n) < 0.3] = np.nan
        if asset == "a":
            x[:40], x[120:200] = np.nan, np.nan  # nothing seen in the whole first block, a gap over whole blocks
        dates = pd.date_range("2024-01-01", periods=n)
        rows += [(asset, d.date(), None if np.isnan(v) else float(v)) for d, v in zip(dates, x, strict=True)]
        want |= {(asset, d.date()): v for d, v in zip(dates, pd.Series(x).ewm(alpha=0.2, adjust=False).mean(), strict=True)}
    df = ts.ema(spark.createDataFrame(rows, "asset string, date date, x double").repartition(4), "x", "y", 0.2)
    assert df.columns == ["asset", "date", "x", "y"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    for r in df.collect():
        w = want[r["asset"], r["date"]]
        assert (r["y"] is None and np.isnan(w)) or r["y"] == pytest.approx(w, abs=1e-12)


def test_extremes_of_doubled_windows(spark):
    rng = np.random.default_rng(9)
    x = pd.Series(rng.integers(0, 50, 90).astype(float))
    x[[17, 60]] = np.nan
    rows = [("a", d.date(), None if np.isnan(v) else v) for d, v in zip(pd.date_range("2024-01-01", periods=90), x, strict=True)]
    got = ts.previous_extremes(spark.createDataFrame(rows, "asset string, date date, close double"), "close", [1, 2, 5, 8, 21]).toPandas().sort_values("date")
    for k in (1, 2, 5, 8, 21):
        for name, want in ((f"_u{k}", x.rolling(k).max().shift(1)), (f"_d{k}", x.rolling(k).min().shift(1))):
            assert np.allclose(got[name].to_numpy(float), want.to_numpy(), equal_nan=True), name


def test_sample_check(spark):
    """By date without gaps, as a whole with them, zeros for fewer than fifty pairs."""
    rng = np.random.default_rng(6)
    dates = pd.date_range("2024-01-01", periods=12)
    pdf = pd.DataFrame([(d.date(), f"a{i}", float(rng.integers(0, 9)), float(rng.normal())) for d in dates for i in range(20)], columns=["date", "asset", "factor_value", "label"])
    gaps = pdf.copy()
    gaps.loc[rng.random(len(gaps)) < 0.1, "label"] = np.nan
    parts = {"full": pdf, "gaps": gaps, "few": pdf[:49], "none": pdf[:60].assign(label=np.nan)}
    long = pd.concat([p.assign(factor_id=k) for k, p in parts.items()])
    df = spark.createDataFrame(long, "date date, asset string, factor_value double, label double, factor_id string").withColumn("label", F.nanvl("label", F.lit(None)))
    got = {r["factor_id"]: r for r in ic.sample_check(df).collect()}
    daily = pdf.groupby("date")[["factor_value", "label"]].apply(lambda g: g["factor_value"].rank().corr(g["label"].rank()))
    full = got["full"]
    assert full["oos_rank_ic"] == pytest.approx(daily.mean()) and full["oos_n_days"] == 12
    assert full["oos_ic_ir"] == pytest.approx(daily.mean() / (daily.std() + 1e-10)) and full["oos_positive_ratio"] == pytest.approx((daily > 0).mean())
    pair = gaps.dropna()
    whole = pair["factor_value"].rank().corr(pair["label"].rank())
    assert got["gaps"]["oos_rank_ic"] == pytest.approx(whole) and got["gaps"]["oos_n_days"] == 1 and got["gaps"]["oos_ic_ir"] == 0
    for k in ("few", "none"):
        assert tuple(got[k][c] for c in ("oos_rank_ic", "oos_ic_ir", "oos_positive_ratio", "oos_n_days")) == (0, 0, 0, 0)


def test_folds_with_too_few_rows_are_left_out(spark):
    dates = pd.date_range("2024-01-01", periods=60)
    panel = spark.createDataFrame([(d.date(), f"a{i}") for k, d in enumerate(dates) for i in range(8 if k < 40 else 2)], "date date, asset string")
    parts = oos.walk_forward_folds(panel, 20, 10, 10)
    sizes = {r["fold"]: (r["train_rows"], r["test_rows"], r["usable"]) for r in oos.fold_sizes(panel, parts).collect()}
    assert sizes == {0: (160, 80, True), 1: (160, 80, True), 2: (160, 20, False), 3: (100, 20, False)}
    assert {r["fold"] for r in oos.usable_folds(panel, parts).collect()} == {0, 1}


def test_direction_guidance_falls_back_to_all(spark):
    rows = [(1, "Momentum", "useful", 0.1, ["close"], {"size": 0.9}), (2, "momentum trend", "useless", -0.1, ["volume"], {"size": 0.9}), (3, "value", "marginal", 0.0, ["pe"], {"size": 0.0})]
    outcomes = spark.createDataFrame(rows, "id long, direction string, verdict string, rank_ic double, input_fields array<string>, exposures map<string,double>")
    asked = spark.createDataFrame([("MOMENTUM",), ("deep value names",), ("carry",)], "asked string")
    got = {r["asked"]: r for r in library.direction_guidance(outcomes, asked).collect()}
    m, v, c = got["MOMENTUM"], got["deep value names"], got["carry"]
    assert (m["useful"], m["useless"], m["marginal"], m["exposed_failures"], m["top_fields"], m["from_all"]) == (1, 1, 0, 1, "close", False)
    assert (v["useful"], v["marginal"], v["top_fields"], v["from_all"]) == (0, 1, "", False)
    assert (c["useful"], c["useless"], c["marginal"], c["from_all"]) == (1, 1, 1, True) and c["mean_ic"] == pytest.approx(0.0)


def test_recent_ic(spark):
    daily = lambda n: spark.createDataFrame([((pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).date(), float(i)) for i in range(n)], "date date, rank_ic double")
    assert recent_ic(daily(40)).first()[0] == pytest.approx(np.mean(range(20, 40)))
    assert recent_ic(daily(7)).first()[0] == pytest.approx(3.0)
    assert recent_ic(daily(4)).first()[0] == 0.0
