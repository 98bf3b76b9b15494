"""Trees in numpy against the plans of one window for each operator."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.operators import gram, ic
from factorloom.operators.ts import forward_return
from factorloom.plans import dense, sweep, tree
from factorloom.plans.factors import NAMED, const, field, op, over, rank


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def market(spark):
    """Ties, gaps, runs of one value, assets of 1 to 70 rows, one without a name, a date that is NULL and two groups with gaps."""
    rng = np.random.default_rng(11)
    rows = []
    for a in range(45):
        for t in range(70 if a % 4 else 1 + a):
            x = None if rng.random() < 0.12 else float(rng.integers(1, 9)) / 4
            y = 2.0 if a % 6 == 0 and t < 30 else float(rng.uniform(1, 3))
            day = None if t == 0 and a % 5 == 0 else dt.date(2024, 1, 1) + dt.timedelta(days=t)
            rows.append((day, None if a == 9 else f"{a:04d}", x, y, float(rng.integers(50, 90)), None if a % 9 == 0 else "AB"[a % 2]))
    return spark.createDataFrame(rows, "date date, asset string, x double, y double, close double, industry string").cache()


X, Y = field("x"), field("y")
ROLLED = {f"{o}_{w}": over(o, X, w) for o in ("delta", *sorted(dense.SERIES - {"ema", "ts_corr", "ts_cov"})) for w in (1, 3, 20)}
SHAPED = {
    "ema": op("ema", X, alpha=0.2),
    "corr": op("ts_corr", X, op("abs", over("delta", Y, 1) / Y), window=12),
    "cov": op("ts_cov", X, window=7),
    "flat": over("ts_std", Y, 5),
    "divided": X / (X - 1.0),
    "signs": op("sign", over("delta", X, 2)) * op("log", X - 1.0) - op("sqrt", X) + op("power", X, exponent=3.0),
    "cut": op("clip", X, lo=0.5, hi=1.5) + op("piecewise", X, threshold=1.0) * op("sigmoid", X),
    "twice": rank(rank(X) * rank(-Y)),
    "zscore": op("zscore", over("delta", X, 3)),
    "quantile": op("quantile", over("delta", X, 3), n=5),
    "residual": op("rolling_ols_residual", X, window=6),
    "constant": const(2.0),
    **{o: op(o, over("delta", X, 2)) for o in sorted(dense.GROUPED)},
}
TREES = {k: v.node for k, v in {**ROLLED, **SHAPED}.items()}


def frame_of(market, trees, labels):
    return tree.evaluate(market.withColumns({c: forward_return(h) for c, h in labels.items()}), trees, keep=["date", "asset", *labels])


def test_scores_equal_those_of_columns(market):
    labels = {"label": 2, "far": 5}
    assert dense.supports(TREES)
    frame = frame_of(market, TREES, labels).cache()
    got = dense.scores(market, TREES, labels).cache()
    cols = ["factor_id", "date", "n", "n_rows", "n_values", F.round("rank_ic", 9)]
    for label in labels:
        want = sorted_rows(ic.date_scores(tree.long_form(frame, TREES, [label]), ic.Convention(min_n=2), label=label).select(*cols))
        have = sorted_rows(ic.counted(got.filter(F.col("label") == label), ic.Convention(min_n=2)).select(*cols))
        assert have == want and len({r[1] for r in have}) == 71


def test_correlations_equal_those_of_columns(market):
    trees = {k: rank(v).node for k, v in SHAPED.items() if k not in ("constant", "quantile")}
    want = gram.pair_corr(frame_of(market, trees, {"label": 1}), list(trees))
    got = gram.corr_of(gram.whole_moments(dense.states(market, trees)))
    cols = ["f1", "f2", "n", F.round("corr", 9)]
    assert sorted_rows(got.select(*cols)) == sorted_rows(want.select(*cols))


def test_a_leaf_travels_once(market):
    """Equal trees are one, a change is a difference to a lag, and no group of a date has more leaves than the limit."""
    trees = {k: tree.order_core(t) for k, t in NAMED.items()}
    ((leaves, found),) = dense.Plan({k: dense._plain(t) for k, t in trees.items()}, ["label"], None).blocks
    assert sum(len(names) for _, names in found) == 63 and len(found) < 63 and len(leaves) < 50
    assert not any(n.get("op") == "delta" for n in leaves.values())
    grid = sweep.template_grid(["close", "x", "y"], [5, 10, 20])
    blocks = dense.Plan({k: dense._plain(t) for k, t in grid.items()}, ["label"]).blocks
    assert sum(len(names) for _, found in blocks for _, names in found) == len(grid)
    assert len(blocks) > 1 and all(len(leaves) <= dense.LEAVES for leaves, _ in blocks)


def test_unknown_operators_keep_the_other_plan(market):
    assert not dense.supports({"a": op("top_n", X, n=3).node})
    assert not dense.supports({"a": op("group_aggregate", X, func="median").node})
    assert dense.supports({"a": over("ts_mean", op("top_n", X, n=3), 4).node})
    with pytest.raises(ValueError):
        dense.scores(market, {"a": field("absent").node}, {"label": 1})


def test_assets_stay_whole_over_batches(monkeypatch):
    monkeypatch.setattr(dense, "CELLS", 4)
    names = [None, None, "a", "a", "a", "a", "a", "a", "b", "c", "c", "d"]

    def batches(names):
        for i in range(0, len(names), 3):
            yield pa.RecordBatch.from_pydict({"asset": pa.array(names[i : i + 3], pa.string())})

    got = [(t.column("asset").to_pylist(), starts.tolist()) for t, starts in dense._runs(batches(names))]
    assert sum((g for g, _ in got), []) == names and len(got) > 1
    assert sorted({n or "" for g, starts in got for n in [g[s] for s in starts]}) == ["", "a", "b", "c", "d"]
    assert sum(len(starts) for _, starts in got) == 5
    with pytest.raises(RuntimeError):
        list(dense._runs(batches(["a", "b", "a"])))
    with pytest.raises(RuntimeError):
        list(dense._runs(batches(["a", "a", "a", "b", "b", "b", "a", "a", "a", "c", "c", "c"])))


def test_packed_values_come_back():
    v = np.random.default_rng(1).normal(size=(3, 5))
    v[1, 2] = np.nan
    assert np.array_equal(dense._unpack(dense._pack(v), 3, 5), v, equal_nan=True)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Star tables of 40 suppliers over 60 weeks."""
    home = str(tmp_path_factory.mktemp("lines"))
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 420), (i + i // 420) % 40, i % 90, 10.0 + i % 13 + i % 7, 1.0 + i % 3, 0.05) for i in range(9000)]
    named = "l_shipdate date, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(rows, named).write.parquet(f"{home}/lineitem.parquet")
    spark.createDataFrame([(i, 5.0 + i) for i in range(90)], "p_partkey long, p_retailprice double").write.parquet(f"{home}/part.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(40)], "s_suppkey long, s_nationkey long").write.parquet(f"{home}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey long, n_name string").write.parquet(f"{home}/nation.parquet")
    return home


@pytest.mark.parametrize("name", ["o_parameter_sweep", "o_template_grid", "i_named_factors_ic", "i_evaluate_named", "i_ic_decay_curve", "i_benchmark_correlation"])
def test_factor_columns_never_travel(spark, lines, name):
    """One grouped pass over packed rows, no rolling frame for each series, no row or column for each factor on its way to the dates."""
    from factorloom import catalog

    catalog.load_all()
    text = plan_of(catalog.QUERIES[name](spark, lines))
    assert text.count("FlatMapGroupsInArrow") == 1 and text.count("MapInArrow") >= 1
    assert "Expand" not in text and "stddev_pop" not in text.split("FlatMapGroupsInArrow")[1] and "collect_list" not in text.split("FlatMapGroupsInArrow")[1]


@pytest.mark.parametrize("name", ["m_decay_check", "h_ic_p_value_fdr"])
def test_results_equal_those_of_columns(spark, lines, name, monkeypatch):
    """The plan by columns, for trees with operators of their own, gives the same rows."""
    from factorloom import catalog

    catalog.load_all()
    got = sorted_rows(catalog.QUERIES[name](spark, lines))
    monkeypatch.setattr(dense, "supports", lambda trees: False)
    assert got == sorted_rows(catalog.QUERIES[name](spark, lines)) and got


def test_pairs_equal_those_of_columns(spark, lines):
    from factorloom import catalog
    from factorloom.catalog.evaluation import factor_frame, named_pairs

    catalog.load_all()
    want = gram.pair_corr(factor_frame(spark, lines, list(NAMED))[0], list(NAMED))
    cols = ["f1", "f2", "n", F.round("corr", 8)]
    got = named_pairs(spark, lines)
    assert "FlatMapGroupsInArrow" in plan_of(got) and sorted_rows(got.select(*cols)) == sorted_rows(want.select(*cols))
