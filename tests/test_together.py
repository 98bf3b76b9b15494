"""Many columns of a date at once against the plans of one window for each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import ic, together, xsec
from factorloom.plans import tree
from factorloom.plans.factors import NAMED, const, field, op, over, rank

NAMES = [f"f.{i}" for i in range(together.BLOCK + 3)]


@pytest.fixture(scope="module")
def frame(spark):
    """Ties, gaps, NaN, a constant column, a date without a name and repeated keys."""
    rng = np.random.default_rng(5)
    rows = []
    for d in [*pd.date_range("2024-01-01", periods=4), None]:
        for a in range(60):
            values = [None if rng.random() < 0.1 else float(rng.integers(0, 9)) for _ in NAMES]
            values[1], values[2] = 7.0, float("nan") if a % 7 == 0 else values[2]
            rows.append((d.date() if d is not None else None, f"{a % 50:03d}", None if a % 11 == 0 else float(rng.normal()), *values))
    return spark.createDataFrame(rows, "date date, asset string, label double, " + ", ".join(f"`{n}` double" for n in NAMES))


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scores_equal_those_of_rows_for_each_factor(frame):
    long = frame.unpivot(["date", "asset", "label"], [F.col(f"`{n}`") for n in NAMES], "factor_id", "factor_value")
    for how in (ic.STANDARD, ic.DECAY, ic.SCORECARD_RANK):
        cols = ["factor_id", "date", "n", "n_rows", "n_values", F.round("rank_ic", 10)]
        want = sorted_rows(ic.date_scores(long, how).select(*cols))
        assert sorted_rows(ic.frame_scores(frame, NAMES, how).select(*cols)) == want
    assert len(want) == 5 * len(NAMES)


def test_ranks_equal_windows(frame):
    xs = {f"r{i}": f"x{i}" for i in range(4)}
    d = frame.select("date", "asset", "label", *[F.col(f"`{n}`").alias(x) for n, x in zip(NAMES, xs.values())])
    want = d.select("date", "asset", "label", *[xsec.rank_expr(x).alias(out) for out, x in xs.items()])
    assert sorted_rows(together.rank_columns(d, xs)) == sorted_rows(want)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_factors_are_not_sorted_one_by_one(frame):
    trees = {f"t{i}": rank(field("label") + float(i)).node for i in range(together.MANY)}
    df = tree.evaluate(frame.select("date", "asset", "label"), trees)
    assert "Window" not in plan_of(df) and "FlatMapGroupsInArrow" in plan_of(df)
    assert "Expand" not in plan_of(ic.frame_rank_ic(frame, NAMES))


def test_dates_before_series_while_the_panel_is_narrow(frame):
    x = field("label")
    trees = {"a": rank(over("ts_mean", op("demean", x), 3)).node, "b": over("ts_std", x, 3).node, "c": rank(x * const(2.0)).node}
    got = tree.evaluate(frame.select("date", "asset", "label"), trees, keep=["date", "asset"])
    assert got.columns == ["date", "asset", "a", "b", "c"]
    assert plan_of(got).count("RepartitionByExpression") == 0 and got.count() == frame.count()


def test_named_factors_keep_their_fields():
    nodes = {}
    tree._collect(NAMED["Quality_EP_Stable"], nodes)
    assert "pe" in tree._columns_used([NAMED["Quality_EP_Stable"]], {}, {k: "_n" for k in nodes})


def test_four_factors_are_ranked_together_without_other_columns(spark, tmp_path):
    """Also from four ranks on; a date's rows hold what is asked for alone."""
    import datetime as dt

    from factorloom.catalog.evaluation import factor_frame
    from factorloom.catalog.sqlkit import FOUR

    lines = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 200), i % 7, 10.0 + i % 13, 1.0 + i % 3, 0.05) for i in range(1400)]
    names = "l_shipdate date, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    df, _ = factor_frame(spark, str(tmp_path))
    assert df.columns == ["date", "asset", "label", *FOUR]
    assert "FlatMapGroupsInArrow" in plan_of(df)
    ranks = [r for r in df.collect() if r["Size_Volume"] is not None]
    assert ranks and all(0 < r["Size_Volume"] <= 1 for r in ranks)


def long_of(frame, names=NAMES):
    return frame.unpivot(["date", "asset", "label"], [F.col(f"`{n}`") for n in names], "factor_id", "factor_value")


@pytest.fixture(scope="module")
def unique(frame):
    """One row for each date and asset, so that ties have one order."""
    return frame.dropDuplicates(["date", "asset"]).cache()


def test_rank_mean_of_columns_equals_rows(frame):
    from factorloom.operators import combine

    cols = ["date", "asset", F.round("score", 10), "n_factors"]
    got = combine.frame_rank_mean(frame, NAMES)
    assert "Window" not in plan_of(got) and "Expand" not in plan_of(got)
    assert sorted_rows(got.select(*cols)) == sorted_rows(combine.combine_rank_mean(long_of(frame)).select(*cols))


def test_buckets_of_columns_equal_rows(frame):
    cols = ["factor_id", "date", "bucket", F.round("bucket_return", 10)]
    got = together.bucket_columns(frame, NAMES, 5, "label")
    assert "Window" not in plan_of(got)
    assert sorted_rows(got.select(*cols)) == sorted_rows(ic.bucket_returns(long_of(frame), 5).select(*cols))


def test_top_names_of_columns_equal_rows(unique):
    cols = ["factor_id", "date", "asset", "label"]
    got = ic.frame_top_members(unique, NAMES, keep=["label"])
    assert "Window" not in plan_of(got)
    assert sorted_rows(got.select(*cols)) == sorted_rows(ic.top_members(long_of(unique)).select(*cols))
    pairs = long_of(unique).filter("factor_value IS NOT NULL AND label IS NOT NULL")
    varied = pairs.join(ic.varied_dates(pairs, 5), ["factor_id", "date"], "left_semi")
    got = ic.frame_top_members(unique, NAMES, keep=["label"], label="label", distinct=5)
    assert sorted_rows(got.select(*cols)) == sorted_rows(ic.top_members(varied).select(*cols))


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Star tables of 40 suppliers over 60 weeks."""
    import datetime as dt

    home = str(tmp_path_factory.mktemp("lines"))
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 420), (i + i // 420) % 40, 10.0 + i % 13 + i % 7, 1.0 + i % 3, 0.05) for i in range(9000)]
    spark.createDataFrame(rows, "l_shipdate date, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{home}/lineitem.parquet")
    spark.createDataFrame([(i, i % 3) for i in range(40)], "s_suppkey long, s_nationkey long").write.parquet(f"{home}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey long, n_name string").write.parquet(f"{home}/nation.parquet")
    return home


ONCE = "i_oos_ic_check i_scorecard m_delivery_screen b_ic_vs_return b_turnover_cost_impact c_crowding_penalty m_governance_severity".split()


@pytest.mark.parametrize("name", [*ONCE, "i_top_bucket_turnover"])
def test_the_panel_is_derived_once(spark, lines, name):
    """The result starts from what is kept: its plan reads no line items again."""
    from factorloom import catalog

    catalog.load_all()
    df = catalog.QUERIES[name](spark, lines)
    assert "l_shipdate" not in plan_of(df)


def test_common_dates_count_without_rows_for_each_factor(spark, lines):
    from factorloom import catalog
    from factorloom.catalog.evaluation import factor_long

    catalog.load_all()
    df = catalog.QUERIES["u_common_dates"](spark, lines)
    assert "Expand" not in plan_of(df)
    long = factor_long(spark, lines)[0].filter("factor_value IS NOT NULL").groupBy("date")
    want = long.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("factor_id").alias("k")).filter("k = 4")
    assert sorted_rows(df) == sorted_rows(want.select(F.col("date").cast("string"), "n"))
