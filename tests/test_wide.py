"""The split plans for oversized groups give the same rows as the windows and as pandas."""

import pandas as pd
from pyspark.sql import functions as F

from factorloom.operators import ic, ordered, xsec
from factorloom.plans import tree
from factorloom.plans.factors import field, op, rank


def frame(df, *cols):
    return df.select("date", "asset", *cols).toPandas().sort_values(["date", "asset"], ignore_index=True)


def same(a, b):
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12, atol=1e-12)


def test_order_stats_match_pandas(tiny_groups, panel, panel_pdf):
    got = ordered.order_stats(panel, ["date"], "x", "o", row_number=True, wide=True).toPandas()
    got = got.sort_values(["date", "asset"], ignore_index=True)
    want = panel_pdf.sort_values(["date", "asset"], ignore_index=True)
    g = want.groupby("date")["x"]
    assert len(got) == len(want)
    same(got[["o_n"]].astype(float), pd.DataFrame({"o_n": g.transform("count").astype(float)}))
    same(got[["o_lt"]], pd.DataFrame({"o_lt": g.rank(method="min") - 1}))
    same(got[["o_eq"]], pd.DataFrame({"o_eq": g.rank(method="max") - g.rank(method="min") + 1}))
    same(got[["o_rn"]], pd.DataFrame({"o_rn": g.rank(method="first")}))


def test_descending_and_grouped(tiny_groups, panel):
    for keys in (["date"], ["date", "industry"]):
        a = ordered.order_stats(panel, keys, "x", "o", descending=True, row_number=True)
        b = ordered.order_stats(panel, keys, "x", "o", descending=True, wide=True)
        same(frame(a, "o_n", "o_lt", "o_eq", "o_rn"), frame(b, "o_n", "o_lt", "o_eq", "o_rn"))


def test_one_value_fills_the_group(tiny_groups, panel):
    flat = panel.withColumn("x", F.lit(1.0))
    a, b = xsec.rank(flat, "x", "r"), xsec.rank(flat, "x", "r", wide=True)
    same(frame(a, "r"), frame(b, "r"))


def test_operators_wide(tiny_groups, panel):
    for run in (
        lambda d, w: xsec.rank(d, "x", "v", wide=w),
        lambda d, w: xsec.quantile(d, "x", "v", 5, wide=w),
        lambda d, w: xsec.top_n(d, "x", "v", 10, wide=w),
        lambda d, w: xsec.bottom_n(d, "x", "v", 10, ["date", "industry"], wide=w),
        lambda d, w: xsec.zscore(d, "x", "v", wide=w),
        lambda d, w: xsec.zscore_pop(d, "x", "v", wide=w),
        lambda d, w: xsec.moment(d, "scale", "x", "v", wide=w),
        lambda d, w: xsec.moment(d, "median", "x", "v", ["date", "industry"], wide=w),
        lambda d, w: xsec.winsorize_mad(d, "y", "v", 1.0, wide=w),
        lambda d, w: xsec.fill_missing(d, "x", "v", wide=w),
    ):
        same(frame(run(panel, False), "v"), frame(run(panel, True), "v"))


def test_group_quantiles(tiny_groups, panel, panel_pdf):
    got = ordered.group_quantiles(panel, ["date"], "y", {"q": 0.37}, wide=True).toPandas().set_index("date")["q"]
    want = panel_pdf.groupby("date")["y"].quantile(0.37)
    assert (got.sort_index() - want.sort_index()).abs().max() < 1e-12


def test_trees_and_ic_wide(tiny_groups, panel):
    trees = {
        "a": rank(op("ts_mean", field("x"), window=3)).node,
        "b": op("group_zscore", op("rank", field("y"))).node,
        "c": op("rolling_ols_residual", field("y"), window=4).node,
    }
    labelled = ic.with_label(panel, 2)
    a, b = tree.evaluate(labelled, trees), tree.evaluate(labelled, trees, wide=True)
    same(frame(a, *trees), frame(b, *trees))
    one = ic.batch_rank_ic(tree.long_form(a, trees, ["label"])).toPandas().sort_values("factor_id", ignore_index=True)
    two = ic.batch_rank_ic(tree.long_form(b, trees, ["label"]), wide=True).toPandas().sort_values("factor_id", ignore_index=True)
    same(one, two)
    q1 = ic.quantile_returns(tree.long_form(a, trees, ["label"])).toPandas().sort_values("factor_id", ignore_index=True)
    q2 = ic.quantile_returns(tree.long_form(a, trees, ["label"]), wide=True).toPandas().sort_values("factor_id", ignore_index=True)
    same(q1, q2)
