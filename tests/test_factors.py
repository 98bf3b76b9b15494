"""All named factors and the flagship scores against plain pandas on the provided tables."""

import brute
import numpy as np
import pandas as pd
import pytest
from brute import SF_DIR

from factorloom.catalog.evaluation import flagship
from factorloom.plans import sweep, tree
from factorloom.plans.factors import EQUITY, NAMED, available
from factorloom.sources.adapters import ALL_FIELDS, weekly_panel


@pytest.fixture(scope="module")
def market(spark):
    pdf = weekly_panel(spark, SF_DIR, ALL_FIELDS).toPandas().sort_values(["asset", "date"], ignore_index=True)
    return pdf


def test_counts():
    assert len(EQUITY) == 44 and len(NAMED) == 63
    assert len(tree.OPERATORS) == 48


def test_every_named_factor(spark, market):
    df = tree.evaluate(weekly_panel(spark, SF_DIR, ALL_FIELDS), NAMED)
    got = df.select("date", "asset", *NAMED).toPandas().sort_values(["asset", "date"], ignore_index=True)
    for name, node in NAMED.items():
        want = brute.evaluate(node, market)
        a, b = got[name].to_numpy(float), want.to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), name
        # Rolling sums differ in the last bits, which can swap near-equal ranks.
        close = np.isclose(a, b, atol=1e-9, equal_nan=True)
        assert close.mean() > 0.995, (name, (~close).sum())


def test_flagship(spark, market):
    got = flagship(spark, SF_DIR).toPandas().set_index("factor_id")
    for name in ["Momentum_1m", "Value_Composite", "Reversal_Vol_Normalized_5d", "cb_double_low", "A_Share_Vol_Price_Coupling"]:
        v = brute.evaluate(NAMED[name], market)
        ics = brute.rank_ic(v, market)
        assert got.loc[name, "n_dates"] == len(ics)
        # pandas' running correlation leaves noise on two-row windows, which breaks their ties at +-1.
        loose = 10 if "Coupling" in name else 1
        assert abs(got.loc[name, "ic_mean"] - ics.mean()) < 2e-4 * loose, name
        assert abs(got.loc[name, "ic_ir"] - ics.mean() / ics.std()) < 5e-3 * loose, name
        assert abs(got.loc[name, "coverage"] - v.notna().mean()) < 1e-3


def test_available_skips_missing_fields():
    names = available(["date", "asset", "close", "volume"])
    assert "Momentum_1m" in names and "Low_PB" not in names


def test_old_node_form_evaluates_the_same(spark, panel):
    old = {
        "node_type": "rank",
        "children": [{"node_type": "div", "children": [{"node_type": "mean", "params": {"window": 3}, "children": [{"node_type": "feature", "value": "y"}]}, {"node_type": "constant", "value": 2}]}],
    }
    new = tree.from_factor_node(old)
    assert tree.required_fields(new) == ["y"] and tree.depth(new) == 4
    df = tree.evaluate(panel, {"a": new}).toPandas()
    pdf = panel.toPandas().sort_values(["asset", "date"], ignore_index=True)
    want = (pdf.groupby("asset")["y"].transform(lambda s: s.rolling(3, min_periods=1).mean()) / 2).groupby(pdf["date"]).rank(pct=True)
    got = df.sort_values(["asset", "date"], ignore_index=True)["a"]
    pd.testing.assert_series_equal(got, want, check_names=False)


def test_unknown_operator_and_field(panel):
    with pytest.raises(ValueError):
        tree.evaluate(panel, {"a": {"block_type": "transform", "op": "nope", "input_block": {"block_type": "data", "field_name": "y"}}})
    with pytest.raises(ValueError):
        tree.evaluate(panel, {"a": {"block_type": "data", "field_name": "absent"}})


def test_sweep_space():
    space = sweep.default_space(NAMED["A_Share_ST_Proxy"])
    assert space == {"clip__lo": [-3.0, -2.0, -1.5], "clip__hi": [1.5, 2.0, 3.0]}
    made = sweep.variants(NAMED["Momentum_12m1m"], {"window": [5, 10]})
    assert made["window=5"]["input_block"]["params"]["window"] == 5
    assert NAMED["Momentum_12m1m"]["input_block"]["params"]["window"] == 20
