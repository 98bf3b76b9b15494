"""Every registered query against its SQL on whole tables: the core ones on sf0.01, the others on sf0.001 (all of them on sf0.01 with FACTORLOOM_ALL=1)."""

import os

import pytest
from check_queries import compare, connect
from brute import SF_DIR

import __spark_entry__ as entry
from factorloom import catalog

SMALL = "/root/testdata/sf0.001"

CORE = """p_div p_where w_rank w_quantile w_group_zscore t_top_n t_group_bottom_n g_group_median v_ts_rank v_ts_argmax v_ts_corr v_ts_skew
v_ema v_rolling_ols_residual i_batch_rank_ic i_quantile_returns i_top_bucket_turnover i_scorecard h_benjamini_hochberg j_panel_pair_corr
o_oos_validation o_walk_forward_ic r_risk_neutralize c_combine_equal m_regime_adjusted_ic m_factor_health b_weights_score b_period_returns
b_trade_cost b_signal_returns s_upsert_panel j_asof_join s_ttm_earnings q_quality_report q_survivorship_filter x_retrieve_topk
g_direction_insight g_direction_guidance m_lineage z_stream_panel_upsert i_oos_ic_check i_decision_checks b_risk_check""".split()


# On fewer than twenty assets a date has no IC, and the SQL of these has no row where the operator gives zeros.
BROAD = """b_ic_vs_return c_crowding_penalty c_factor_weights i_benchmark_compare i_decay_monitor_ic i_evaluate_named i_named_factors_ic i_rank_ic_single
i_report_ic i_scorecard_rank_ic i_test_verdict m_delivery_screen m_governance_severity o_parameter_sensitivity o_parameter_sweep u_user_factor""".split()


def where(name: str) -> str:
    return SF_DIR if name in CORE or name in BROAD or os.environ.get("FACTORLOOM_ALL") else SMALL


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CORE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, where(name)).toPandas()
    want = connect(where(name)).execute(entry.oracle_sql()[name]).df()
    assert len(want) > 0 or where(name) == SMALL
    assert compare(got, want) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["factor_id", "n_dates", "ic_mean", "ic_ir", "coverage"]
    assert df.count() == 63
