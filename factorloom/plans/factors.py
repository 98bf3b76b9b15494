"""The named factors, written as small expressions over panel fields.

``E`` builds the same nested dicts that are stored as JSON, so a named factor and a
user's stored tree go through one evaluator.
"""

from __future__ import annotations


class E:
    """A tree node with arithmetic."""

    def __init__(self, node: dict):
        self.node = node

    def _with(self, op: str, other, flip: bool = False) -> "E":
        other = other if isinstance(other, E) else const(other)
        a, b = (other, self) if flip else (self, other)
        return E({"block_type": "combine", "op": op, "left": a.node, "right": b.node})

    def __add__(self, o):
        return self._with("add", o)

    def __sub__(self, o):
        return self._with("sub", o)

    def __mul__(self, o):
        return self._with("mul", o)

    def __truediv__(self, o):
        return self._with("div", o)

    def __rtruediv__(self, o):
        return self._with("div", o, flip=True)

    def __neg__(self):
        return self._with("mul", -1.0, flip=True)


def field(name: str) -> E:
    return E({"block_type": "data", "field_name": name})


def const(value: float) -> E:
    return E({"block_type": "transform", "op": "constant", "params": {"value": float(value)}})


def op(name: str, x: E, other: E | None = None, **params) -> E:
    if other is not None:
        params["_right_block"] = other.node
    return E({"block_type": "transform", "op": name, "params": params, "input_block": x.node})


def rank(x: E) -> E:
    return op("rank", x)


def over(name: str, x: E, window: int, **params) -> E:
    return op(name, x, window=window, **params)


def change(x: E, k: int) -> E:
    """k-row change relative to the value k rows back."""
    return over("delta", x, k) / over("lag", x, k)


open_, close, volume, turnover = (field(f) for f in ("open", "close", "volume", "turnover"))
pb, pe, cap, float_cap = (field(f) for f in ("pb", "pe", "market_cap", "float_market_cap"))

ret1 = over("delta", close, 1) / close
gap = open_ / over("lag", close, 1)
gapped_up = op("piecewise", gap - 1.02, threshold=0)
high20, low20 = over("ts_max", close, 20), over("ts_min", close, 20)
cap_log = op("log", op("clip", cap, lo=1e8, hi=1e13))
pb_clip = op("clip", pb, lo=0.1, hi=10.0)


def d(k: int) -> E:
    return over("delta", close, k)


def mean(x: E, k: int) -> E:
    return over("ts_mean", x, k)


def std(x: E, k: int) -> E:
    return over("ts_std", x, k)


# The factor names and definitions users refer to.
EQUITY = {
    "Book_to_Price": rank(close / pb),
    "Earnings_Yield": rank(1 / pe),
    "Low_PB": rank(1 / pb),
    "Value_Composite": rank(rank(1 / pe) + rank(1 / pb)),
    "Sales_Yield_Proxy": rank(turnover / cap),
    "Momentum_12m1m": rank(d(20)),
    "Momentum_6m": rank(d(60)),
    "Momentum_1m": rank(d(5)),
    "Momentum_3m": rank(d(40)),
    "Size_Small": rank(-op("log", cap)),
    "Size_FloatCap": rank(-op("log", float_cap)),
    "Size_Volume": rank(-op("log", volume)),
    "Quality_EP_Stable": rank(op("zscore", 1 / pe)),
    "Quality_Price_Stability": rank(1 / std(close, 60)),
    "Quality_Margin_Proxy": rank(close / turnover),
    "Low_Vol_60d": rank(1 / std(close, 60)),
    "Low_Vol_20d": rank(1 / std(close, 20)),
    "Low_Vol_Daily_Range": rank(1 / op("abs", d(5))),
    "Turnover_Liquidity": rank(turnover),
    "Amihud_Illiquidity": rank(op("abs", ret1) / volume),
    "A_Share_Retail_Flow": rank(turnover / mean(turnover, 20)),
    "A_Share_State_Ownership": rank(float_cap / cap),
    "A_Share_Limit_Impact": rank(high20 / low20),
    "A_Share_Limit_Up_Proximity": rank(close / high20),
    "A_Share_Limit_Down_Risk": rank(close - low20),
    "A_Share_ST_Proxy": rank(pb_clip),
    "A_Share_Vol_Price_Coupling": rank(op("ts_corr", volume, op("abs", ret1), window=20)),
    "A_Share_Gap_Up_Frequency": rank(over("ts_sum", gapped_up, 20)),
    "A_Share_Overnight_Return": rank(gap - 1.0),
    "A_Share_Small_Cap_Effect": rank(cap_log),
    "A_Share_Shell_Value_Proxy": rank(-cap_log + -pb_clip),
    "Momentum_Overnight_20d": rank(mean(gap - 1.0, 20)),
    "Momentum_Risk_Adjusted_60d": rank(change(close, 60) / std(ret1, 60)),
    "Momentum_High_Low_20d": rank((close - low20) / (high20 - low20)),
    "Momentum_Volume_Confirmed_20d": rank(change(close, 20) * (volume / mean(volume, 20))),
    "Reversal_Overnight_5d": -rank(mean(gap - 1.0, 5)),
    "Reversal_Extreme_Loser_20d": -rank(change(close, 20)),
    "Reversal_Vol_Normalized_5d": -rank(change(close, 5) / std(ret1, 20)),
    "Behavioral_52_Week_High": rank(close / over("ts_max", close, 252)),
    "Behavioral_52_Week_Low": rank(close / over("ts_min", close, 252)),
    "Behavioral_Disposition_Proxy": -rank(mean(turnover, 20) / change(close, 60)),
    "Event_PEAD_Proxy": rank(op("abs", change(close, 5) - change(close, 20))),
    "Event_Gap_Reversal": -rank(mean(gapped_up, 5)),
    "Liquidity_Pastor_Stambaugh_Proxy": rank(op("sign", change(close, 5)) * change(volume, 5)),
}
SEEDS = {
    "seed_momentum_20d": rank(d(20)),
    "seed_reversal_5d": rank(-d(5)),
    "seed_value_bp": rank(1 / pb),
    "seed_size_small": rank(-op("log", field("circ_mv"))),
    "seed_low_volatility": rank(1 / std(close, 60)),
    "seed_turnover_low": rank(-field("turnover_rate")),
    "seed_quality_low_pe": rank(1 / field("pe_ttm")),
}
INDEX_FUTURES = {
    "index_basis": rank(field("basis")),
    "index_term_structure": rank(field("term_structure")),
    "index_oi_momentum": rank(over("delta", field("open_interest"), 5)),
}
COMMODITY = {
    "commodity_carry": rank((field("near_price") - field("far_price")) / field("far_price")),
    "commodity_momentum": rank(d(20)),
    "commodity_basis": rank((field("spot") - field("future")) / field("spot")),
    "commodity_oi_signal": rank(over("delta", field("open_interest"), 5) / field("open_interest")),
}
CONVERTIBLE = {
    "cb_premium": rank(-field("premium_rate")),
    "cb_delta": rank(field("delta")),
    "cb_floor_buffer": rank((close - field("bond_floor")) / field("bond_floor")),
    "cb_issuance_size": rank(-op("log", field("issuance_size"))),
    "cb_double_low": rank(rank(-field("premium_rate")) * rank(-(close / field("underlying_price")) * 100.0)),
}

NAMED = {k: v.node for group in (EQUITY, SEEDS, INDEX_FUTURES, COMMODITY, CONVERTIBLE) for k, v in group.items()}


def available(columns) -> dict[str, dict]:
    """Named factors whose fields all exist in the panel."""
    from .tree import required_fields

    have = set(columns)
    return {k: t for k, t in NAMED.items() if set(required_fields(t)) <= have}
