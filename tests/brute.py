"""A plain pandas evaluator of expression trees, used only to check the Spark one."""

import numpy as np
import pandas as pd

SF_DIR = "/root/testdata/sf0.01"

ROLL = {
    "ts_mean": lambda r: r.mean(),
    "ts_std": lambda r: r.std(),
    "ts_max": lambda r: r.max(),
    "ts_min": lambda r: r.min(),
    "ts_sum": lambda r: r.sum(),
    "ts_rank": lambda r: r.rank(pct=True),
}


def steady(x):
    """40 significant bits, as ranks compare."""
    return x * 8193.0 - (x * 8193.0 - x)


def evaluate(node, df):
    """``df`` is sorted by asset and date with a plain index."""
    if node["block_type"] == "data":
        return df[node["field_name"]].astype(float)
    p, o = node.get("params") or {}, node["op"]
    if o == "constant":
        return pd.Series(float(p["value"]), index=df.index)
    if node["block_type"] == "combine":
        a, b = evaluate(node["left"], df), evaluate(node["right"], df)
        if o == "div":
            return a / (b.where(b != 0).abs().clip(lower=1e-10) * np.sign(b.where(b != 0)))
        return {"add": a + b, "sub": a - b, "mul": a * b}[o]
    x = evaluate(node["input_block"], df)
    by_asset, by_date = x.groupby(df["asset"]), x.groupby(df["date"])
    w = p.get("window")
    if o in ROLL:
        return by_asset.transform(lambda s: ROLL[o](s.rolling(w, min_periods=1)))
    if o == "ts_corr":
        y = evaluate(p["_right_block"], df)
        both = pd.DataFrame({"x": x, "y": y, "a": df["asset"]})
        return pd.concat([g["x"].rolling(w, min_periods=1).corr(g["y"]) for _, g in both.groupby("a")]).reindex(df.index)
    return {
        "rank": lambda: steady(x).groupby(df["date"]).rank(pct=True),
        "zscore": lambda: by_date.transform(lambda s: (s - s.mean()) / (s.std() + 1e-10)),
        "delta": lambda: by_asset.diff(w),
        "lag": lambda: by_asset.shift(w),
        "abs": lambda: x.abs(),
        "sign": lambda: np.sign(x),
        "log": lambda: np.log(x.clip(lower=1e-10)),
        "clip": lambda: x.clip(p.get("lo"), p.get("hi")),
        "piecewise": lambda: (x > p.get("threshold", 0)).astype(float),
    }[o]()


def rank_ic(values, df, horizon=5, min_n=20):
    fwd = df.groupby("asset")["close"].shift(-horizon) / df["close"] - 1
    out = []
    for _, g in pd.DataFrame({"f": values, "r": fwd, "d": df["date"]}).dropna().groupby("d"):
        if len(g) >= min_n:
            c = steady(g["f"]).rank().corr(steady(g["r"]).rank())
            if not np.isnan(c):
                out.append(c)
    return np.array(out)
