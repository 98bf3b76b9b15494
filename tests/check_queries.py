"""Run registered queries against their SQL checks: python tests/check_queries.py [sf] [pattern]."""

from __future__ import annotations

import os
import re
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shape(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if not pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = shape(got), shape(want)
    for c in a.columns:
        both_null = a[c].isna() & b[c].isna()
        same = (a[c] == b[c]) | both_null
        if not same.all():
            i = same[~same].index[0]
            return f"{c}: {(~same).sum()} differ, e.g.\n{a.loc[[i]].to_string()}\n{b.loc[[i]].to_string()}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    import __spark_entry__ as entry
    from factorloom.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("FACTORLOOM_MAX_GROUP_ROWS"):  # force the plans for oversized groups
        spark.conf.set("spark.factorloom.maxGroupRows", os.environ["FACTORLOOM_MAX_GROUP_ROWS"])
    sf_dir = f"/root/testdata/sf{sf}"
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if not pattern.search(name):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                diff = compare(got, con.execute(oracles[name]).df())
            else:
                diff = "" if len(got) else "no rows"
        except Exception as exc:  # report and go on with the next query
            took, diff, got = time.time() - start, f"{type(exc).__name__}: {str(exc)[:1500]}", []
        bad += bool(diff)
        tag = "FAIL" if diff else ("ok" if name in oracles else "ok (rows only)")
        print(f"{tag:5s} {name:32s} rows={len(got):7d} {took:6.2f}s {diff}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
