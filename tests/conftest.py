import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from factorloom.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tiny_groups(spark):
    """Make every group 'too large for one task', so that the split plans run."""
    from factorloom.operators.sizes import CONF

    spark.conf.set(CONF, "20")
    yield spark
    spark.conf.unset(CONF)


@pytest.fixture(scope="session")
def panel_pdf():
    """120 assets x 25 dates with ties, gaps, one dominant value and two groups."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    rows = []
    for d in pd.date_range("2024-01-01", periods=25, freq="B"):
        for a in range(120):
            x = float(rng.integers(0, 15)) / 2
            if rng.random() < 0.35:
                x = 3.0
            rows.append((d.date(), f"{a:06d}", None if rng.random() < 0.07 else x, float(rng.normal()), float(rng.uniform(5, 50)), "AB"[a % 2]))
    return pd.DataFrame(rows, columns=["date", "asset", "x", "y", "close", "industry"])


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    from factorloom.functions.scalar import number

    df = spark.createDataFrame(panel_pdf, "date date, asset string, x double, y double, close double, industry string")
    return df.withColumn("x", number("x")).cache()
