"""Recurrences over batches of a few rows give what they give over whole series."""

import numpy as np
import pandas as pd
import pytest

from meridia.functions.compile import Panel
from meridia.operators import backtest
from meridia.operators.sequential import exponentials, positions

P = Panel(("k",), ("t",))


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{k}", t, None if rng.random() < 0.15 else float(rng.normal()), t // 11) for k in range(9) for t in range(int(rng.integers(1, 60)))]
    return spark.createDataFrame(rows, "k string, t int, x double, seg int")


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_averages(spark, frame, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = exponentials(frame, P, {"h": ("x", "halflife", 5), "a": ("x", "adjusted", 0.3)}).toPandas().sort_values(["k", "t"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for _, own in got.groupby("k"):
        x = own.x.astype(float)
        assert np.allclose(own.h, x.ewm(halflife=5, adjust=False, ignore_na=True).mean(), equal_nan=True)
        assert np.allclose(own.a, x.ewm(alpha=0.3, adjust=True, ignore_na=False).mean(), equal_nan=True)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_positions(spark, frame, size):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = frame.selectExpr("*", "-0.5D as lo", "0.5D as hi", "cast(t % 5 = 3 as int) as lock")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = backtest.with_positions(df, P, "x", "lo", "hi", "lock", "seg", 4).toPandas().sort_values(["k", "t"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for _, own in got.groupby("k"):
        cols = [pd.to_numeric(own[c]).to_numpy(float) for c in ("x", "lo", "hi", "lock", "seg")]
        assert own.position.tolist() == positions(*cols, 4).tolist()
    assert set(got.position) == {-1, 0, 1}
