"""Regression machinery of the time-series operators vs numpy on small series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import timeseries as TS


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(2):
        x = np.zeros(120)
        for t in range(1, 120):
            x[t] = 0.6 * x[t - 1] + rng.normal()
        rows += [(k, t, float(v)) for t, v in enumerate(x)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "y"])
    df = spark.createDataFrame(pdf)
    return pdf, TS.positioned(df, ["k"], "t")


def test_acf_matches_definition(series):
    pdf, pos = series
    out = TS.acf(pos, ["k"], "y").toPandas()
    for k, g in pdf.groupby("k"):
        x = g.sort_values("t")["y"].to_numpy()
        d = x - x.mean()
        for lag in (1, 2, 5):
            exp = (d[:-lag] * d[lag:]).sum() / (d * d).sum()
            got = out[(out.k == k) & (out.lag == lag)]["acf"].iloc[0]
            assert got == pytest.approx(exp, rel=1e-9)


def test_grouped_normal_equations_equal_lstsq(series, spark):
    pdf, pos = series
    lagged = pos.withColumn("one", F.lit(1.0)).withColumn(
        "y1", F.lag("y", 1).over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("k").orderBy("_pos")))
    ne = TS.normal_equations(lagged, ["k"], "y", ["one", "y1"]).toPandas()
    for _, r in ne.iterrows():
        beta, _ = TS.solve_sub(r, 2, [0, 1])
        g = pdf[pdf.k == r["k"]].sort_values("t")["y"].to_numpy()
        X = np.c_[np.ones(len(g) - 1), g[:-1]]
        exp = np.linalg.lstsq(X, g[1:], rcond=None)[0]
        np.testing.assert_allclose(beta, exp, rtol=1e-8)


def test_adf_detects_stationary_ar1(series):
    _, pos = series
    out = TS.adf_test(pos, ["k"], "y", maxlag=2).toPandas()
    assert (out["adf_statistic"] < out["crit_5"]).all()       # phi = 0.6 is stationary


def test_pacf_lag1_equals_acf_lag1(series):
    _, pos = series
    a = TS.acf(pos, ["k"], "y").toPandas()
    p = TS.pacf(pos, ["k"], "y").toPandas()
    # with the adjusted estimator, pacf(1) = acf(1) * n / (n - 1)
    for k in (0, 1):
        acf1 = a[(a.k == k) & (a.lag == 1)]["acf"].iloc[0]
        pacf1 = p[(p.k == k) & (p.lag == 1)]["pacf"].iloc[0]
        assert pacf1 == pytest.approx(acf1 * 120 / 119, rel=1e-9)
