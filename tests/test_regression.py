"""Least squares, ARIMA intervals and clustering on cases that an ill-conditioned or capped method gets wrong."""

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import arima as AR
from tidewater.operators import forecast as FC
from tidewater.operators import ml as ML
from tidewater.operators import timeseries as TS
from tidewater.plans.ordered import POS


def test_fourier_forecast_keeps_a_trend(spark):
    days = pd.date_range("2024-01-01", periods=30)
    noise = np.random.default_rng(3).normal(0, 0.5, 30)
    y = 100 + 5 * np.arange(30) + noise
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "day": days.date, "y": y}))
    out = FC.fourier_forecast(df, ["k"], "day", "y", 14).toPandas().sort_values("day")
    t = np.arange(44.0)
    X = np.column_stack([np.ones(44), t - t.mean(), *[f(2 * np.pi * j * (t + 19723) / 7) for j in (1, 2, 3) for f in (np.sin, np.cos)]])
    beta = np.linalg.lstsq(X[:30], y, rcond=None)[0]
    assert out.yhat.to_numpy() == pytest.approx(X @ beta, abs=1e-6)


def test_subset_fits_match_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": "a", "one": 1.0, "u": 1e6 + rng.normal(0, 1, 400), "v": rng.normal(0, 1e-3, 400)})
    pdf["y"] = 3 * pdf.u - 50 * pdf.v + rng.normal(0, 0.1, 400)
    ne = TS.normal_equations(spark.createDataFrame(pdf), ["k"], "y", ["one", "u", "v"]).toPandas()
    for idx, cols in (([0, 1, 2], ["one", "u", "v"]), ([0, 1], ["one", "u"]), ([0], ["one"])):
        beta, rss = TS.solve_sub(ne.iloc[0], 3, idx)
        X = pdf[cols].to_numpy() - np.array([0, 1e6, 0])[:len(cols)]
        exp = np.linalg.lstsq(X, pdf.y.to_numpy(), rcond=None)[0]
        assert rss == pytest.approx(float(((pdf.y - X @ exp) ** 2).sum()), rel=1e-6)
        assert beta[1:] == pytest.approx(exp[1:], rel=1e-6)


def test_seasonal_interval_widens_each_season(spark):
    rng = np.random.default_rng(1)
    y = np.zeros(300)
    for i in range(7, 300):
        y[i] = y[i - 7] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"k": "a", POS: np.arange(300), "y": y}))
    _, fc = AR.arima(df, ["k"], "y", (0, 0, 0), 21, seasonal=(1, 7))
    width = (fc.toPandas().sort_values("step").eval("upper - lower")).to_numpy()
    assert width[7] == pytest.approx(width[0] * np.sqrt(2), rel=1e-6) and width[20] == pytest.approx(width[0] * np.sqrt(3), rel=1e-6)


def test_seasonal_ar_term_is_found(spark):
    rng = np.random.default_rng(2)
    y = np.zeros(3000)
    for i in range(7, 3000):
        y[i] = 0.7 * y[i - 7] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"k": "a", POS: np.arange(3000), "y": y}))
    model, _ = AR.arima(df, ["k"], "y", (1, 0, 0), 5, seasonal=(0, 7), seasonal_arma=(1, 0))
    m = model.first()
    assert abs(m.b2 - 0.7) < 0.05 and abs(m.b1) < 0.06


def test_dbscan_chain_is_one_cluster(spark):
    df = spark.createDataFrame([(i, [0.4 * i, 0.0], 0.0) for i in range(1000)], "id long, vec array<double>, label double")
    assert {r.cluster for r in ML.dbscan(df, 0.5, 2).collect()} == {0}
