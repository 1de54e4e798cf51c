"""Exact maximum likelihood of ARIMA models vs dense Gaussian densities and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import likelihood as L
from tidewater.operators import timeseries as TS


def simulate(n, ar=(), ma=(), seed=1, mean=0.0):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 300), np.zeros(n + 300)
    for t in range(20, n + 300):
        x[t] = e[t] + sum(c * x[t - i - 1] for i, c in enumerate(ar)) + sum(c * e[t - i - 1] for i, c in enumerate(ma))
    return x[300:] + mean


def dense(w, u, order):
    """Log-likelihood from the whole covariance matrix, by the weights of past innovations."""
    ar, ma = L._polynomials(np.asarray(u, float), order)
    long = 6000
    psi = np.zeros(long)
    psi[0] = 1.0
    for j in range(1, long):
        psi[j] = (ma[j - 1] if j <= len(ma) else 0.0) + sum(ar[i] * psi[j - i - 1] for i in range(min(j, len(ar))))
    n = len(w)
    acov = np.array([psi[:long - h] @ psi[h:] for h in range(n)])
    cov = acov[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    inv, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    mean = (inv.sum(axis=0) @ w) / inv.sum() if order.has_mean else 0.0
    var = (w - mean) @ inv @ (w - mean) / n
    return -0.5 * (n * (math.log(2 * math.pi * var) + 1) + logdet), var, mean


@pytest.mark.parametrize("order", [L.Order(1), L.Order(0, 0, 1), L.Order(2, 0, 1), L.Order(1, 1, 2), L.Order(1, 0, 1, 1, 0, 1, 4),
                                   L.Order(0, 1, 0), L.Order(0, 0, 0)])
def test_block_sums_give_the_dense_likelihood(order):
    w = simulate(150, (0.5,), (0.3,), mean=7.0)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3, order.n_coef)) * 0.7
    cuts = [0, 1, 38, 39, 100, 150]
    total = L._chain([L.Sums.unpack(L.block_sums(w[a:b], a, points, order).pack(), order) for a, b in zip(cuts, cuts[1:])])
    found, details = L.log_likelihoods(total, order)
    for u, f, d in zip(points, found, details):
        want, var, mean = dense(w, u, order)
        assert f == pytest.approx(want, rel=1e-8)
        assert d[0] == pytest.approx(var, rel=1e-8) and d[1] == pytest.approx(mean, rel=1e-7, abs=1e-9)


def frame(spark, series):
    rows = [(k, t, float(v)) for k, ys in series.items() for t, v in enumerate(ys)]
    return TS.positioned(spark.createDataFrame(pd.DataFrame(rows, columns=["k", "t", "y"])), ["k"], "t")


def coefs(fits):
    return {(r["k"], r["term"]): r for r in fits.coefficients().collect()}


def test_first_order_autoregression_is_at_its_maximum(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)
    monkeypatch.setattr(L, "FAN", 3)  # 16 blocks: several levels of composition
    ys = simulate(1000, (0.6,), seed=5, mean=1e4)
    fits = L.arima_ml(frame(spark, {"a": ys}), ["k"], "y", (1, 0, 0))
    c = coefs(fits)

    def loglik(phi):
        n = len(ys)
        weight = (1 - phi ** 2) + (n - 1) * (1 - phi) ** 2
        mean = ((1 - phi ** 2) * ys[0] + (1 - phi) * (ys[1:] - phi * ys[:-1]).sum()) / weight
        x = ys - mean
        var = ((1 - phi ** 2) * x[0] ** 2 + ((x[1:] - phi * x[:-1]) ** 2).sum()) / n
        return -0.5 * n * (math.log(2 * math.pi * var) + 1) + 0.5 * math.log(1 - phi ** 2)
    grid = np.linspace(0.4, 0.8, 4001)
    best = grid[np.argmax([loglik(x) for x in grid])]
    assert c["a", "ar.L1"]["estimate"] == pytest.approx(best, abs=2e-4)
    assert fits.models().first()["loglik"] == pytest.approx(loglik(c["a", "ar.L1"]["estimate"]), rel=1e-9)
    assert c["a", "ar.L1"]["std_err"] == pytest.approx(math.sqrt((1 - best ** 2) / 1000), rel=0.1)
    assert c["a", "mean"]["estimate"] == pytest.approx(ys.mean(), abs=0.1)


def test_simulated_coefficients_are_found(spark):
    season = simulate(1500, seed=9)
    for t in range(7, 1500):
        season[t] += 0.5 * season[t - 7]
    series = {"a": simulate(2000, (0.5, 0.2), (0.4,), seed=2)}
    c = coefs(L.arima_ml(frame(spark, series), ["k"], "y", (2, 0, 1)))
    for term, true in (("ar.L1", 0.5), ("ar.L2", 0.2), ("ma.L1", 0.4)):
        assert abs(c["a", term]["estimate"] - true) < 3 * c["a", term]["std_err"]
    c = coefs(L.arima_ml(frame(spark, {"s": season}), ["k"], "y", (0, 0, 0), (1, 0, 0, 7)))
    assert abs(c["s", "ar.S.L7"]["estimate"] - 0.5) < 3 * c["s", "ar.S.L7"]["std_err"]
    assert c["s", "ar.S.L7"]["p_value"] < 1e-6


def test_forecasts_of_closed_forms(spark):
    walk = np.cumsum(simulate(300, seed=4))
    fits = L.arima_ml(frame(spark, {"a": walk}), ["k"], "y", (0, 1, 0))
    var = (np.diff(walk) ** 2).mean()
    for r in fits.forecasts(5).collect():
        assert r["forecast"] == pytest.approx(walk[-1], rel=1e-12)
        assert r["std_err"] == pytest.approx(math.sqrt(var * r["step"]), rel=1e-9)
    ys = simulate(300, (0.7,), seed=6, mean=3.0)
    fits = L.arima_ml(frame(spark, {"a": ys}), ["k"], "y", (1, 0, 0))
    c = {r["term"]: r["estimate"] for r in fits.coefficients().collect()}
    for r in fits.forecasts(4).collect():
        phi = c["ar.L1"]
        assert r["forecast"] == pytest.approx(c["mean"] + phi ** r["step"] * (ys[-1] - c["mean"]), rel=1e-9)
        assert r["std_err"] == pytest.approx(math.sqrt(c["sigma2"] * (1 - phi ** (2 * r["step"])) / (1 - phi ** 2)), rel=1e-9)
    week = np.tile(np.arange(7.0), 30) + 0.01 * simulate(210, seed=8)
    got = L.arima_ml(frame(spark, {"a": week}), ["k"], "y", (0, 0, 0), (0, 1, 0, 7)).forecasts(14).orderBy("step").collect()
    assert [r["forecast"] for r in got] == pytest.approx(list(week[-7:]) * 2, rel=1e-9)
    assert got[7]["std_err"] == pytest.approx(got[0]["std_err"] * math.sqrt(2), rel=1e-9)


def test_search_takes_the_least_aic(spark):
    df = frame(spark, {"a": simulate(400, (0.8,), seed=7), "b": np.cumsum(simulate(400, (), (0.5,), seed=12))})
    fits = L.fit(df, ["k"], "y", L.search_orders(1, 1, 1))
    best = {r["k"]: r for r in fits.best().models().collect()}
    allm = fits.models().toPandas()
    assert len(allm) == 16
    for k, g in allm.groupby("k"):
        assert best[k]["aic"] == pytest.approx(g["aic"].min())
    assert best["b"]["d"] == 1 and best["a"]["p"] == 1


def test_awkward_series(spark):
    rows = [("flat", t, 5.0) for t in range(30)] + [("short", 0, 1.0), ("short", 1, 2.0)] + [("gone", t, None) for t in range(5)]
    ys = simulate(60, (0.5,), seed=3)
    holes = [x for t, v in enumerate(ys) for x in ([(None, 2 * t, float(v)), (None, 2 * t + 1, float("nan"))])]
    df = spark.createDataFrame(rows + holes, "k string, t long, y double").withColumn("job", F.lit("x")).withColumn("w", F.lit(1))
    fits = L.arima_ml(TS.positioned(df, ["k"], "t"), ["k"], "y", (1, 0, 0))
    status = {r["k"]: r["status"] for r in fits.models().collect()}
    assert status == {"flat": "no variance", "short": "too few values"} | ({None: "fitted"} if None in status else {})
    empty = L.arima_ml(TS.positioned(df.limit(0), ["k"], "t"), ["k"], "y", (1, 1, 1))
    assert empty.models().count() == empty.coefficients().count() == empty.forecasts(3).count() == 0
    one = L.arima_ml(TS.positioned(df.where("k is null"), [], "t"), [], "y", (1, 0, 0))
    other = L.arima_ml(frame(spark, {"z": ys}), ["k"], "y", (1, 0, 0))
    assert one.models().first()["loglik"] == pytest.approx(other.models().first()["loglik"], rel=1e-9)
    assert len(one.forecasts(3).columns) == 5
