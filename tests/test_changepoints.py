"""Trends that bend, against numpy and planted breaks."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from tidewater.operators.changepoints import _design, lasso_path, piecewise_forecast

START = dt.date(2023, 1, 1)
T0 = (START - dt.date(1970, 1, 1)).days


def _series(n, bends, noise, seed, slope=0.5):
    t = np.arange(n, dtype=float)
    trend = 40 + slope * t + sum(c * np.maximum(0, t - at) for at, c in bends)
    season = 3 * np.sin(2 * np.pi * (t + T0) / 7)
    return trend, trend + season + np.random.default_rng(seed).normal(0, noise, n)


def _frame(spark, k, y):
    days = [START + dt.timedelta(days=i) for i in range(len(y))]
    return spark.createDataFrame(pd.DataFrame({"k": [k] * len(y), "day": days, "y": y}), "k string, day date, y double")


def test_two_known_breaks_are_found(spark):
    trend, y = _series(420, [(120, -1.2), (240, 1.6)], 0.5, 1)
    df = _frame(spark, "a", y[:400]).unionByName(_frame(spark, None, _series(200, [], 0.5, 2)[1])).repartition(5)
    forecast, changes = piecewise_forecast(df, ["k"], "day", "y", 20)
    got = changes.toPandas()
    at = got.assign(pos=[(d - START).days for d in got.day])
    bent, straight = at[at.k == "a"], at[at.k.isna()]
    spacing = 0.8 * 400 / 26
    for where, change in ((120, -1.2), (240, 1.6)):
        near = bent[(bent.pos - where).abs() <= 2 * spacing]
        assert near.slope_change.sum() == pytest.approx(change, abs=0.2)
    assert bent[((bent.pos - 120).abs() > 2 * spacing) & ((bent.pos - 240).abs() > 2 * spacing)].slope_change.abs().sum() < 0.2
    assert straight.slope_change.abs().sum() < 0.1
    f = forecast.where("k = 'a'").toPandas().sort_values("day")
    assert len(f) == 420 and (f.kind == "forecast").sum() == 20
    # knots stand up to half a spacing from the breaks, so the trend may be off by as much there
    assert np.abs(f.trend.to_numpy() - trend).mean() < 1.5
    ahead = f[f.kind == "forecast"]
    width = (ahead.yhat_upper - ahead.yhat_lower).to_numpy()
    assert (np.diff(width) > 0).all() and ((ahead.yhat_lower < y[400:]) & (y[400:] < ahead.yhat_upper)).mean() >= 0.9
    assert forecast.where("k is null").count() == 220


def test_the_path_is_the_best_subset_of_few_knots(spark):
    """Four knots: every subset fitted by numpy; the path's choice has the least BIC, or nearly so."""
    _, y = _series(150, [(48, 1.0)], 0.4, 3)
    t, knots = T0 + np.arange(150.0), T0 + np.array([24.0, 48.0, 72.0, 96.0])
    x = _design(t, knots, t[0], 149.0, {7.0: 1})
    z = (y - y.mean()) / y.std()
    free = 4
    both = np.column_stack([x, z])
    b, rss, used = lasso_path(both.T @ both, free)

    def bic(cols):
        idx = [*range(free), *[free + c for c in cols]]
        res = z - x[:, idx] @ np.linalg.lstsq(x[:, idx], z, rcond=None)[0]
        return 150 * np.log(res @ res / 150) + np.log(150) * len(idx)
    least = min(bic(c) for r in range(5) for c in itertools.combinations(range(4), r))
    mine = bic(tuple(np.flatnonzero(b[free:])))
    assert rss == pytest.approx(float(((z - x @ b) ** 2).sum()), rel=1e-6) and used == free + np.count_nonzero(b[free:])
    assert mine - least < 3 and b[free + 1] != 0


def test_awkward_series(spark):
    rows = [("one", dt.date(2024, 1, 1), 5.0), ("flat", dt.date(2024, 1, 1), 2.0), ("flat", dt.date(2024, 1, 2), 2.0),
            ("flat", dt.date(2024, 1, 2), 2.0), ("flat", None, 9.0), ("gap", dt.date(2024, 1, 1), None),
            ("gap", dt.date(2024, 1, 3), 1.0), ("gap", dt.date(2024, 1, 9), 4.0), (None, dt.date(2024, 1, 1), float("nan"))]
    df = spark.createDataFrame(rows, "k string, day date, y double")
    forecast, changes = piecewise_forecast(df, ["k"], "day", "y", 2, knots=3)
    f = forecast.toPandas()
    assert f.groupby("k").size().to_dict() == {"one": 3, "flat": 5, "gap": 5}
    assert f[f.k == "one"].yhat.to_numpy() == pytest.approx([5.0] * 3) and f[f.k == "flat"].yhat.to_numpy() == pytest.approx([2.0] * 5)
    assert forecast.where("k is null and yhat is null").count() == 1
    f = f[f.k.notna()]
    assert np.isfinite(f[["yhat", "yhat_lower", "yhat_upper"]].to_numpy()).all()
    assert changes.count() == 0 or set(changes.toPandas().k) <= {"gap"}
    empty, none = piecewise_forecast(df.where("false"), ["k"], "day", "y", 2, knots=3)
    assert empty.count() == 0 and none.count() == 0
    alone, _ = piecewise_forecast(df.where("k = 'gap'"), [], "day", "y", 2, knots=3)
    assert alone.count() == 5
