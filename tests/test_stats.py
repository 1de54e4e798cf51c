"""Closed-form checks of the SEM notes and the exact quantile selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.stats import kurtosis_sample, skewness_sample
from tidewater.operators import clean as C
from tidewater.operators.schema import standardize_types
from tidewater.plans import quantiles as quantile_plan
from tidewater.plans.quantiles import exact_quantiles


def test_linear_quantiles_sem3(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10, 20)], "x double")
    q = {r["p"]: r["q"] for r in exact_quantiles(df, ["x"], [0.25, 0.5, 0.75]).collect()}
    assert q[0.25] == pytest.approx(2.25)
    assert q[0.5] == pytest.approx(3.5)


@pytest.mark.parametrize("accuracy", [20_000, 100])
def test_exact_quantiles_match_pandas(spark, monkeypatch, accuracy):
    """Also with a coarse sketch, whose enclosures hold a few of the values only."""
    monkeypatch.setattr(quantile_plan, "ACCURACY", accuracy)
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "a": rng.lognormal(0, 2, 3000),
                        "b": rng.integers(0, 5, 3000).astype(float)})
    pdf.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(df, ["a", "b"], probs, by=["g"]).toPandas()
    exp = pdf.groupby("g")[["a", "b"]].quantile(probs)
    for _, r in out.iterrows():
        assert r.q == pytest.approx(exp.loc[(r.g, r.p), r.column], rel=1e-12, abs=1e-12)
    assert len(out) == 4 * 2 * len(probs)
    for r in exact_quantiles(df, ["a", "b"], probs).collect():
        assert r.q == pytest.approx(pdf[r.column].quantile(r.p), rel=1e-12, abs=1e-12)


def test_mode_ties_smallest_sem4(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("a",), (None,)], "c string")
    assert C.modes(df, ["c"])["c"] == "a"


def test_sample_skew_kurt_sem6(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0, 20.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = df.agg(skewness_sample(F.col("x")).alias("s"), kurtosis_sample(F.col("x")).alias("k")).collect()[0]
    s = pd.Series(vals)
    assert r["s"] == pytest.approx(s.skew(), rel=1e-12)
    assert r["k"] == pytest.approx(s.kurtosis(), rel=1e-12)


def test_clip_keeps_nulls_sem10(spark):
    df = spark.createDataFrame([(1.0,), (None,), (100.0,), (5.0,)] * 5, "x double")
    out = C.cap_outliers(df, ["x"], "iqr")
    assert out.where(F.col("x").isNull()).count() == 5


def test_remove_outliers_sequential_keeps_nulls_sem11(spark):
    rows = [(float(i), float(i % 7)) for i in range(40)] + [(1000.0, None), (None, 500.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = C.remove_outliers(df, ["a", "b"]).toPandas()
    assert 1000.0 not in set(out["a"].dropna())   # removed by column a
    assert 500.0 not in set(out["b"].dropna())    # survived a (null), removed by column b
    assert out["a"].isna().sum() == 1             # (None, 3.0) survives both columns


def test_large_integers_keep_their_digits(spark):
    df = spark.createDataFrame([("1234567890123456789", 9007199254740993), ("1e3", 9007199254740993), (" -5 ", 1)], "t string, n long")
    out = standardize_types(df, ["t"])
    assert dict(out.dtypes)["t"] == "bigint"
    assert [r.t for r in out.collect()] == [1234567890123456789, 1000, -5]
    assert C.modes(df, ["n"])["n"] == 9007199254740993
