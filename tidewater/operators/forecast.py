"""Regression forecast with trend + Fourier seasonality (T15, re-aim of the
additive trend/seasonality model)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.timeseries import normal_equations, solve_sub
from tidewater.plans.attach import attach


def _features(t, periods: dict[float, int]):
    cols = {"one": F.lit(1.0), "t": t.cast("double")}
    for period, k in periods.items():
        for j in range(1, k + 1):
            ang = 2 * math.pi * j * t.cast("double") / period
            cols[f"s{int(period)}_{j}"] = F.sin(ang)
            cols[f"c{int(period)}_{j}"] = F.cos(ang)
    return cols


def fourier_forecast(df: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int = 14,
                     periods: dict[float, int] | None = None) -> DataFrame:
    """Fit y ~ 1 + t + sum_k sin/cos(2 pi k t / P) per series (grouped normal
    equations), then predict the history and ``horizon`` future days with a
    normal-approximation interval. ``t`` = days since 1970-01-01."""
    keys = list(keys)
    periods = periods or {7.0: 3}
    t = F.datediff(F.col(day), F.lit("1970-01-01"))
    feats = _features(t, periods)
    xs = list(feats)
    design = df.select(*keys, day, F.col(value).cast("double").alias("y"), *[c.alias(n) for n, c in feats.items()])
    ne = normal_equations(design, keys, "y", xs)
    kschema = ", ".join(f"{k} {tp}" for k, tp in ne.select(*keys).dtypes)
    schema = (kschema + ", " if kschema else "") + ", ".join(f"b_{x} double" for x in xs) + ", sigma double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            beta, rss = solve_sub(r, len(xs), list(range(len(xs))))
            row = {k: r[k] for k in keys}
            row.update({f"b_{x}": float(b) for x, b in zip(xs, beta)})
            row["sigma"] = math.sqrt(rss / max(r["n"] - len(xs), 1))
            rows.append(row)
        return pd.DataFrame(rows, columns=[*keys, *[f"b_{x}" for x in xs], "sigma"])
    src = ne if keys else ne.withColumn("_g", F.lit(0))
    coef = src.groupBy(*(keys or ["_g"])).applyInPandas(
        solve if keys else (lambda p: solve(p.drop(columns=["_g"]))), schema)
    last = df.groupBy(*keys).agg(F.max(day).alias("_last"))
    future = last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias(day))
    hist = df.select(*keys, day, F.col(value).cast("double").alias("actual"), F.lit("history").alias("kind"))
    fut = future.select(*keys, day, F.lit(None).cast("double").alias("actual"), F.lit("forecast").alias("kind"))
    allrows = attach(hist.unionByName(fut), coef, keys)
    feats2 = _features(F.datediff(F.col(day), F.lit("1970-01-01")), periods)
    pred = None
    for x in xs:
        term = F.col(f"b_{x}") * feats2[x]
        pred = term if pred is None else pred + term
    return allrows.select(*keys, day, "kind", "actual", pred.alias("yhat"),
                          (pred - 1.96 * F.col("sigma")).alias("yhat_lower"),
                          (pred + 1.96 * F.col("sigma")).alias("yhat_upper"))
