"""Forecast with a trend that may bend (T15): hinges at quantile knots under an L1 penalty, plus Fourier terms.

Spark sums the normal equations of all series: each Arrow batch gives one Gram matrix a
series, whose cells are added up by an ordinary aggregate. What is solved per series is
a matrix of fixed size, however long the series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.attach import attach
from tidewater.session import cut_lineage

PENALTIES = 30  # steps of the penalty's path, over three powers of ten


def _design(t: np.ndarray, knots: np.ndarray, t0, span, periods: dict[float, int]) -> np.ndarray:
    """Columns: 1, s, Fourier pairs, hinges max(0, s - knot), with s = (t - t0) / span."""
    s = (t - t0) / span
    cols = [np.ones_like(s), s]
    for period, k in periods.items():
        for j in range(1, k + 1):
            a = 2 * math.pi * j * t / period
            cols += [np.sin(a), np.cos(a)]
    return np.column_stack([*cols, np.maximum(0.0, s[:, None] - (knots[None, :] - t0) / span)])


def lasso_path(gram: np.ndarray, free: int, penalty: float | None = None) -> tuple[np.ndarray, float, int]:
    """Coefficients from the Gram matrix of [X, z], whose first ``free`` columns are not penalised.

    Coordinate descent on the penalised columns, after the free ones are projected out, along a
    falling penalty. The columns that a penalty selects are fitted again without it, and
    the fit of least BIC is taken; with ``penalty`` (a share of the one that selects nothing),
    the fit of that one. Returns (coefficients, residual sum of squares, columns used)."""
    p, n = len(gram) - 1, gram[0, 0]
    proj = np.linalg.pinv(gram[:free, :free], hermitian=True)
    rest = gram[free:, free:] - gram[free:, :free] @ proj @ gram[:free, free:]
    g, c, zz = rest[:-1, :-1], rest[:-1, -1], max(rest[-1, -1], 0.0)
    scale = np.sqrt(np.maximum(np.diag(g), 0.0))
    usable = scale > 1e-9 * math.sqrt(n)
    scale = np.where(usable, scale, 1.0)
    g, c = g / scale[:, None] / scale[None, :], np.where(usable, c / scale, 0.0)

    def refit(active: np.ndarray) -> tuple[np.ndarray, float, float]:
        idx = [*range(free), *(free + active)]
        x = gram[np.ix_(idx, idx)]
        norm = np.sqrt(np.maximum(np.diag(x), 1e-300))
        b = np.linalg.pinv(x / norm[:, None] / norm[None, :], rcond=1e-11, hermitian=True) @ (gram[idx, p] / norm) / norm
        rss = max(gram[p, p] - b @ gram[idx, p], 1e-12 * max(gram[p, p], 1e-300))
        out = np.zeros(p)
        out[idx] = b
        return out, rss, n * math.log(rss / n) + math.log(n) * len(idx)

    best = (*refit(np.array([], dtype=int)), free)
    top = float(np.abs(c).max()) if len(c) else 0.0
    if top <= 1e-12 * math.sqrt(max(zz, 1e-300)) or top == 0.0:
        return best[0], best[1], free
    path = [penalty] if penalty is not None else np.logspace(-0.05, -3, PENALTIES)
    b, seen = np.zeros(len(c)), set()
    for share in path:
        lam = share * top
        for _ in range(2000):
            moved = 0.0
            for j in np.flatnonzero(usable):
                r = c[j] - g[j] @ b + b[j]
                new = math.copysign(max(abs(r) - lam, 0.0), r)
                moved = max(moved, abs(new - b[j]))
                b[j] = new
            if moved < 1e-6 * top:
                break
        active = np.flatnonzero(b)
        if penalty is None and (tuple(active) in seen or free + len(active) >= n - 1):
            continue
        seen.add(tuple(active))
        fit = refit(active)
        if penalty is not None or fit[2] < best[2]:
            best = (*fit, free + len(active))
    return best[0], best[1], best[3]


def piecewise_forecast(df: DataFrame, keys: Sequence[str], day: str, value: str, horizon: int = 14,
                       periods: dict[float, int] | None = None, knots: int = 25, knot_range: float = 0.8,
                       penalty: float | None = None) -> tuple[DataFrame, DataFrame]:
    """y = trend with bends + Fourier terms per series, for the history and ``horizon`` days more.

    Up to ``knots`` bends are tried, at the quantiles of the days in the first ``knot_range`` of
    the history; days are whole numbers since 1970-01-01. Returns (forecast, changes): the
    forecast has kind, actual, trend, yhat and the 95 % bounds, which past the history widen
    by the bends that may come: as often and, on average, as strong as those of the past.
    ``changes`` has one row a bend that was found, with the change of the slope a day.

    Rows without day or value are no observations, though rows with a day and no value
    are returned with their yhat. Repeated days each count. Null keys are a series
    of their own. Series of one day get their mean, series
    without any value a null yhat and no forecast; an empty table gives empty tables."""
    keys, periods = list(keys), periods or {7.0: 3}
    free = 2 + 2 * sum(periods.values())
    t = F.datediff(F.col(day), F.lit("1970-01-01"))
    ids = ["__id"] if keys else []
    named = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("__id") if keys else None
    rows = df.where(F.col(day).isNotNull()).select(
        *keys, *([named] if keys else []), F.col(day).cast("date").alias("__day"), t.cast("double").alias("__t"), F.col(value).cast("double").alias("__y"))
    known = rows.where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    probs = [knot_range * (j + 1) / (knots + 1) for j in range(knots)]
    frame = cut_lineage(known.groupBy(*ids, *keys).agg(
        F.min("__t").alias("__t0"), F.max("__t").alias("__t1"), F.avg("__y").alias("__mean"),
        F.coalesce(F.nullif(F.stddev_pop("__y"), F.lit(0.0)), F.lit(1.0)).alias("__sd"),
        F.percentile_approx("__t", probs, 10000).alias("__knots")).where(F.col("__t0").isNotNull()))
    width = free + knots + 1
    kt = [f"{k} string" for k in ids]
    stats = frame.drop(*keys)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, part in (f.groupby(ids, sort=False) if ids else [((), f)]):
                one = part.iloc[0]
                span = max(one["__t1"] - one["__t0"], 1.0)
                x = _design(part["__t"].to_numpy(), np.asarray(one["__knots"], float), one["__t0"], span, periods)
                x = np.column_stack([x, (part["__y"].to_numpy() - one["__mean"]) / one["__sd"]])
                out.append([*[one[k] for k in ids], (x.T @ x).ravel()])
            if out:
                yield pd.DataFrame(out, columns=[*ids, "gram"])

    cells = attach(known.drop(*keys), stats, ids).mapInPandas(grams, ", ".join([*kt, "gram array<double>"]))
    cells = cells.select(*ids, F.posexplode("gram").alias("pos", "v")).groupBy(*ids, "pos").agg(F.sum("v").alias("v"))
    packed = cells.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("gram"))
    packed = attach(packed, stats, ids).where(F.col("gram").isNotNull() & (F.size("gram") > 0))
    solved = ", ".join([*kt, "b array<double>", "sigma double", "knots array<double>", "t0 double", "span double", "t1 double",
                        "mean double", "sd double"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for _, r in f.iterrows():
                gram = np.asarray(r["gram"], float).reshape(width, width)
                b, rss, used = lasso_path(gram, free, penalty)
                span = max(r["__t1"] - r["__t0"], 1.0)
                sigma = r["__sd"] * math.sqrt(rss / max(gram[0, 0] - used, 1.0))
                out.append([*[r[k] for k in ids], b, sigma, np.asarray(r["__knots"], float), r["__t0"], span, r["__t1"],
                            r["__mean"], r["__sd"]])
            yield pd.DataFrame(out, columns=[*ids, "b", "sigma", "knots", "t0", "span", "t1", "mean", "sd"])

    fit = cut_lineage(packed.mapInPandas(solve, solved))
    deltas = F.slice("b", free + 1, knots)
    bends = F.arrays_zip(F.col("knots").alias("at"), deltas.alias("change"))
    owners = attach(frame.select(*ids, *keys), fit, ids) if keys else fit
    changes = (owners.select(*keys, "span", "sd", F.explode(bends).alias("c")).where(F.col("c.change") != 0)
               .groupBy(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("c.at").cast("int")).alias("day"))
               .agg(F.sum(F.col("c.change") * F.col("sd") / F.col("span")).alias("slope_change")))

    ahead = owners.select(*keys, *ids, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "t1").select(
        *keys, *ids, F.date_add(F.lit("1970-01-01").cast("date"), (F.col("t1") + F.col("h")).cast("int")).alias("__day"),
        (F.col("t1") + F.col("h")).alias("__t"), F.lit(None).cast("double").alias("__y"), F.lit("forecast").alias("kind"))
    points = attach(rows.withColumn("kind", F.lit("history")).unionByName(ahead), fit, ids, "left")
    s = (F.col("__t") - F.col("t0")) / F.col("span")
    bent = F.aggregate(bends, F.lit(0.0), lambda acc, c: acc + c["change"] * F.greatest(
        F.lit(0.0), (F.col("__t") - c["at"]) / F.col("span")))
    trend = F.col("mean") + F.col("sd") * (F.col("b")[0] + F.col("b")[1] * s + bent)
    season, i = F.lit(0.0), 2
    for period, k in periods.items():
        for j in range(1, k + 1):
            a = 2 * math.pi * j * F.col("__t") / period
            season = season + F.col("b")[i] * F.sin(a) + F.col("b")[i + 1] * F.cos(a)
            i += 2
    # bends to come: Laplace, of the past ones' mean size (a day), as often as knots stood in the past
    size = F.aggregate(deltas, F.lit(0.0), lambda acc, c: acc + F.abs(c)) / knots * F.col("sd") / F.col("span")
    often = knots / (knot_range * F.greatest(F.col("span"), F.lit(float(knots))))
    h = F.greatest(F.lit(0.0), F.col("__t") - F.col("t1"))
    spread = F.sqrt(F.col("sigma") ** 2 + often * 2 * size ** 2 * (h - 1) * h * (2 * h - 1) / 6)
    yhat = trend + F.col("sd") * season
    forecast = points.select(*keys, F.col("__day").alias(day), "kind", F.col("__y").alias("actual"), trend.alias("trend"),
                             yhat.alias("yhat"), (yhat - 1.96 * spread).alias("yhat_lower"),
                             (yhat + 1.96 * spread).alias("yhat_upper"))
    return forecast, changes
