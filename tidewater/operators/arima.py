"""ARIMA family (T6-T8, T17, T19) by Hannan-Rissanen two-stage least squares (SEM-16).

All heavy lifting is Spark: differencing and lag features are window
expressions on block-split series (``rows_frame``), and each least-squares
fit is one grouped aggregate of X'X / X'y. Per-series pandas code only sees
the (k x k) normal equations and the last few values of each series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.timeseries import normal_equations, solve_sub
from tidewater.plans.ordered import POS, rows_frame
from tidewater.session import cut_lineage


def _key_schema(df: DataFrame, keys) -> str:
    return ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)


def difference(df: DataFrame, keys, value: str, d: int, out: str = "w", seasonal: int = 0, D: int = 0) -> DataFrame:
    """(1 - B)^d (1 - B^s)^D applied to ``value`` as one window expression."""
    poly = difference_polynomial(d, seasonal, D)
    width = len(poly)
    if width == 1:
        return df.withColumn(out, F.col(value))

    def aggs(_f, o):
        expr = None
        for k, c in enumerate(poly):
            if c == 0:
                continue
            term = (F.col(value) if k == 0 else F.lag(value, k).over(o)) * float(c)
            expr = term if expr is None else expr + term
        return {out: expr}
    return rows_frame(df, keys, width, aggs)


def _lags(df: DataFrame, keys, cols: dict[str, Sequence[int]]) -> DataFrame:
    """Add ``{column}_l{k}``, the column k rows back, for the lags k of each column."""
    width = max([k for lags in cols.values() for k in lags] + [0]) + 1

    def aggs(_f, o):
        return {f"{c}_l{k}": F.lag(c, k).over(o) for c, lags in cols.items() for k in lags}
    return rows_frame(df, keys, width, aggs) if width > 1 else df


def _fit_table(ne: DataFrame, keys, xs: Sequence[str], prefix: str) -> DataFrame:
    """Solve every series' normal equations: coefficient columns ``{prefix}{i}`` + rss, n."""
    k = len(xs)
    schema = _key_schema(ne, keys)
    schema = (schema + ", " if schema else "") + ", ".join(f"{prefix}{i} double" for i in range(k)) + \
        ", rss double, nobs long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            beta, rss = solve_sub(r, k, list(range(k)))
            row = {c: r[c] for c in keys}
            row.update({f"{prefix}{i}": float(b) for i, b in enumerate(beta)})
            row.update(rss=rss, nobs=int(r["n"]))
            rows.append(row)
        return pd.DataFrame(rows, columns=[*keys, *[f"{prefix}{i}" for i in range(k)], "rss", "nobs"])
    src = ne if keys else ne.withColumn("_g", F.lit(0))
    return src.groupBy(*(keys or ["_g"])).applyInPandas(
        (lambda p: run(p.drop(columns=["_g"]))) if not keys else run, schema)


def _attach(df: DataFrame, table: DataFrame, keys) -> DataFrame:
    from tidewater.plans.attach import attach
    return attach(df, table, keys)


def innovations(df: DataFrame, keys, m: int) -> DataFrame:
    """Stage 1: long AR(m) on ``w``; adds residual column ``e``."""
    lagged = _lags(df, keys, {"w": range(1, m + 1)}).withColumn("one", F.lit(1.0))
    xs = ["one", *[f"w_l{k}" for k in range(1, m + 1)]]
    coef = _fit_table(normal_equations(lagged, keys, "w", xs), keys, xs, "a")
    j = _attach(lagged, coef.drop("rss", "nobs"), keys)
    fit = F.col("a0")
    for k in range(1, m + 1):
        fit = fit + F.col(f"a{k}") * F.col(f"w_l{k}")
    return j.withColumn("e", F.col("w") - fit).select(*keys, POS, "y", "w", "e")


def arma_design(df: DataFrame, keys, ar: Sequence[int], ma: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Regressors: an intercept, past values at the lags ``ar`` and past innovations at the lags ``ma``."""
    lagged = _lags(df, keys, {"w": ar, "e": ma}).withColumn("one", F.lit(1.0))
    return lagged, ["one", *[f"w_l{k}" for k in ar], *[f"e_l{k}" for k in ma]]


def difference_polynomial(d: int, seasonal: int = 0, D: int = 0) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(D):
        sp = np.zeros(seasonal + 1)
        sp[0], sp[seasonal] = 1.0, -1.0
        poly = np.convolve(poly, sp)
    return poly


def _psi(ar: dict[int, float], ma: dict[int, float], poly: np.ndarray, h: int) -> np.ndarray:
    """Weights of past innovations in the forecast, for AR and MA coefficients by lag and the differencing operator."""
    own = np.zeros(max(ar, default=0) + 1)
    own[0] = 1.0
    for lag, c in ar.items():
        own[lag] -= c
    full = np.convolve(own, poly)
    psi = np.zeros(h)
    psi[0] = 1.0
    for j in range(1, h):
        psi[j] = ma.get(j, 0.0) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1))
    return psi


def arima(df: DataFrame, keys: Sequence[str], value: str = "y", order: tuple[int, int, int] = (1, 1, 1),
          steps: int = 10, seasonal: tuple[int, int] = (0, 0), m: int | None = None,
          seasonal_arma: tuple[int, int] = (0, 0)) -> tuple[DataFrame, DataFrame]:
    """Fit ARIMA(p, d, q) per series, with seasonal differencing ``seasonal`` = (D, s)
    and ``seasonal_arma`` = (P, Q) further terms at lags s, 2s, ..., and forecast
    ``steps`` ahead. Returns (model table, forecast table)."""
    keys = list(keys)
    p, d, q = order
    D, s = seasonal
    P, Q = seasonal_arma
    ar = sorted({*range(1, p + 1), *[s * k for k in range(1, P + 1)]})
    ma = sorted({*range(1, q + 1), *[s * k for k in range(1, Q + 1)]})
    base = df.select(*keys, POS, F.col(value).cast("double").alias("y"))
    w = difference(base, keys, "y", d, "w", s, D).where(F.col("w").isNotNull())
    m = m or max(max([*ar, *ma, 0]) + 2, p + q + 2, 6)
    inn = cut_lineage(innovations(w, keys, m) if ma else w.withColumn("e", F.lit(0.0)))
    design, xs = arma_design(inn, keys, ar, ma)
    fit = _fit_table(normal_equations(design, keys, "w", xs), keys, xs, "b")
    k = len(xs)
    model = fit.select(*keys, "nobs", (F.col("rss") / F.col("nobs")).alias("sigma2"),
                       *[F.col(f"b{i}") for i in range(k)])
    model = model.withColumn("aic", F.col("nobs") * F.log("sigma2") + 2.0 * k) \
                 .withColumn("bic", F.col("nobs") * F.log("sigma2") + F.log("nobs") * k)
    # tails: last values of y, w, e per series (bounded by the model order)
    r = max([*ar, *ma, d + D * s, 1]) + d + D * s
    n = inn.groupBy(*keys).agg(F.max(POS).alias("_last"))
    tail = _attach(inn, n, keys).where(F.col(POS) > F.col("_last") - r).drop("_last")
    ylast = _attach(base, base.groupBy(*keys).agg(F.max(POS).alias("_last")), keys).where(
        F.col(POS) > F.col("_last") - (d + D * s + 1)).select(*keys, POS, F.col("y").alias("yt"))
    tails = tail.select(*keys, POS, "w", "e", F.lit(None).cast("double").alias("yt")).unionByName(
        ylast.select(*keys, POS, F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("e"), "yt"))
    packed = _attach(tails, model, keys)
    schema = _key_schema(df, keys)
    schema = (schema + ", " if schema else "") + "step int, forecast double, lower double, upper double"

    def fc(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        coef = np.array([pdf[f"b{i}"].iloc[0] for i in range(k)])
        c, phi, theta = coef[0], dict(zip(ar, coef[1:])), dict(zip(ma, coef[1 + len(ar):]))
        sig = math.sqrt(max(pdf["sigma2"].iloc[0], 0.0))
        ws = list(pdf["w"].dropna())
        es = list(pdf["e"].dropna()) if ma else [0.0] * len(ws)
        ys = list(pdf.loc[pdf["yt"].notna(), "yt"])
        out_w = []
        for h in range(steps):
            val = c + sum(b * (ws[-k] if k <= len(ws) else 0.0) for k, b in phi.items())
            val += sum(b * (es[-k] if k <= len(es) else 0.0) for k, b in theta.items())
            ws.append(val)
            es.append(0.0)
            out_w.append(val)
        # undo differencing: y_t = w_t - sum_{k>=1} poly_k y_{t-k}
        poly = difference_polynomial(d, s, D)
        hist = list(ys)
        fc_y = []
        for wv in out_w:
            yv = wv - sum(poly[j] * hist[-j] for j in range(1, len(poly)) if j <= len(hist))
            hist.append(yv)
            fc_y.append(yv)
        psi = _psi(phi, theta, poly, steps)
        se = sig * np.sqrt(np.cumsum(psi ** 2))
        out = pd.DataFrame({"step": np.arange(1, steps + 1, dtype="int32"), "forecast": fc_y,
                            "lower": np.array(fc_y) - 1.96 * se, "upper": np.array(fc_y) + 1.96 * se})
        for kk in keys:
            out[kk] = pdf[kk].iloc[0]
        return out[[*keys, "step", "forecast", "lower", "upper"]]
    src = packed if keys else packed.withColumn("_g", F.lit(0))
    forecast = src.groupBy(*(keys or ["_g"])).applyInPandas(
        fc if keys else (lambda pdf: fc(pdf.drop(columns=["_g"]))), schema)
    return model, forecast


def _drop_group(fn):
    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.drop(columns=["_g"]))
    return inner


def _order_search(keys, d: int, max_p: int, max_q: int):
    k = 1 + max_p + max_q

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = int(r["n"])
            for pp in range(max_p + 1):
                for qq in range(max_q + 1):
                    idx = [0, *range(1, 1 + pp), *range(1 + max_p, 1 + max_p + qq)]
                    _, rss = solve_sub(r, k, idx)
                    aic = n * math.log(rss / n) + 2 * len(idx) if rss > 0 else 0.0  # no variance at all: nothing to choose
                    row = {c: r[c] for c in keys}
                    row.update(p=pp, d=d, q=qq, aic=aic)
                    rows.append(row)
        return pd.DataFrame(rows, columns=[*keys, "p", "d", "q", "aic"])
    return run


def auto_arima(df: DataFrame, keys: Sequence[str], value: str = "y", max_p: int = 3, max_d: int = 2,
               max_q: int = 3) -> DataFrame:
    """Order search by AIC over p <= 3, d <= 2, q <= 3. For each d one stage-1
    fit and one stage-2 aggregate of the largest design; every (p, q) sub-model
    is a sub-matrix solve. Differencing is a shift with unit Jacobian, so AICs of
    different d compare once all fits use the same rows, which they do."""
    keys = list(keys)
    base = df.select(*keys, POS, F.col(value).cast("double").alias("y"))
    parts = []
    m = max(max_p + max_q + 2, 6)
    for d in range(max_d + 1):
        run = _order_search(keys, d, max_p, max_q)
        w = difference(base, keys, "y", d, "w").where(F.col("w").isNotNull())
        inn = cut_lineage(innovations(w, keys, m))
        design, xs = arma_design(inn, keys, range(1, max_p + 1), range(1, max_q + 1))
        design = design.where(F.col(POS) >= max_d + m + max(max_p, max_q))
        ne = normal_equations(design, keys, "w", xs)
        schema = _key_schema(ne, keys)
        schema = (schema + ", " if schema else "") + "p int, d int, q int, aic double"

        src = ne if keys else ne.withColumn("_g", F.lit(0))
        fn = run if keys else _drop_group(run)
        parts.append(src.groupBy(*(keys or ["_g"])).applyInPandas(fn, schema))
    allm = parts[0]
    for p_ in parts[1:]:
        allm = allm.unionByName(p_)
    best = allm.groupBy(*keys).agg(F.min_by(F.struct("p", "d", "q", "aic"), "aic").alias("b"))
    return best.select(*keys, "b.p", "b.d", "b.q", F.col("b.aic").alias("aic"))


def lag_model(df: DataFrame, keys: Sequence[str], value: str = "y", n_lags: int = 10, train: float = 0.8):
    """T19 (re-aim of the LSTM job): predict y_t from the previous ``n_lags`` values
    with MLlib linear regression; chronological split; MSE / MAE on train and test."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from tidewater.operators.timeseries import chronological_split
    keys = list(keys)
    lagged = _lags(df.select(*keys, POS, F.col(value).cast("double").alias("y")), keys, {"y": range(1, n_lags + 1)})
    cols = [f"y_l{k}" for k in range(1, n_lags + 1)]
    full = lagged.dropna(subset=cols)
    split = chronological_split(full, keys, train)
    va = VectorAssembler(inputCols=cols, outputCol="features")
    tr = va.transform(split.where(F.col("split") == "train"))
    te = va.transform(split.where(F.col("split") == "test"))
    model = LinearRegression(featuresCol="features", labelCol="y").fit(tr)
    res = []
    for name, part in (("train", tr), ("test", te)):
        pr = model.transform(part).agg(F.avg((F.col("prediction") - F.col("y")) ** 2).alias("mse"),
                                       F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae"),
                                       F.count(F.lit(1)).alias("n"))
        res.append(pr.withColumn("part", F.lit(name)))
    return res[0].unionByName(res[1])
