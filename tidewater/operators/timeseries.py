"""Time-series operators (T1-T19) for many series at once: (keys..., order, value).

Every operator works on a *positioned* series (``_pos`` from the block-prefix
helper), so a very long series is still split over many tasks. Regressions
(trend, ADF, ARIMA) are solved from grouped normal equations: the sums
X'X, X'y, y'y are ordinary aggregates (map-side combined), and only the tiny
per-series matrices reach pandas inside ``applyInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.attach import attach
from tidewater.plans.ordered import POS, add_positions, rows_frame
from tidewater.session import cut_lineage


def positioned(df: DataFrame, keys: Sequence[str], order: str, block: Column | None = None) -> DataFrame:
    """Adds ``_pos`` (0-based) within each series ordered by ``order``."""
    if block is None:
        o = F.col(order)
        block = F.floor(F.unix_seconds(o.cast("timestamp")) / (86400 * 32)) if \
            dict(df.dtypes)[order].startswith(("timestamp", "date")) else F.floor(o / 4096)
    return add_positions(df, list(keys), [order], block)


def daily_series(events: DataFrame, keys: Sequence[str], ts: str, value: str | None, how: str = "count") -> DataFrame:
    """(keys..., day, y): daily count / sum / mean of ``value``."""
    agg = {"count": F.count(F.lit(1)), "sum": F.sum(value) if value else None,
           "mean": F.avg(value) if value else None}[how]
    return events.groupBy(*keys, F.to_date(ts).alias("day")).agg(agg.cast("double").alias("y"))


# --- T1 / T2: seasonal decomposition ------------------------------------------------

def _ols_line(df: DataFrame, keys, y: str, x: str, cond: Column, prefix: str) -> DataFrame:
    sub = df.where(cond)
    return sub.groupBy(*keys).agg(F.regr_slope(y, x).alias(f"{prefix}_k"), F.regr_intercept(y, x).alias(f"{prefix}_b"))


def decompose(df: DataFrame, keys: Sequence[str], value: str = "y", period: int = 7,
              model: str = "additive") -> DataFrame:
    """T1 (SEM-14): centred moving-average trend (2 x m for even periods), ends
    extrapolated by least squares on ``period`` trend points, phase means of the
    detrended series centred to 0 (additive) or scaled to mean 1 (multiplicative).
    Input must carry ``_pos``; series shorter than 2 * period are dropped."""
    keys = list(keys)
    half = period // 2
    even = period % 2 == 0
    width = period + 1 if even else period
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base = attach(df, n, keys).where(F.col("_n") >= 2 * period)

    def aggs(framed, ordered):
        s = F.sum(value).over(framed)
        c = F.count(value).over(framed)
        if even:
            t = (s - 0.5 * F.lag(value, period).over(ordered) - 0.5 * F.col(value)) / period
        else:
            t = s / period
        return {"_t": F.when(c == width, t)}
    tr = rows_frame(base.select(*keys, POS, value), keys, width, aggs)
    trend = tr.where(F.col("_t").isNotNull()).select(*keys, (F.col(POS) - half).alias(POS), F.col("_t").alias("trend"))
    withtr = base.join(trend, [*keys, POS], "left")
    front = F.lit(half)
    back = F.col("_n") - 1 - half
    fl = F.least(front + period, back)
    bf = F.greatest(front, back - period)
    p = F.col(POS).cast("double")
    head = _ols_line(withtr.withColumn("_p", p), keys, "trend", "_p", (F.col(POS) >= front) & (F.col(POS) < fl), "h")
    tail = _ols_line(withtr.withColumn("_p", p), keys, "trend", "_p", (F.col(POS) >= bf) & (F.col(POS) < back), "t")
    full = attach(attach(withtr, head, keys, "left"), tail, keys, "left")
    full = full.withColumn("trend", F.coalesce(
        F.col("trend"),
        F.when(F.col(POS) < front, F.col("h_k") * p + F.col("h_b")),
        F.when(F.col(POS) > back, F.col("t_k") * p + F.col("t_b"))))
    mult = model.startswith("m")
    det = (F.col(value) / F.col("trend")) if mult else (F.col(value) - F.col("trend"))
    full = cut_lineage(full.withColumn("_det", det).withColumn("_phase", (F.col(POS) % period).cast("int")))
    phase = full.groupBy(*keys, "_phase").agg(F.avg("_det").alias("_pa"))
    center = phase.groupBy(*keys).agg(F.avg("_pa").alias("_pm"))
    phase = attach(phase, center, keys)
    phase = phase.select(*keys, "_phase", ((F.col("_pa") / F.col("_pm")) if mult else (F.col("_pa") - F.col("_pm")))
                         .alias("seasonal"))
    out = full.join(phase, [*keys, "_phase"])
    resid = (F.col(value) / (F.col("seasonal") * F.col("trend"))) if mult else (F.col("_det") - F.col("seasonal"))
    return out.select(*keys, POS, F.col(value).alias("observed"), "trend", "seasonal", resid.alias("resid"))


def seasonality_strength(decomposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """var(S) / (var(S) + var(R)) with population variances; 0 when both are 0."""
    v = decomposed.groupBy(*keys).agg(F.var_pop("seasonal").alias("vs"), F.var_pop("resid").alias("vr"))
    return v.select(*keys, F.when(F.col("vs") + F.col("vr") == 0, 0.0)
                    .otherwise(F.col("vs") / (F.col("vs") + F.col("vr"))).alias("seasonality_strength"))


# --- T4 / T5: autocorrelation --------------------------------------------------------

def acf(df: DataFrame, keys: Sequence[str], value: str = "y", max_lags: int = 40) -> DataFrame:
    """T4: r_k = sum (x_t - m)(x_{t+k} - m) / sum (x_t - m)^2 for k <= min(40, n // 4)."""
    keys = list(keys)
    st = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    nmax = st.agg(F.max("_n")).collect()[0][0] or 0
    K = max(0, min(max_lags, nmax // 4))
    base = attach(df, st, keys).withColumn("_d", F.col(value) - F.col("_m"))
    if K == 0:
        lagged = base.withColumn("_prods", F.array().cast("array<double>"))
    else:
        lagged = rows_frame(base.select(*keys, POS, "_d", "_n"), keys, K + 1,
                            lambda _f, o: {"_prods": F.array(*[F.col("_d") * F.lag("_d", k).over(o)
                                                                for k in range(1, K + 1)])})
    ex = lagged.select(*keys, "_n", (F.col("_d") * F.col("_d")).alias("_sq"),
                       F.posexplode(F.concat(F.array(F.col("_d") * F.col("_d")), "_prods")).alias("lag", "_p"))
    agg = ex.groupBy(*keys, "lag").agg(F.sum("_p").alias("_s"), F.first("_n").alias("_n"))
    den = ex.where(F.col("lag") == 0).groupBy(*keys).agg(F.sum("_p").alias("_den"))
    j = attach(agg, den, keys)
    return j.where(F.col("lag") <= F.least(F.lit(max_lags), F.floor(F.col("_n") / 4))).select(
        *keys, F.col("lag").cast("int").alias("lag"), (F.col("_s") / F.col("_den")).alias("acf"))


def _levinson(r: np.ndarray, nlags: int) -> np.ndarray:
    """Durbin-Levinson: partial autocorrelations from autocorrelations r[0..nlags]."""
    pacf = np.zeros(nlags + 1)
    pacf[0] = 1.0
    phi = np.zeros(nlags + 1)
    prev = np.zeros(nlags + 1)
    v = r[0]
    for k in range(1, nlags + 1):
        acc = r[k] - np.dot(prev[1:k], r[1:k][::-1]) if k > 1 else r[1]
        phi_kk = acc / v if v != 0 else 0.0
        phi[1:k] = prev[1:k] - phi_kk * prev[1:k][::-1]
        phi[k] = phi_kk
        v = v * (1 - phi_kk ** 2)
        pacf[k] = phi_kk
        prev = phi.copy()
    return pacf


def pacf(df: DataFrame, keys: Sequence[str], value: str = "y", max_lags: int = 40) -> DataFrame:
    """T5: Yule-Walker (adjusted) partial autocorrelations. Lagged cross products
    are summed in Spark; the per-series recursion runs on <= 41 numbers."""
    keys = list(keys)
    a = acf(df, keys, value, max_lags)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # adjusted autocovariance ratio: r_k * n / (n - k)
    adj = attach(a, n, keys).withColumn(
        "r", F.col("acf") * F.col("_n") / (F.col("_n") - F.col("lag")))
    key_schema = ", ".join(f"{k} {t}" for k, t in adj.select(*keys).dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["r"].to_numpy(dtype=float)
        k = len(r) - 1
        vals = _levinson(r, k) if k > 0 else np.array([1.0])
        out = pd.DataFrame({"lag": np.arange(k + 1, dtype="int32"), "pacf": vals})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "lag", "pacf"]]
    schema = (key_schema + ", " if key_schema else "") + "lag int, pacf double"
    grouped = adj.groupBy(*keys) if keys else adj.groupBy(F.lit(0).alias("_g"))
    if not keys:
        return adj.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(
            lambda p: solve(p.drop(columns=["_g"])), "lag int, pacf double")
    return grouped.applyInPandas(solve, schema)


# --- T9 / T10 / T11 / T13 / T14 / T18: closed forms ----------------------------------------

def outliers(df: DataFrame, keys: Sequence[str], value: str = "y", method: str = "iqr",
             threshold: float = 1.5) -> DataFrame:
    """Per-row outlier flag and per-series count / percentage."""
    from tidewater.plans.quantiles import quantile_wide
    keys = list(keys)
    if method == "iqr":
        b = quantile_wide(df, [value], [0.25, 0.75], by=keys, names=["q1", "q3"]).drop("column")
        b = b.select(*keys, (F.col("q1") - threshold * (F.col("q3") - F.col("q1"))).alias("_lo"),
                     (F.col("q3") + threshold * (F.col("q3") - F.col("q1"))).alias("_hi"))
        j = attach(df, b, keys)
        flag = (F.col(value) < F.col("_lo")) | (F.col(value) > F.col("_hi"))
    else:
        b = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
        j = attach(df, b, keys)
        flag = F.abs((F.col(value) - F.col("_m")) / F.col("_s")) > threshold
    flagged = j.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("outlier_count")).withColumn(
        "outlier_percentage", 100.0 * F.col("outlier_count") / F.col("n"))


def zscore_anomalies(df: DataFrame, keys: Sequence[str], value: str = "y", threshold: float = 2.5) -> DataFrame:
    """|x - mean| / sample std > threshold, per series."""
    keys = list(keys)
    b = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    j = attach(df, b, keys)
    z = F.abs((F.col(value) - F.col("_m")) / F.col("_s"))
    return j.withColumn("z", z).withColumn("is_anomaly", F.coalesce(z > threshold, F.lit(False))).drop("_m", "_s")


def band_anomalies(df: DataFrame, keys: Sequence[str], value: str = "y", window: int = 20,
                   factor: float = 2.0) -> DataFrame:
    """Outside rolling mean +- factor * rolling std (the row is inside its own window)."""
    def aggs(framed, _o):
        full = F.count(value).over(framed) == window
        return {"_ma": F.when(full, F.avg(value).over(framed)), "_sd": F.when(full, F.stddev_samp(value).over(framed))}
    out = rows_frame(df, keys, window, aggs)
    upper = F.col("_ma") + factor * F.col("_sd")
    lower = F.col("_ma") - factor * F.col("_sd")
    return (out.withColumn("upper", upper).withColumn("lower", lower)
            .withColumn("is_anomaly", F.coalesce((F.col(value) > upper) | (F.col(value) < lower), F.lit(False)))
            .drop("_ma", "_sd"))


def linear_trend(df: DataFrame, keys: Sequence[str], value: str = "y") -> DataFrame:
    """Slope / intercept on position, r^2 as strength, direction and significance."""
    p = F.col(POS).cast("double")
    t = df.groupBy(*keys).agg(F.regr_slope(value, p).alias("slope"), F.regr_intercept(value, p).alias("intercept"),
                              F.regr_r2(value, p).alias("strength"))
    return t.select(*keys, "slope", "intercept", "strength",
                    F.when(F.col("slope") > 0, "Increasing").otherwise("Decreasing").alias("direction"),
                    F.when(F.col("strength") > 0.5, "Strong").when(F.col("strength") < 0.2, "Weak")
                    .otherwise("Moderate").alias("significance"))


def prepare(df: DataFrame, keys: Sequence[str], value: str = "y", missing: str = "interpolate",
            scale: bool = True) -> DataFrame:
    """Missing treatment (drop / ffill / bfill / interpolate) then min-max scaling per series."""
    from tidewater.operators.windows import bfill, ffill, interpolate
    keys = list(keys)
    if missing == "drop":
        out = df.where(F.col(value).isNotNull()).withColumn("prepared", F.col(value))
    elif missing == "ffill":
        out = ffill(df, keys, value, "prepared")
    elif missing == "bfill":
        out = bfill(df, keys, value, "prepared")
    else:
        out = interpolate(df, keys, value, "prepared")
    if scale:
        mm = out.groupBy(*keys).agg(F.min("prepared").alias("_lo"), F.max("prepared").alias("_hi"))
        out = attach(out, mm, keys)
        out = out.withColumn("prepared", F.when(F.col("_hi") == F.col("_lo"), 0.0).otherwise(
            (F.col("prepared") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
    return out


def chronological_split(df: DataFrame, keys: Sequence[str], train: float = 0.8) -> DataFrame:
    """First int(n * train) positions of each series train, the rest test."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = attach(df, n, keys)
    return j.withColumn("split", F.when(F.col(POS) < F.floor(F.col("_n") * train), "train").otherwise("test")).drop("_n")


def future_dates(last: DataFrame, keys: Sequence[str], last_col: str, periods: int, freq: str = "D") -> DataFrame:
    """The ``periods`` dates after each series' last date; step k is last + k units
    (D = day, W = 7 days, M = month, Q = 3 months, Y = 12 months, calendar arithmetic)."""
    unit, mult = {"D": ("day", 1), "W": ("day", 7), "M": ("month", 1), "Q": ("month", 3), "Y": ("month", 12)}[freq]
    k = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_k")
    ex = last.select(*keys, last_col, k)
    step = F.col("_k") * mult
    date = F.date_add(F.col(last_col), step) if unit == "day" else F.add_months(F.col(last_col), step)
    return ex.select(*keys, date.alias("date"))


# --- grouped least squares ---------------------------------------------------------------

#: Directions of the scaled design whose share of the variance is below this are dropped.
RANK_TOLERANCE = 1e-11


def normal_equations(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per series: n, means and scales of y and each x, and the sums of products of the
    centred, scaled variables. Centring comes first, because sums of raw products
    of a trend cancel beyond double precision. A regressor named ``one`` is the
    intercept; without one nothing is centred."""
    cond = F.col(y).isNotNull()
    for a in xs:
        cond = cond & F.col(a).isNotNull()
    rows = df.where(cond)
    centred = "one" in xs
    stats = [F.count(F.lit(1)).alias("n"), (F.avg(y) if centred else F.lit(0.0)).alias("y_mean")]
    for i, a in enumerate(xs):
        stats.append((F.avg(a) if centred and a != "one" else F.lit(0.0)).alias(f"mean_{i}"))
        scale = F.stddev_pop(a) if centred and a != "one" else F.sqrt(F.avg(F.col(a) * F.col(a)))
        stats.append(F.when(scale > 0, scale).otherwise(1.0).alias(f"scale_{i}"))
    from tidewater.plans.attach import attach
    names = ["n", "y_mean", *[f"{w}_{i}" for i in range(len(xs)) for w in ("mean", "scale")]]
    keyed = rows.groupBy(*keys).agg(*stats).select(*keys, *[F.col(c).alias(f"_st_{c}") for c in names])
    joined = attach(rows, keyed, keys)
    yc = F.col(y) - F.col("_st_y_mean")
    z = [(F.col(a) - F.col(f"_st_mean_{i}")) / F.col(f"_st_scale_{i}") for i, a in enumerate(xs)]
    aggs = [F.first(f"_st_{c}").alias(c) for c in names] + [F.sum(yc * yc).alias("yy")]
    for i in range(len(xs)):
        aggs.append(F.sum(z[i] * yc).alias(f"xy_{i}"))
        for j in range(i, len(xs)):
            aggs.append(F.sum(z[i] * z[j]).alias(f"xx_{i}_{j}"))
    # whether position 0 is an intercept travels with the sums
    return joined.groupBy(*keys).agg(*aggs, F.lit(centred).alias("centred"))


def _scaled(row: pd.Series, idx: Sequence[int]):
    """Gram matrix and cross products of the scaled regressors in ``idx``."""
    G = np.empty((len(idx), len(idx)))
    for a, i in enumerate(idx):
        for b, j in enumerate(idx):
            G[a, b] = row[f"xx_{min(i, j)}_{max(i, j)}"]
    return G, np.array([row[f"xy_{i}"] for i in idx])


def _inverse(G: np.ndarray) -> np.ndarray:
    """Inverse on the directions that the data determine."""
    if not len(G):
        return G
    w, V = np.linalg.eigh(G)
    keep = w > RANK_TOLERANCE * max(w.max(), 1e-300)
    return (V[:, keep] / w[keep]) @ V[:, keep].T


def solve_sub(row: pd.Series, k: int, idx: Sequence[int]):
    """OLS on a sub-set of regressors: beta, residual sum of squares. ``idx`` starts with the intercept, if there is one."""
    rest = [i for i in idx if not (row["centred"] and i == 0)]
    G, g = _scaled(row, rest)
    b = _inverse(G) @ g if rest else g
    # sums that cancel leave rounding noise of this size; no fit counts as better than that
    rss = max(float(row["yy"] - 2 * b @ g + b @ G @ b), 1e-14 * float(row["yy"]))
    slope = {i: b[a] / row[f"scale_{i}"] for a, i in enumerate(rest)}
    intercept = row["y_mean"] - sum(s * row[f"mean_{i}"] for i, s in slope.items())
    return np.array([slope.get(i, intercept) for i in idx]), rss


def slope_variance(row: pd.Series, idx: Sequence[int], which: int, sigma2: float) -> float:
    """The variance of the estimate of regressor ``which`` (not the intercept)."""
    rest = [i for i in idx if not (row["centred"] and i == 0)]
    a = rest.index(which)
    return sigma2 * _inverse(_scaled(row, rest)[0])[a, a] / row[f"scale_{which}"] ** 2


# --- T3: augmented Dickey-Fuller ------------------------------------------------------

# MacKinnon (2010) response-surface coefficients for the ADF test
# with a constant ("c"): critical value = b0 + b1/n + b2/n^2 + b3/n^3.
ADF_CRIT_C = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
              "5%": (-2.86154, -2.8903, -4.234, -40.040),
              "10%": (-2.56677, -1.5384, -2.809, 0.0)}
# MacKinnon (1994) approximate p-values with a constant. The normal
# quantile of p is a polynomial of the statistic, one below the border and one above it;
# beyond the outer limits p is 0 or 1.
ADF_P_LOW, ADF_P_BORDER, ADF_P_HIGH = -18.83, -1.61, 2.74
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p_value(t: float) -> float:
    """The approximate p-value of the statistic under a unit root."""
    if math.isnan(t):
        return t
    if t > ADF_P_HIGH:
        return 1.0
    if t < ADF_P_LOW:
        return 0.0
    quantile = sum(c * t ** i for i, c in enumerate(ADF_P_SMALL if t <= ADF_P_BORDER else ADF_P_LARGE))
    return 0.5 * math.erfc(-quantile / math.sqrt(2))


def adf_test(df: DataFrame, keys: Sequence[str], value: str = "y", maxlag: int | None = None) -> DataFrame:
    """T3 (SEM-15): regression of dy_t on [1, y_{t-1}, dy_{t-1..p}], lag order by AIC on
    the common sample (one nested set of normal equations), t statistic of y_{t-1};
    critical values and the p-value from published response surfaces. A series is
    taken for stationary if p < 0.05."""
    keys = list(keys)
    nmax = df.groupBy(*keys).count().agg(F.max("count")).collect()[0][0]
    L = maxlag if maxlag is not None else int(math.ceil(12 * (nmax / 100.0) ** 0.25))
    L = max(0, min(L, nmax // 2 - 2))

    def aggs(_f, o):
        d = {"dy": F.col(value) - F.lag(value, 1).over(o), "ylag": F.lag(value, 1).over(o)}
        for k in range(1, L + 1):
            d[f"dl{k}"] = F.lag(value, k).over(o) - F.lag(value, k + 1).over(o)
        return d
    lagged = rows_frame(df.select(*keys, POS, value), keys, L + 2, aggs).withColumn("one", F.lit(1.0))
    xs = ["one", "ylag", *[f"dl{k}" for k in range(1, L + 1)]]
    ne = normal_equations(lagged, keys, "dy", xs)
    schema = ", ".join(f"{k} {t}" for k, t in ne.select(*keys).dtypes)
    schema = (schema + ", " if schema else "") + ("adf_statistic double, p_value double, used_lag int, nobs long, "
                                                  "crit_1 double, crit_5 double, crit_10 double, is_stationary boolean")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            n = int(r["n"])
            best = None
            for p in range(0, L + 1):
                idx = list(range(2 + p))
                beta, rss = solve_sub(r, len(xs), idx)
                aic = n * math.log(rss / n) + 2 * len(idx) if rss > 0 else 0.0  # no variance at all: nothing to choose
                if best is None or aic < best[0]:
                    best = (aic, p, beta, rss, idx)
            _, p, beta, rss, idx = best
            var = slope_variance(r, idx, 1, rss / max(n - len(idx), 1))
            t = beta[1] / math.sqrt(var) if var > 0 else float("nan")
            crit = {k: b0 + b1 / n + b2 / n ** 2 + b3 / n ** 3 for k, (b0, b1, b2, b3) in ADF_CRIT_C.items()}
            out = {k: r[k] for k in keys}
            out.update(adf_statistic=t, p_value=adf_p_value(t), used_lag=p, nobs=n, crit_1=crit["1%"], crit_5=crit["5%"],
                       crit_10=crit["10%"], is_stationary=bool(adf_p_value(t) < 0.05))
            rows.append(out)
        return pd.DataFrame(rows, columns=[*keys, "adf_statistic", "p_value", "used_lag", "nobs", "crit_1", "crit_5",
                                           "crit_10", "is_stationary"])
    g = ne.groupBy(*keys) if keys else ne.withColumn("_g", F.lit(0)).groupBy("_g")
    if not keys:
        return ne.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda p: run(p.drop(columns=["_g"])), schema)
    return g.applyInPandas(run, schema)
