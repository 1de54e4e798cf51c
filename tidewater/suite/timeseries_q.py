"""Time-series queries (T1-T19) on daily series derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import arima as AR
from tidewater.operators import changepoints as CP
from tidewater.operators import forecast as FC
from tidewater.operators import isolation as IF
from tidewater.operators import likelihood as ML
from tidewater.operators import timeseries as TS
from tidewater.plans.ordered import POS
from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6, with_dirty

KEYS = ["event_type"]


def daily(spark, d, how="count", value=None):
    s = TS.daily_series(table(spark, d, "events"), KEYS, "ts", value, how)
    return TS.positioned(s, KEYS, "day")


def _out(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd")) if "day" in df.columns else df


DAILY_SQL = """s AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM s)"""
DAILY_SUM_SQL = """s AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(value) AS DOUBLE) AS y FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM s)"""


def _decompose_sql(period: int, mult: bool, daily_sql: str) -> str:
    h = period // 2
    if period % 2:
        t0 = f"CASE WHEN count(y) OVER w = {period} THEN avg(y) OVER w END"
    else:
        t0 = (f"CASE WHEN count(y) OVER w = {period + 1} THEN (sum(y) OVER w - 0.5 * lag(y, {h}) OVER o "
              f"- 0.5 * lead(y, {h}) OVER o) / {period} END")
    det = "y / trend" if mult else "y - trend"
    cen = "pa / avg(pa) OVER (PARTITION BY event_type)" if mult else "pa - avg(pa) OVER (PARTITION BY event_type)"
    resid = "y / (seasonal * trend)" if mult else "det - seasonal"
    return f"""WITH {daily_sql},
t AS (SELECT *, {t0} AS trend0 FROM p WHERE n >= {2 * period}
  WINDOW w AS (PARTITION BY event_type ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING),
         o AS (PARTITION BY event_type ORDER BY pos)),
hd AS (SELECT event_type, regr_slope(trend0, pos) AS hk, regr_intercept(trend0, pos) AS hb FROM t
  WHERE pos >= {h} AND pos < least({h} + {period}, n - 1 - {h}) GROUP BY 1),
tl AS (SELECT event_type, regr_slope(trend0, pos) AS tk, regr_intercept(trend0, pos) AS tb FROM t
  WHERE pos >= greatest({h}, n - 1 - {h} - {period}) AND pos < n - 1 - {h} GROUP BY 1),
f AS (SELECT t.*, coalesce(trend0, CASE WHEN pos < {h} THEN hk * pos + hb END, CASE WHEN pos > n - 1 - {h} THEN tk * pos + tb END) AS trend
  FROM t LEFT JOIN hd USING (event_type) LEFT JOIN tl USING (event_type)),
dd AS (SELECT *, {det} AS det, pos % {period} AS phase FROM f),
pa AS (SELECT event_type, phase, avg(det) AS pa FROM dd GROUP BY 1, 2),
pc AS (SELECT event_type, phase, {cen} AS seasonal FROM pa),
dec AS (SELECT event_type, strftime(day, '%Y-%m-%d') AS day, y AS observed, trend, seasonal, {resid} AS resid
  FROM dd JOIN pc USING (event_type, phase))"""


def _decompose(spark, d, period, model, how="count", value=None):
    p = daily(spark, d, how, value)
    dec = TS.decompose(p, KEYS, "y", period, model)
    days = p.select(*KEYS, POS, "day")
    return dec.join(days, [*KEYS, POS]).drop(POS)


_DEC_COLS = f"event_type, day, {r6('observed')} AS observed, {r6('trend')} AS trend, {r6('seasonal')} AS seasonal, {r6('resid')} AS resid"


@register("ts_decompose", _decompose_sql(7, False, DAILY_SQL) + f"\nSELECT {_DEC_COLS} FROM dec")
def ts_decompose(spark, d):
    return _out(_decompose(spark, d, 7, "additive"))


@register("ts_decompose_mult", _decompose_sql(6, True, DAILY_SUM_SQL) + f"\nSELECT {_DEC_COLS} FROM dec")
def ts_decompose_mult(spark, d):
    return _out(_decompose(spark, d, 6, "multiplicative", "sum", "value"))


@register("ts_seasonality", _decompose_sql(7, False, DAILY_SQL) + f"""
SELECT event_type, {r6('CASE WHEN var_pop(seasonal) + var_pop(resid) = 0 THEN 0.0 ELSE var_pop(seasonal) / (var_pop(seasonal) + var_pop(resid)) END')}
  AS seasonality_strength FROM dec GROUP BY event_type""")
def ts_seasonality(spark, d):
    return TS.seasonality_strength(_decompose(spark, d, 7, "additive"), KEYS)


@register("ts_acf", f"""WITH {DAILY_SQL},
m AS (SELECT *, y - avg(y) OVER (PARTITION BY event_type) AS dv FROM p)
SELECT a.event_type, CAST(k.lag AS INT) AS lag, {r6('sum(a.dv * b.dv) / max(den.s)')} AS acf
FROM m a, range(0, 41) k(lag), m b, (SELECT event_type, sum(dv * dv) AS s FROM m GROUP BY 1) den
WHERE b.event_type = a.event_type AND b.pos = a.pos + k.lag AND den.event_type = a.event_type
  AND k.lag <= least(40, a.n // 4)
GROUP BY a.event_type, k.lag""")
def ts_acf(spark, d):
    return TS.acf(daily(spark, d), KEYS, "y")


@register("ts_outliers", f"""WITH {DAILY_SQL},
b AS (SELECT event_type, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM p GROUP BY 1)
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count,
  {r6('100.0 * count(*) FILTER (WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) / count(*)')} AS outlier_percentage
FROM p JOIN b USING (event_type) GROUP BY event_type""")
def ts_outliers(spark, d):
    return TS.outliers(daily(spark, d), KEYS, "y", "iqr", 1.5)


@register("ts_outliers_z", f"""
WITH b AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT user_id, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE abs((value - m) / sd) > 2.0) AS BIGINT) AS outlier_count,
  {r6('100.0 * count(*) FILTER (WHERE abs((value - m) / sd) > 2.0) / count(*)')} AS outlier_percentage
FROM events JOIN b USING (user_id) GROUP BY user_id""")
def ts_outliers_z(spark, d):
    ev = table(spark, d, "events").select("user_id", "value")
    return TS.outliers(ev, ["user_id"], "value", "zscore", 2.0)


@register("ts_anomaly_z", f"""
WITH b AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1)
SELECT event_id, {r6('abs((value - m) / sd)')} AS z, coalesce(abs((value - m) / sd) > 2.5, false) AS is_anomaly
FROM events JOIN b USING (user_id)""")
def ts_anomaly_z(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    return TS.zscore_anomalies(ev, ["user_id"], "value", 2.5).select("event_id", "z", "is_anomaly")


_BAND = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@register("ts_anomaly_ma", f"""
SELECT event_id, {r6('ma + 2.0 * sd')} AS upper, {r6('ma - 2.0 * sd')} AS lower,
  coalesce(value > ma + 2.0 * sd OR value < ma - 2.0 * sd, false) AS is_anomaly FROM (
  SELECT event_id, value, CASE WHEN count(value) OVER {_BAND} = 20 THEN avg(value) OVER {_BAND} END AS ma,
    CASE WHEN count(value) OVER {_BAND} = 20 THEN stddev_samp(value) OVER {_BAND} END AS sd FROM events)""")
def ts_anomaly_ma(spark, d):
    from tidewater.suite.windows_q import events_positioned
    out = TS.band_anomalies(events_positioned(spark, d), ["user_id"], "value", 20, 2.0)
    return out.select("event_id", "upper", "lower", "is_anomaly")


@register("ts_trend", f"""WITH {DAILY_SQL}
SELECT event_type, {r6('regr_slope(y, pos)')} AS slope, {r6('regr_intercept(y, pos)')} AS intercept,
  {r6('regr_r2(y, pos)')} AS strength, CASE WHEN regr_slope(y, pos) > 0 THEN 'Increasing' ELSE 'Decreasing' END AS direction,
  CASE WHEN regr_r2(y, pos) > 0.5 THEN 'Strong' WHEN regr_r2(y, pos) < 0.2 THEN 'Weak' ELSE 'Moderate' END AS significance
FROM p GROUP BY event_type""")
def ts_trend(spark, d):
    return TS.linear_trend(daily(spark, d), KEYS, "y")


_P_UP = "(ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_P_DOWN = "(ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("ts_prepare", with_dirty(f"""
SELECT event_id, {r6('CASE WHEN hi = lo THEN 0.0 ELSE (v - lo) / (hi - lo) END')} AS prepared FROM (
  SELECT event_id, v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (
    SELECT event_id, CASE WHEN value IS NOT NULL THEN value
      WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp)
      WHEN pp IS NOT NULL THEN pv END AS v
    FROM (SELECT event_id, value, p,
      last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER {_P_UP} AS pp,
      last_value(value IGNORE NULLS) OVER {_P_UP} AS pv,
      first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER {_P_DOWN} AS np,
      first_value(value IGNORE NULLS) OVER {_P_DOWN} AS nv
      FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM dirty))))"""))
def ts_prepare(spark, d):
    from tidewater.suite.windows_q import dirty_positioned
    out = TS.prepare(dirty_positioned(spark, d), [], "value", "interpolate", True)
    return out.select("event_id", "prepared")


@register("ts_future_dates", """
SELECT event_type, strftime(CAST(last_day AS DATE) + CAST(k AS INT), '%Y-%m-%d') AS date
FROM (SELECT event_type, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY 1), range(1, 15) t(k)""")
def ts_future_dates(spark, d):
    last = table(spark, d, "events").groupBy("event_type").agg(F.max(F.to_date("ts")).alias("last_day"))
    out = TS.future_dates(last, KEYS, "last_day", 14, "D")
    return out.select("event_type", F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("ts_future_months", """
SELECT event_type, strftime(CAST(last_day + to_months(CAST(k AS INT)) AS DATE), '%Y-%m-%d') AS date
FROM (SELECT event_type, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY 1), range(1, 7) t(k)""")
def ts_future_months(spark, d):
    last = table(spark, d, "events").groupBy("event_type").agg(F.max(F.to_date("ts")).alias("last_day"))
    out = TS.future_dates(last, KEYS, "last_day", 6, "M")
    return out.select("event_type", F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("ts_split", f"""WITH {DAILY_SQL}
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM p""")
def ts_split(spark, d):
    out = TS.chronological_split(daily(spark, d), KEYS, 0.8)
    return _out(out.select("event_type", "day", "split"))


def _ar1_sql(a: str) -> str:
    """Exact log-likelihood of a first-order autoregression, mean and variance solved for, from sums of the centred series."""
    weight = f"((1 - {a} * {a}) + (n - 1) * (1 - {a}) * (1 - {a}))"
    cross = f"((1 - {a} * {a}) * f + (1 - {a}) * (sx - {a} * sb))"
    square = f"((1 - {a} * {a}) * f * f + sxx - 2 * {a} * sxb + {a} * {a} * sbb)"
    return f"(-0.5 * n * (ln(2 * pi() * ({square} - {cross} * {cross} / {weight}) / n) + 1) + 0.5 * ln(1 - {a} * {a}))"


# --- model-based (rows-only checks) ---------------------------------------------------

@register("ts_pacf")
def ts_pacf(spark, d):
    return TS.pacf(daily(spark, d), KEYS, "y")


@register("ts_adf")
def ts_adf(spark, d):
    return TS.adf_test(daily(spark, d), KEYS, "y")


@register("ts_adf_simple", f"""
WITH {DAILY_SQL},
l AS (SELECT event_type, y - lag(y) OVER o AS dy, lag(y) OVER o AS x FROM p WINDOW o AS (PARTITION BY event_type ORDER BY pos)),
m AS (SELECT event_type, count(*) AS n, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1),
t AS (SELECT *, b / sqrt((syy - b * b * sxx) / (n - 2) / sxx) AS t FROM m)
SELECT event_type, {r6('t')} AS adf_statistic, 0 AS used_lag, CAST(n AS BIGINT) AS nobs, """ + ", ".join(
    f"{r6(f'{b[0]} + {b[1]} / n + {b[2]} / (n * n) + {b[3]} / (n * n * n)')} AS crit_{k.rstrip('%')}" for k, b in TS.ADF_CRIT_C.items()) + " FROM t")
def ts_adf_simple(spark, d):
    """The test without lagged differences, which has a closed form."""
    return TS.adf_test(daily(spark, d), KEYS, "y", maxlag=0).drop("p_value", "is_stationary")


@register("ts_arima")
def ts_arima(spark, d):
    model, fc = AR.arima(daily(spark, d), KEYS, "y", (1, 1, 1), 10)
    return fc.join(model.select(*KEYS, "aic", "bic", "sigma2"), KEYS)


@register("ts_sarima")
def ts_sarima(spark, d):
    model, fc = AR.arima(daily(spark, d), KEYS, "y", (1, 0, 1), 7, seasonal=(1, 7))
    return fc.join(model.select(*KEYS, "aic"), KEYS)


@register("ts_auto_arima")
def ts_auto_arima(spark, d):
    return AR.auto_arima(daily(spark, d), KEYS, "y")


@register("ts_arima_ml")
def ts_arima_ml(spark, d):
    """ARIMA(1, 1, 1) by exact maximum likelihood, ten days ahead with AIC and BIC."""
    fits = ML.arima_ml(daily(spark, d), KEYS, "y", (1, 1, 1))
    return fits.forecasts(10).join(fits.models().select(*KEYS, "aic", "bic"), KEYS)


@register("ts_arima_ml_coef")
def ts_arima_ml_coef(spark, d):
    """Coefficients with standard errors and p-values."""
    return ML.arima_ml(daily(spark, d), KEYS, "y", (1, 0, 1)).coefficients()


@register("ts_sarima_ml")
def ts_sarima_ml(spark, d):
    """Weekly seasonal model, a week ahead."""
    return ML.arima_ml(daily(spark, d), KEYS, "y", (1, 0, 0), (0, 1, 1, 7)).forecasts(7)


@register("ts_auto_arima_ml")
def ts_auto_arima_ml(spark, d):
    """The order of least AIC among all 48, each fitted by exact maximum likelihood."""
    return ML.auto_arima_ml(daily(spark, d), KEYS, "y").models()


#: the likelihood of a first-order autoregression depends on five sums; a ternary search finds its maximum
@register("ts_ar1_ml", f"""WITH RECURSIVE {DAILY_SQL},
c AS (SELECT event_type, pos, n, y - avg(y) OVER (PARTITION BY event_type) AS x FROM p),
l AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY pos) AS b FROM c),
m AS (SELECT event_type, max(n) AS n, max(CASE WHEN pos = 0 THEN x END) AS f, sum(CASE WHEN b IS NOT NULL THEN x END) AS sx,
  coalesce(sum(b), 0) AS sb, sum(CASE WHEN b IS NOT NULL THEN x * x END) AS sxx, sum(b * b) AS sbb, sum(x * b) AS sxb FROM l GROUP BY 1),
search(event_type, lo, hi, i) AS (
  SELECT event_type, CAST(-0.998 AS DOUBLE), CAST(0.998 AS DOUBLE), 0 FROM m
  UNION ALL SELECT event_type, CASE WHEN l1 < l2 THEN a1 ELSE lo END, CASE WHEN l1 < l2 THEN hi ELSE a2 END, i + 1 FROM (
    SELECT s.*, {{0}} AS l1, {{1}} AS l2 FROM (SELECT *, lo + (hi - lo) / 3 AS a1, hi - (hi - lo) / 3 AS a2 FROM search WHERE i < 60) s JOIN m USING (event_type))),
best AS (SELECT m.*, (lo + hi) / 2 AS a FROM search JOIN m USING (event_type) WHERE i = 60),
r AS (SELECT event_type, n, a, {{2}} AS ll FROM best)
SELECT event_type, round(a, 3) AS phi, {r6('ll')} AS loglik, {r6('6 - 2 * ll')} AS aic, CAST(n AS BIGINT) AS nobs FROM r""".format(
    *[_ar1_sql(a) for a in ("a1", "a2", "a")]))
def ts_ar1_ml(spark, d):
    """T6 with one coefficient, whose likelihood has a closed form."""
    fits = ML.arima_ml(daily(spark, d), KEYS, "y", (1, 0, 0))
    phi = fits.coefficients().where("term = 'ar.L1'").select(*KEYS, F.round("estimate", 3).alias("phi"))
    return fits.models().select(*KEYS, "loglik", "aic", "nobs").join(phi, KEYS)


@register("ts_history_forecast")
def ts_history_forecast(spark, d):
    p = daily(spark, d)
    _, fc = AR.arima(p, KEYS, "y", (1, 1, 0), 7)
    hist = p.select(*KEYS, F.col(POS).alias("step"), F.col("y").alias("value"), F.lit("history").alias("kind"))
    last = p.groupBy(*KEYS).agg(F.max(POS).alias("_last"))
    fut = fc.join(last, KEYS).select(*KEYS, (F.col("_last") + F.col("step")).alias("step"),
                                     F.col("forecast").alias("value"), F.lit("forecast").alias("kind"))
    return hist.unionByName(fut)


@register("ts_lag_model")
def ts_lag_model(spark, d):
    from tidewater.suite.windows_q import events_positioned
    return AR.lag_model(events_positioned(spark, d), ["user_id"], "value", 10, 0.8)


@register("ts_fourier_forecast")
def ts_fourier_forecast(spark, d):
    s = TS.daily_series(table(spark, d, "events"), KEYS, "ts", None, "count")
    return _out(FC.fourier_forecast(s, KEYS, "day", "y", 14))


@register("ts_changepoint_forecast")
def ts_changepoint_forecast(spark, d):
    """T15 with a trend that bends: daily counts per type, two weeks ahead."""
    s = TS.daily_series(table(spark, d, "events"), KEYS, "ts", None, "count")
    return _out(CP.piecewise_forecast(s, KEYS, "day", "y", 14, knots=10)[0])


@register("ts_anomaly_iforest")
def ts_anomaly_iforest(spark, d):
    ev = table(spark, d, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"))
    out = IF.isolation_forest(ev, ["value", "hour"], "event_id", n_trees=50, contamination=0.05)
    return out.select("event_id", "anomaly_score", "is_anomaly")


@register("ts_dirty_series", with_dirty(f"""
SELECT event_id, {r6('CASE WHEN hi = lo THEN 0.0 ELSE (v - lo) / (hi - lo) END')} AS prepared FROM (
  SELECT event_id, v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (
    SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
    FROM dirty))"""))
def ts_dirty_series(spark, d):
    """Series preparation on the dirty view with forward fill (row counts only)."""
    from tidewater.suite.windows_q import dirty_positioned
    return TS.prepare(dirty_positioned(spark, d), [], "value", "ffill", True).select("event_id", "prepared")



