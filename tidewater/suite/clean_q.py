"""Cleaning queries (C1-C12, U1) on the dirty view and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import LINEITEM_NUMERIC, q, r6, union_all, with_dirty


def _ts_str(df):
    return df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")) if "ts" in df.columns else df


TS_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"

# statistics of the dirty view that the missing-value steps use
_STATS = """st AS (
  SELECT avg(value) AS mean_value, avg(value_sq) AS mean_sq, avg(pos_n) AS mean_pos,
    quantile_cont(value_sq, 0.5) AS med_sq, quantile_cont(pos_n, 0.5) AS med_pos,
    skewness(value_sq) AS skew_sq, skewness(pos_n) AS skew_pos,
    avg(value_sparse) AS mean_sparse, quantile_cont(value, 0.5) AS med_value,
    quantile_cont(value_sparse, 0.5) AS med_sparse, avg(event_id) AS mean_id, avg(user_id) AS mean_user,
    quantile_cont(event_id, 0.5) AS med_id, quantile_cont(user_id, 0.5) AS med_user FROM dirty),
md AS (SELECT event_type AS mode_type FROM dirty WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""

_MISSING_AUTO = f"""SELECT event_id, ts, user_id, coalesce(event_type, mode_type) AS event_type,
  coalesce(value, mean_value) AS value,
  coalesce(value_sq, CASE WHEN abs(skew_sq) > 1 THEN med_sq ELSE mean_sq END) AS value_sq,
  coalesce(pos_n, CASE WHEN abs(skew_pos) > 1 THEN med_pos ELSE mean_pos END) AS pos_n
FROM dirty, st, md"""


def _out_cols(cols_double):
    return ", ".join(f"{r6(c)} AS {c}" for c in cols_double)


@register("clean_missing_auto", with_dirty(f"""
SELECT event_id, {TS_SQL}, user_id, event_type, {_out_cols(['value', 'value_sq', 'pos_n'])} FROM ({_MISSING_AUTO})""",
                                           _STATS))
def clean_missing_auto(spark, d):
    return _ts_str(C.handle_missing(dirty(spark, d), "auto", "processor"))


@register("impute_stats", with_dirty(f"""
SELECT 'event_type' AS {q('column')}, 'mode' AS method, mode_type AS fill_value FROM md
UNION ALL SELECT 'value', 'mean', CAST({r6('mean_value')} AS VARCHAR) FROM st
UNION ALL SELECT 'value_sq', CASE WHEN abs(skew_sq) > 1 THEN 'median' ELSE 'mean' END,
  CAST({r6('CASE WHEN abs(skew_sq) > 1 THEN med_sq ELSE mean_sq END')} AS VARCHAR) FROM st
UNION ALL SELECT 'pos_n', CASE WHEN abs(skew_pos) > 1 THEN 'median' ELSE 'mean' END,
  CAST({r6('CASE WHEN abs(skew_pos) > 1 THEN med_pos ELSE mean_pos END')} AS VARCHAR) FROM st""", _STATS))
def impute_stats(spark, d):
    """The statistic chosen for each column with 0 < nulls <= 50 %, and its value."""
    _, _, how, values = C.missing_plan(dirty(spark, d), "auto", "processor")
    rows = [(c, how[c], v if isinstance(v, str) else repr(round(float(v), 6) + 0.0)) for c, v in values.items()]
    return spark.createDataFrame(rows, "column string, method string, fill_value string")


@register("clean_missing_staged", with_dirty(f"""
SELECT event_id, {TS_SQL}, user_id, coalesce(event_type, mode_type) AS event_type,
  {r6('coalesce(value, mean_value)')} AS value, {r6('coalesce(value_sq, med_sq)')} AS value_sq,
  {r6('coalesce(pos_n, med_pos)')} AS pos_n FROM dirty, st, md""", _STATS))
def clean_missing_staged(spark, d):
    return _ts_str(C.handle_missing(dirty(spark, d), "auto", "staged"))


_NUMS = ["value", "value_sq", "pos_n", "value_sparse"]


@register("fill_mean", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('coalesce(value, mean_value)')} AS value, {r6('coalesce(value_sq, mean_sq)')} AS value_sq,
  {r6('coalesce(pos_n, mean_pos)')} AS pos_n, {r6('coalesce(value_sparse, mean_sparse)')} AS value_sparse FROM dirty, st""", _STATS))
def fill_mean(spark, d):
    return C.fill_table(dirty(spark, d).drop("ts"), "mean")


@register("fill_median", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('coalesce(value, med_value)')} AS value, {r6('coalesce(value_sq, med_sq)')} AS value_sq,
  {r6('coalesce(pos_n, med_pos)')} AS pos_n, {r6('coalesce(value_sparse, med_sparse)')} AS value_sparse FROM dirty, st""", _STATS))
def fill_median(spark, d):
    return C.fill_table(dirty(spark, d).drop("ts"), "median")


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM dirty WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register("fill_mode", with_dirty(f"""
SELECT event_id, user_id, coalesce(event_type, {_mode_sql('event_type')}) AS event_type,
  {', '.join(f"{r6(f'coalesce({c}, {_mode_sql(c)})')} AS {c}" for c in _NUMS)} FROM dirty"""))
def fill_mode(spark, d):
    return C.fill_table(dirty(spark, d).drop("ts"), "mode")


@register("set_distinct", with_dirty(f"""
SELECT DISTINCT event_id, {TS_SQL}, user_id, event_type, {_out_cols(_NUMS)} FROM dirty"""))
def set_distinct(spark, d):
    return _ts_str(C.drop_duplicates(dirty(spark, d)))


def _bounds_sql(tbl: str, cols, k=1.5) -> str:
    return ", ".join(
        f"quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in cols) + f" FROM {tbl}"


def _clip_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c}) END"


@register("cap_iqr", f"""
SELECT {', '.join(f'{r6(_clip_sql(c))} AS {c}' for c in LINEITEM_NUMERIC)}, l_returnflag, l_linestatus
FROM lineitem, (SELECT {_bounds_sql('lineitem', LINEITEM_NUMERIC)}) b""")
def cap_iqr(spark, d):
    return C.cap_outliers(table(spark, d, "lineitem"), method="iqr").drop("l_shipdate")


@register("cap_iqr_dirty", with_dirty(f"""
SELECT {', '.join(f'{r6(_clip_sql(c))} AS {c}' for c in ['value', 'value_sq'])}, event_id
FROM dirty, (SELECT {_bounds_sql('dirty', ['value', 'value_sq'])}) b"""))
def cap_iqr_dirty(spark, d):
    return C.cap_outliers(dirty(spark, d).select("value", "value_sq", "event_id"), ["value", "value_sq"], "iqr")


@register("cap_zscore", with_dirty(f"""
SELECT event_id, {', '.join(f'{r6(_clip_sql(c))} AS {c}' for c in ['value', 'value_sq'])}
FROM dirty, (SELECT {', '.join(f'avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}' for c in ['value', 'value_sq'])} FROM dirty) b"""))
def cap_zscore(spark, d):
    return C.cap_outliers(dirty(spark, d).select("event_id", "value", "value_sq"), ["value", "value_sq"], "zscore")


_RM_COLS = ["value_sq", "value", "value_sparse"]


def _remove_sql() -> str:
    ctes, prev = [], "dirty"
    for i, c in enumerate(_RM_COLS):
        ctes.append(f"""r{i} AS (SELECT d.* FROM {prev} d, (SELECT {_bounds_sql(prev, [c])}) b
  WHERE NOT coalesce(d.{c} < b.lo_{c} OR d.{c} > b.hi_{c}, false))""")
        prev = f"r{i}"
    return with_dirty(f"SELECT event_id, user_id, event_type, {_out_cols(['value', 'value_sq', 'value_sparse'])} FROM {prev}",
                      ",\n".join(ctes))


@register("remove_outliers", _remove_sql())
def remove_outliers(spark, d):
    df = dirty(spark, d).select("event_id", "user_id", "event_type", "value", "value_sq", "value_sparse")
    return C.remove_outliers(df, _RM_COLS)


@register("clean_text_cols", """
SELECT c_custkey, CASE WHEN c_name IS NULL THEN NULL ELSE trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) END AS c_name,
  CASE WHEN c_mktsegment IS NULL THEN NULL ELSE trim(regexp_replace(lower(c_mktsegment), '\\s+', ' ', 'g')) END AS c_mktsegment
FROM customer""")
def clean_text_cols(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return C.clean_text_columns(cu)


_CHAIN_NUM = ["event_id", "user_id", "value", "value_sq", "pos_n"]


@register("clean_chain", with_dirty(f"""
SELECT {', '.join(f'{r6(_clip_sql(c))} AS {c}' for c in _CHAIN_NUM)}, {TS_SQL},
  trim(regexp_replace(lower(event_type), '\\s+', ' ', 'g')) AS event_type
FROM f, (SELECT {_bounds_sql('f', _CHAIN_NUM)}) b""", _STATS + f",\nf AS (SELECT DISTINCT * FROM ({_MISSING_AUTO}))"))
def clean_chain(spark, d):
    return _ts_str(C.clean_chain(dirty(spark, d)))


@register("preprocess_conservative", with_dirty(f"""
SELECT {', '.join(f'{r6(_clip_sql(c))} AS {c}' for c in _CHAIN_NUM)}, {TS_SQL}, event_type
FROM f, (SELECT {_bounds_sql('f', _CHAIN_NUM)}) b""", _STATS + """,
f AS (SELECT DISTINCT event_id, ts, user_id, coalesce(event_type, mode_type) AS event_type,
  coalesce(value, mean_value) AS value, coalesce(value_sq, med_sq) AS value_sq, coalesce(pos_n, med_pos) AS pos_n
  FROM dirty, st, md)"""))
def preprocess_conservative(spark, d):
    return _ts_str(C.preprocess(dirty(spark, d), "conservative"))


def _aggr_sql() -> str:
    ctes = [_STATS.strip(), """f AS (SELECT DISTINCT event_id, ts, user_id, coalesce(event_type, mode_type) AS event_type,
  coalesce(value, mean_value) AS value, coalesce(value_sq, med_sq) AS value_sq, coalesce(pos_n, med_pos) AS pos_n
  FROM dirty, st, md)"""]
    prev = "f"
    for i, c in enumerate(_CHAIN_NUM):
        ctes.append(f"""a{i} AS (SELECT d.* FROM {prev} d, (SELECT {_bounds_sql(prev, [c])}) b
  WHERE NOT coalesce(d.{c} < b.lo_{c} OR d.{c} > b.hi_{c}, false))""")
        prev = f"a{i}"
    return with_dirty(f"SELECT {_out_cols(['value', 'value_sq', 'pos_n'])}, event_id, user_id, event_type, {TS_SQL} FROM {prev}",
                      ",\n".join(ctes))


@register("preprocess_aggressive", _aggr_sql())
def preprocess_aggressive(spark, d):
    return _ts_str(C.preprocess(dirty(spark, d), "aggressive"))


@register("clean_log", with_dirty(f"""
SELECT 'missing' AS step, 'event_type' AS {q('column')}, 'mode' AS action, CAST(count(*) - count(event_type) AS BIGINT) AS affected FROM dirty
UNION ALL SELECT 'missing', 'value', 'mean', count(*) - count(value) FROM dirty
UNION ALL SELECT 'missing', 'value_sq', CASE WHEN abs(skewness(value_sq)) > 1 THEN 'median' ELSE 'mean' END, count(*) - count(value_sq) FROM dirty
UNION ALL SELECT 'missing', 'pos_n', CASE WHEN abs(skewness(pos_n)) > 1 THEN 'median' ELSE 'mean' END, count(*) - count(pos_n) FROM dirty
UNION ALL SELECT 'missing', 'value_sparse', 'drop_column', count(*) - count(value_sparse) FROM dirty
UNION ALL SELECT 'duplicates', NULL, 'drop', (SELECT count(*) FROM ({_MISSING_AUTO})) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_MISSING_AUTO})))
UNION ALL {union_all([f"SELECT 'outliers', '{c}', 'cap_iqr', count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) FROM f, (SELECT {_bounds_sql('f', [c])}) b" for c in _CHAIN_NUM])}""",
                                  _STATS + f",\nf AS (SELECT DISTINCT * FROM ({_MISSING_AUTO}))"))
def clean_log(spark, d):
    log = C.CleanLog()
    C.clean_chain(dirty(spark, d), log=log)
    return log.to_df(spark).drop("seq")
