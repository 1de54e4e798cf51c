"""Profiling / quality / EDA queries (A1-A20, A31-A34, A40-A43) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import profile as P
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import (DIRTY_COLS, DIRTY_NUMERIC, LINEITEM_NUMERIC, q, r6,
                                    union_all, with_dirty)

DIRTY_ALL = ", ".join(c for c, _ in DIRTY_COLS)
ORDERS_TEXT = ["o_orderstatus", "o_orderpriority"]


# --- A1 ----------------------------------------------------------------------
@register("profile_basic", with_dirty(f"""
, g AS (SELECT count(*) AS copies FROM dirty GROUP BY {DIRTY_ALL})
SELECT CAST(sum(copies) AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_cols,
       CAST(count(*) AS BIGINT) AS n_distinct, CAST(sum(copies) - count(*) AS BIGINT) AS n_duplicates,
       {r6('100.0 * (sum(copies) - count(*)) / sum(copies)')} AS duplicate_pct
FROM g""").replace("\n, g AS", ",\ng AS", 1))
def profile_basic(spark, d):
    return P.basic_summary(dirty(spark, d))


# --- A2 ----------------------------------------------------------------------
def _profile_columns_sql() -> str:
    parts = [f"""SELECT '{c}' AS {q('column')}, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null,
  CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
  {r6(f'100.0 * (count(*) - count({c})) / count(*)')} AS null_pct FROM dirty""" for c, t in DIRTY_COLS]
    return with_dirty(union_all(parts))


@register("profile_columns", _profile_columns_sql())
def profile_columns(spark, d):
    return P.column_profile(dirty(spark, d))


# --- A3 ----------------------------------------------------------------------
def _describe_sql(tbl: str, cols) -> str:
    parts = [f"""SELECT '{c}' AS {q('column')}, CAST(count({c}) AS BIGINT) AS count, {r6(f'avg({c})')} AS mean,
  {r6(f'stddev_samp({c})')} AS std, {r6(f'min({c})')} AS min,
  {r6(f'quantile_cont({c}, 0.25)')} AS q25, {r6(f'quantile_cont({c}, 0.5)')} AS q50,
  {r6(f'quantile_cont({c}, 0.75)')} AS q75, {r6(f'max({c})')} AS max FROM {tbl}""" for c in cols]
    return union_all(parts)


@register("describe_numeric", _describe_sql("lineitem", LINEITEM_NUMERIC))
def describe_numeric(spark, d):
    return P.describe_numeric(table(spark, d, "lineitem"))


# --- A4 ----------------------------------------------------------------------
def _describe_cat_sql(tbl: str, cols) -> str:
    parts = [f"""SELECT * FROM (SELECT '{c}' AS {q('column')},
  (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM {tbl}) AS n_distinct,
  CAST({c} AS VARCHAR) AS top, CAST(count(*) AS BIGINT) AS freq
  FROM {tbl} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY freq DESC, top ASC LIMIT 1)""" for c in cols]
    return union_all(parts)


@register("describe_categorical", _describe_cat_sql("orders", ORDERS_TEXT))
def describe_categorical(spark, d):
    return P.describe_categorical(table(spark, d, "orders"), ORDERS_TEXT)


# --- A5 / A6 / A7 / A8 ---------------------------------------------------------
def _missing_sql() -> str:
    return union_all([f"""SELECT '{c}' AS {q('column')}, CAST(count(*) - count({c}) AS BIGINT) AS missing,
  {r6(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct FROM dirty""" for c, _ in DIRTY_COLS])


@register("missing_summary", with_dirty(_missing_sql()))
def missing_summary(spark, d):
    return P.missing_summary(dirty(spark, d))


@register("missing_tiers", with_dirty(f"""
SELECT {q('column')}, missing, missing_pct,
  CASE WHEN missing_pct > 50 THEN 'high' WHEN missing_pct > 10 THEN 'medium' ELSE 'low' END AS tier
FROM ({_missing_sql()}) m WHERE missing > 0"""))
def missing_tiers(spark, d):
    return P.missing_tiers(dirty(spark, d))


_NULLS_SUM = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c, _ in DIRTY_COLS)


@register("missing_cells_pct", with_dirty(f"""
SELECT CAST(count(*) * 8 AS BIGINT) AS total_cells, CAST(sum({_NULLS_SUM}) AS BIGINT) AS missing_cells,
  {r6(f'100.0 * sum({_NULLS_SUM}) / (count(*) * 8)')} AS missing_pct FROM dirty"""))
def missing_cells_pct(spark, d):
    return P.missing_cells(dirty(spark, d))


@register("duplicate_groups", with_dirty(f"""
SELECT CAST(sum(copies) AS BIGINT) AS n_rows, CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows,
  {r6('100.0 * sum(copies - 1) / sum(copies)')} AS duplicate_pct,
  CAST(count(*) FILTER (WHERE copies > 1) AS BIGINT) AS duplicate_groups,
  CAST(max(copies) AS BIGINT) AS max_copies
FROM (SELECT count(*) AS copies FROM dirty GROUP BY {DIRTY_ALL}) g"""))
def duplicate_groups(spark, d):
    return P.duplicate_summary(dirty(spark, d))


# --- A9 / A10 ------------------------------------------------------------------
def _outlier_sql(tbl: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS {q('column')}, n, q1, q3, lower, upper, n_outliers, outlier_pct FROM (
  SELECT CAST(count({c}) AS BIGINT) AS n, {r6('b.q1')} AS q1, {r6('b.q3')} AS q3,
    {r6('b.q1 - 1.5 * (b.q3 - b.q1)')} AS lower, {r6('b.q3 + 1.5 * (b.q3 - b.q1)')} AS upper,
    CAST(count(*) FILTER (WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS BIGINT) AS n_outliers,
    {r6(f'100.0 * count(*) FILTER (WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) / count({c})')} AS outlier_pct
  FROM {tbl}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tbl}) b
  GROUP BY b.q1, b.q3) WHERE n >= 10 AND n_outliers > 0""")
    return union_all(parts)


@register("outlier_report", _outlier_sql("lineitem", LINEITEM_NUMERIC))
def outlier_report(spark, d):
    return P.outlier_report(table(spark, d, "lineitem"))


OUTLIER_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("outlier_rows", union_all([f"""
SELECT l_orderkey, l_linenumber, '{c}' AS {q('column')}, {r6(c)} AS value
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem) b
WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)""" for c in OUTLIER_COLS]))
def outlier_rows(spark, d):
    return P.outlier_rows(table(spark, d, "lineitem"), OUTLIER_COLS, ["l_orderkey", "l_linenumber"])


# --- A11-A14 -------------------------------------------------------------------
_QI = f""", qi AS (
  SELECT sum(copies) AS n_rows, sum(copies * row_nulls) AS missing_cells, sum(copies - 1) AS duplicate_rows
  FROM (SELECT count(*) AS copies, first({_NULLS_SUM}) AS row_nulls FROM dirty GROUP BY {DIRTY_ALL}) g)"""


def _with_qi(body: str) -> str:
    return with_dirty(body, _QI.lstrip(", "))


@register("quality_product", _with_qi(f"""
SELECT {r6('missing_cells / (n_rows * 8.0)')} AS missing_ratio, {r6('duplicate_rows / n_rows')} AS duplicate_ratio,
  {r6('ROUND((1 - missing_cells / (n_rows * 8.0)) * (1 - duplicate_rows / n_rows), 3)')} AS quality_score FROM qi"""))
def quality_product(spark, d):
    return P.quality_product(dirty(spark, d))


@register("quality_weighted", _with_qi(f"""
SELECT {r6('missing_cells / (n_rows * 8.0)')} AS missing_ratio, {r6('duplicate_rows / n_rows')} AS duplicate_ratio,
  {r6('7 / 8.0')} AS typed_share,
  {r6('greatest(0.0, least(100.0, 100.0 - 30.0 * missing_cells / (n_rows * 8.0) - 20.0 * duplicate_rows / n_rows + 10.0 * 7 / 8.0))')} AS quality_score
FROM qi"""))
def quality_weighted(spark, d):
    return P.quality_weighted(dirty(spark, d))


def _dirty_outlier_cols_sql() -> str:
    parts = [f"""SELECT '{c}' AS c FROM (SELECT count({c}) AS n,
  count(*) FILTER (WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS k
  FROM dirty, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty) b GROUP BY b.q1, b.q3)
  WHERE n >= 10 AND k > 0""" for c in DIRTY_NUMERIC]
    return union_all(parts)


def _dirty_type_issue_cols_sql() -> str:
    parts = [f"""SELECT '{c}' AS c FROM dirty HAVING count(DISTINCT {c}) / count(*) < 0.05 AND count(DISTINCT {c}) > 2"""
             for c in DIRTY_NUMERIC]
    parts.append("""SELECT 'event_type' AS c FROM dirty
  HAVING count(TRY_CAST(event_type AS DOUBLE)) > 0 AND count(TRY_CAST(event_type AS DOUBLE)) < count(event_type)""")
    return union_all(parts)


@register("quality_penalty", _with_qi(f"""
SELECT {r6('least(30.0, 100.0 * missing_cells / (n_rows * 8.0))')} AS missing_penalty,
  {r6('least(20.0, 100.0 * duplicate_rows / n_rows)')} AS duplicate_penalty,
  CAST(ti.k AS BIGINT) AS type_issue_columns, CAST(oc.k AS BIGINT) AS outlier_columns,
  {r6('greatest(0.0, ROUND(100.0 - least(30.0, 100.0 * missing_cells / (n_rows * 8.0)) - least(20.0, 100.0 * duplicate_rows / n_rows) - least(15.0, ti.k * 3.0) - least(10.0, oc.k * 2.0), 2))')} AS quality_score
FROM qi, (SELECT count(*) AS k FROM ({_dirty_type_issue_cols_sql()})) ti,
  (SELECT count(*) AS k FROM ({_dirty_outlier_cols_sql()})) oc"""))
def quality_penalty(spark, d):
    return P.quality_penalty(dirty(spark, d))


@register("quality_gauge", _with_qi(f"""
SELECT {r6('g')} AS gauge, CASE WHEN g >= 90 THEN 'excellent' WHEN g >= 80 THEN 'good' WHEN g >= 50 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT ROUND((1 - missing_cells / (n_rows * 8.0)) * (1 - duplicate_rows / n_rows), 3) * 100 AS g FROM qi)"""))
def quality_gauge(spark, d):
    return P.quality_gauge(dirty(spark, d))


# --- A15 / A16 / A17 / A18 -------------------------------------------------------
def _corr_sql(tbl: str, cols) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r6(f'corr({a}, {b})')} AS corr FROM {tbl}"
             for a in cols for b in cols]
    return union_all(parts)


@register("corr_matrix", _corr_sql("lineitem", LINEITEM_NUMERIC))
def corr_matrix(spark, d):
    return P.corr_matrix(table(spark, d, "lineitem"))


@register("corr_strong", f"SELECT * FROM ({union_all([f'SELECT {chr(39)}{a}{chr(39)} AS col_a, {chr(39)}{b}{chr(39)} AS col_b, {r6(f"corr({a}, {b})")} AS corr FROM lineitem' for i, a in enumerate(LINEITEM_NUMERIC) for b in LINEITEM_NUMERIC[i + 1:]])}) WHERE abs(corr) > 0.7")
def corr_strong(spark, d):
    return P.strong_correlations(table(spark, d, "lineitem"))


def _shape_sql(tbl: str, cols, cte=None) -> str:
    parts = [f"""SELECT '{c}' AS {q('column')}, skewness({c}) AS skew, kurtosis({c}) AS kurt FROM {tbl}
  HAVING count({c}) > 0""" for c in cols]
    body = f"""SELECT {q('column')}, {r6('skew')} AS skew, {r6('kurt')} AS kurt,
  (abs(skew) < 0.5 AND abs(kurt) < 0.5) AS is_normal,
  CASE WHEN abs(skew) < 0.5 AND abs(kurt) < 0.5 THEN 'normal' WHEN skew > 1 THEN 'right_skewed'
       WHEN skew < -1 THEN 'left_skewed' WHEN kurt > 1 THEN 'heavy_tailed' WHEN kurt < -1 THEN 'light_tailed'
       ELSE 'unknown' END AS distribution
FROM ({union_all(parts)}) s"""
    return with_dirty(body) if cte == "dirty" else body


@register("distribution_shape", _shape_sql("lineitem", LINEITEM_NUMERIC))
def distribution_shape(spark, d):
    return P.distribution_shape(table(spark, d, "lineitem"))


@register("distribution_class", _shape_sql("dirty", DIRTY_NUMERIC, cte="dirty"))
def distribution_class(spark, d):
    return P.distribution_shape(dirty(spark, d), DIRTY_NUMERIC)


# --- A19 / A20 -------------------------------------------------------------------
_FA_NULLS = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"


@register("feature_analysis", union_all(
    [f"""SELECT '{c}' AS {q('column')}, 'numeric' AS kind, {r6(f'min({c})')} AS min, {r6(f'max({c})')} AS max,
  {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, CAST(NULL AS BIGINT) AS range_days,
  CAST(NULL AS VARCHAR) AS most_common, CAST(NULL AS BIGINT) AS most_common_count, CAST(NULL AS DOUBLE) AS avg_length
  FROM orders""" for c in ["o_orderkey", "o_custkey", "o_totalprice"]]
    + [f"""SELECT 'o_orderdate', 'datetime', {_FA_NULLS},
  CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400e6) AS BIGINT), NULL, NULL, NULL FROM orders"""]
    + [f"""SELECT '{c}', 'text', {_FA_NULLS}, NULL, top, freq, avg_length FROM
  (SELECT {c} AS top, CAST(count(*) AS BIGINT) AS freq FROM orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  (SELECT {r6(f"avg(length(coalesce({c}, 'nan')))")} AS avg_length FROM orders)""" for c in ORDERS_TEXT]))
def feature_analysis(spark, d):
    return P.feature_analysis(table(spark, d, "orders"))


@register("value_counts", """
SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count DESC, value LIMIT 10""")
def value_counts(spark, d):
    return P.value_counts(table(spark, d, "orders"), "o_orderpriority")


# --- A31 / A32 / A34 ---------------------------------------------------------------
@register("drift_mean", with_dirty(union_all([f"""
SELECT '{c}' AS {q('column')}, {r6('b')} AS mean_before, {r6('a')} AS mean_after,
  {r6('abs(a - b) / abs(b)')} AS relative_change, abs(a - b) / abs(b) > 0.1 AS drift
FROM (SELECT avg({c}) AS b FROM dirty), (SELECT avg({c}) AS a FROM events)""" for c in ["event_id", "user_id", "value"]])))
def drift_mean(spark, d):
    return P.drift_mean(dirty(spark, d), table(spark, d, "events"))


@register("before_after", with_dirty("""
SELECT 'rows_before' AS metric, CAST(count(*) AS BIGINT) AS value FROM dirty
UNION ALL SELECT 'rows_after', CAST(count(*) AS BIGINT) FROM events
UNION ALL SELECT 'cols_before', 8 UNION ALL SELECT 'cols_after', 6
UNION ALL SELECT 'cols_added', 1 UNION ALL SELECT 'cols_removed', 3"""))
def before_after(spark, d):
    return P.before_after(dirty(spark, d), table(spark, d, "events"))


@register("series_stats", f"""
SELECT CAST(count(value) AS BIGINT) AS n, {r6('avg(value)')} AS mean, {r6('quantile_cont(value, 0.5)')} AS median,
  {r6('stddev_samp(value)')} AS std, {r6('var_samp(value)')} AS var, {r6('skewness(value)')} AS skew,
  {r6('kurtosis(value)')} AS kurt, {r6('max(value) - min(value)')} AS range,
  {r6('stddev_samp(value) / avg(value)')} AS cv FROM events""")
def series_stats(spark, d):
    return P.series_stats(table(spark, d, "events"), "value")


@register("series_stats_by_type", f"""
SELECT event_type, CAST(count(value) AS BIGINT) AS n, {r6('avg(value)')} AS mean, {r6('quantile_cont(value, 0.5)')} AS median,
  {r6('stddev_samp(value)')} AS std, {r6('var_samp(value)')} AS var, {r6('skewness(value)')} AS skew,
  {r6('kurtosis(value)')} AS kurt, {r6('max(value) - min(value)')} AS range,
  {r6('stddev_samp(value) / avg(value)')} AS cv FROM events GROUP BY event_type""")
def series_stats_by_type(spark, d):
    return P.series_stats(table(spark, d, "events"), "value", by=["event_type"])


# --- A33 / A40-A43 ------------------------------------------------------------------
def _rec_sql() -> str:
    miss = _missing_sql()
    num = DIRTY_NUMERIC
    skew_parts = union_all([f"SELECT '{c}' AS c, skewness({c}) AS sk FROM dirty" for c in num])
    corr_parts = union_all([f"SELECT '{a}|{b}' AS c, corr({a}, {b}) AS r FROM dirty" for i, a in enumerate(num) for b in num[i + 1:]])
    return with_dirty(f"""
SELECT * FROM (SELECT 'missing' AS category, CAST(NULL AS VARCHAR) AS {q('column')}, 'handle_missing' AS action
  FROM ({miss}) WHERE missing > 0 LIMIT 1)
UNION ALL SELECT 'missing', {q('column')}, 'drop_column' FROM ({miss}) WHERE missing > 0 AND missing_pct > 50
UNION ALL SELECT 'missing', {q('column')}, 'impute' FROM ({miss}) WHERE missing > 0 AND missing_pct > 20 AND missing_pct <= 50
UNION ALL SELECT 'duplicates', NULL, 'remove_duplicates' FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS d FROM dirty) WHERE d > 0
UNION ALL SELECT * FROM (SELECT 'types', NULL, 'standardize_types' FROM ({_dirty_type_issue_cols_sql()}) LIMIT 1)
UNION ALL SELECT 'outliers', c, 'handle_outliers' FROM ({_dirty_outlier_cols_sql()})
UNION ALL SELECT 'cardinality', 'event_type', 'reduce_cardinality' FROM dirty HAVING count(DISTINCT event_type) > 100
UNION ALL SELECT 'skew', c, 'transform_skewed' FROM ({skew_parts}) WHERE abs(sk) > 2
UNION ALL SELECT 'correlation', c, 'drop_collinear' FROM ({corr_parts}) WHERE abs(r) > 0.9""")


@register("recommendations", _rec_sql())
def recommendations(spark, d):
    return P.recommendations(dirty(spark, d).drop("ts"))


@register("data_context", f"""
SELECT 'shape' AS section, CAST(NULL AS VARCHAR) AS {q('column')}, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'shape', NULL, 'columns', 11.0
UNION ALL {union_all([f"SELECT 'nulls', '{c}', 'missing', CAST(count(*) - count({c}) AS DOUBLE) FROM lineitem" for c in LINEITEM_NUMERIC + ['l_returnflag', 'l_linestatus', 'l_shipdate']])}
UNION ALL {union_all([f"SELECT 'stats', '{c}', '{m}', {r6(f'{m}({c})'.replace('mean(', 'avg(').replace('std(', 'stddev_samp('))} FROM lineitem" for c in LINEITEM_NUMERIC for m in ('mean', 'std', 'min', 'max')])}""")
def data_context(spark, d):
    return P.data_context(table(spark, d, "lineitem"))


_DR_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
             ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("data_report", "SELECT * FROM (VALUES " + ", ".join(f"('types', '{c}', '{t}', 1.0)" for c, t in _DR_TYPES)
          + ") t(section, name, metric, value) WHERE (SELECT count(*) FROM lineitem) >= 0\nUNION ALL "
          + union_all([f"SELECT 'missing', '{c}', 'missing', CAST(count(*) - count({c}) AS DOUBLE) FROM lineitem" for c, _ in _DR_TYPES])
          + "\nUNION ALL SELECT section, name, metric, value FROM ("
          + union_all([f"""SELECT 'describe' AS section, '{c}' AS name, unnest(['count', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS metric,
  unnest([CAST(count({c}) AS DOUBLE), {r6(f'avg({c})')}, {r6(f'stddev_samp({c})')}, {r6(f'min({c})')}, {r6(f'quantile_cont({c}, 0.25)')},
          {r6(f'quantile_cont({c}, 0.5)')}, {r6(f'quantile_cont({c}, 0.75)')}, {r6(f'max({c})')}]) AS value FROM lineitem""" for c in LINEITEM_NUMERIC]) + ")")
def data_report(spark, d):
    return P.data_report(table(spark, d, "lineitem"))


@register("key_insights", with_dirty(f"""
SELECT CAST((SELECT count(*) FROM dirty) AS BIGINT) AS n_rows, CAST(8 AS BIGINT) AS n_cols,
  {r6(f'(SELECT avg(missing_pct) FROM ({_missing_sql()}))')} AS avg_missing_pct,
  CAST((SELECT count(*) FROM ({union_all([f"SELECT corr({a}, {b}) AS r FROM dirty" for i, a in enumerate(DIRTY_NUMERIC) for b in DIRTY_NUMERIC[i + 1:]])}) WHERE abs(r) > 0.7) AS BIGINT) AS strong_correlations"""))
def key_insights(spark, d):
    return P.key_insights(dirty(spark, d))


@register("eda_summary", with_dirty(f"""
SELECT 'basic' AS section, CAST(NULL AS VARCHAR) AS {q('column')}, 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM dirty
UNION ALL SELECT 'basic', NULL, 'n_cols', 8.0
UNION ALL SELECT 'basic', NULL, 'n_duplicates', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS DOUBLE) FROM dirty
UNION ALL SELECT 'missing', {q('column')}, 'missing_pct', missing_pct FROM ({_missing_sql()})
UNION ALL {union_all([f"SELECT 'distribution', '{c}', 'skew', {r6(f'skewness({c})')} FROM dirty UNION ALL SELECT 'distribution', '{c}', 'kurt', {r6(f'kurtosis({c})')} FROM dirty" for c in DIRTY_NUMERIC])}
UNION ALL {union_all([f"SELECT 'describe', '{c}', 'mean', {r6(f'avg({c})')} FROM dirty UNION ALL SELECT 'describe', '{c}', 'std', {r6(f'stddev_samp({c})')} FROM dirty UNION ALL SELECT 'describe', '{c}', 'q50', {r6(f'quantile_cont({c}, 0.5)')} FROM dirty" for c in DIRTY_NUMERIC])}"""))
def eda_summary(spark, d):
    return P.eda_summary(dirty(spark, d))


_SAMPLE_COLS = ["value", "value_sq", "value_sparse"]


@register("outlier_samples", with_dirty(union_all([f"""
SELECT '{c}' AS {q('column')}, {r6(c)} AS value, CAST(rank AS INT) AS rank FROM (
  SELECT {c}, row_number() OVER (ORDER BY event_id) AS rank
  FROM dirty, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty) b
  WHERE {c} < b.q1 - 1.5 * (b.q3 - b.q1) OR {c} > b.q3 + 1.5 * (b.q3 - b.q1)) WHERE rank <= 10""" for c in _SAMPLE_COLS])))
def outlier_samples(spark, d):
    out = P.outlier_samples(dirty(spark, d), _SAMPLE_COLS, ["event_id"], 10)
    return out.select("column", "value", F.col("rank").cast("int"))


@register("profile_columns_approx")
def profile_columns_approx(spark, d):
    """A2 with HyperLogLog++ distinct counts: one pass, no Expand of the input per
    distinct column - the variant for very wide tables at scale (rows-only check)."""
    return P.column_profile(dirty(spark, d), exact_distinct=False)


@register("describe_numeric_approx")
def describe_numeric_approx(spark, d):
    """A3 with percentile_approx quartiles (one pass; rank error <= n / 10000)."""
    return P.describe_numeric(table(spark, d, "lineitem"), method="approx")
