"""Projection / filter / schema-decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import schema as S
from tidewater.operators.profile import missing_summary
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import DIRTY_NUMERIC, q, r6, union_all, with_dirty

EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def events_as_strings(spark, d):
    ev = table(spark, d, "events")
    return ev.select(*[F.col(c).cast("string").alias(c) for c in EVENT_COLS])


_EV_STR = "ev AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in EVENT_COLS) + " FROM events)"


@register("proj_numeric", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
    r6(c) + f" AS {c}" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + " FROM lineitem")
def proj_numeric(spark, d):
    return S.select_numeric(table(spark, d, "lineitem"))


@register("proj_categorical", "SELECT l_returnflag, l_linestatus FROM lineitem")
def proj_categorical(spark, d):
    return S.select_categorical(table(spark, d, "lineitem"))


@register("proj_datetime", "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders")
def proj_datetime(spark, d):
    out = S.select_datetime(table(spark, d, "orders"))
    return out.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in out.columns])


def sidebar_filter(df, columns, max_rows: int, max_missing_pct: float, order_by):
    """Keep chosen columns whose missing % is within the threshold, first ``max_rows`` rows."""
    m = {r["column"]: r["missing_pct"] for r in missing_summary(df.select(*columns)).collect()}
    kept = [c for c in columns if m[c] <= max_missing_pct]
    return df.select(*kept).orderBy(*order_by).limit(max_rows)


@register("filter_sidebar", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('value')} AS value FROM dirty
ORDER BY event_id, user_id LIMIT 500"""))
def filter_sidebar(spark, d):
    df = dirty(spark, d)
    return sidebar_filter(df, ["event_id", "user_id", "event_type", "value", "value_sparse"],
                          500, 30.0, ["event_id", "user_id"])


@register("filter_dropna", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('value')} AS value, {r6('value_sq')} AS value_sq,
  {r6('pos_n')} AS pos_n, {r6('value_sparse')} AS value_sparse FROM dirty WHERE value IS NOT NULL"""))
def filter_dropna(spark, d):
    return dirty(spark, d).na.drop(subset=["value"]).drop("ts")


@register("filter_dropna_any", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('value')} AS value, {r6('value_sq')} AS value_sq,
  {r6('pos_n')} AS pos_n, {r6('value_sparse')} AS value_sparse FROM dirty
WHERE event_type IS NOT NULL AND value IS NOT NULL AND value_sq IS NOT NULL AND pos_n IS NOT NULL
  AND value_sparse IS NOT NULL"""))
def filter_dropna_any(spark, d):
    return dirty(spark, d).drop("ts").na.drop(how="any")


def drop_sparse_columns(df, threshold_pct: float = 50.0):
    """Decide (one aggregate) then drop columns with more than ``threshold_pct`` nulls."""
    m = missing_summary(df).collect()
    return df.drop(*[r["column"] for r in m if r["missing_pct"] > threshold_pct])


@register("drop_sparse_cols", with_dirty(f"""
SELECT event_id, user_id, event_type, {r6('value')} AS value, {r6('value_sq')} AS value_sq, {r6('pos_n')} AS pos_n
FROM dirty"""))
def drop_sparse_cols(spark, d):
    return drop_sparse_columns(dirty(spark, d)).drop("ts")


@register("filter_key_recent", f"""
SELECT o_orderkey, o_custkey, {r6('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate
FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC""")
def filter_key_recent(spark, d):
    o = table(spark, d, "orders")
    return (o.where(F.col("o_orderpriority") == "1-URGENT").orderBy(F.desc("o_orderdate"))
            .select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")))


@register("filter_public", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def filter_public(spark, d):
    lab = table(spark, d, "labels")
    return lab.where(~F.col("toxic").cast("boolean")).select("doc_id", "quality")


@register("validate_rows", "SELECT CAST(least(count(*), 50) AS BIGINT) AS rows_seen, CAST(11 AS BIGINT) AS n_cols, "
          "count(*) >= 50 AS valid FROM lineitem")
def validate_rows(spark, d):
    return S.validate_rows(table(spark, d, "lineitem"), min_rows=50)


_SEM = """CASE WHEN n = 0 THEN 'empty' WHEN n_bool = n THEN 'boolean' WHEN n_int = n THEN 'integer'
  WHEN n_num = n THEN 'float' WHEN n_ts = n THEN 'datetime' WHEN n_distinct / n < 0.5 THEN 'categorical'
  WHEN avg_len > 50 THEN 'text' ELSE 'mixed' END"""


def _parse_sql(cols) -> str:
    parts = [f"""SELECT '{c}' AS c, count(trim({c})) AS n,
  count(*) FILTER (WHERE lower(trim({c})) IN ('true', 'false')) AS n_bool,
  count(TRY_CAST(trim({c}) AS DOUBLE)) AS n_num,
  count(*) FILTER (WHERE TRY_CAST(trim({c}) AS DOUBLE) = floor(TRY_CAST(trim({c}) AS DOUBLE))) AS n_int,
  count(TRY_CAST(trim({c}) AS TIMESTAMP)) AS n_ts, count(DISTINCT trim({c})) AS n_distinct,
  avg(length(trim({c}))) AS avg_len FROM ev""" for c in cols]
    return union_all(parts)


@register("detect_types", f"""WITH {_EV_STR}
SELECT c AS {q('column')}, {_SEM} AS semantic_type FROM ({_parse_sql(EVENT_COLS)}) p""")
def detect_types(spark, d):
    return S.detect_types(events_as_strings(spark, d))


@register("standardize_types", f"""WITH {_EV_STR}
SELECT c AS {q('column')}, CASE WHEN n = 0 THEN 'string' WHEN n_int = n THEN 'bigint' WHEN n_num = n THEN 'double'
  WHEN n_ts = n THEN 'timestamp' ELSE 'string' END AS target_type FROM ({_parse_sql(EVENT_COLS)}) p""")
def standardize_types(spark, d):
    return S.type_decisions(events_as_strings(spark, d), EVENT_COLS)


@register("standardize_apply", f"""WITH {_EV_STR}
SELECT CAST(TRY_CAST(event_id AS DOUBLE) AS BIGINT) AS event_id, CAST(TRY_CAST(user_id AS DOUBLE) AS BIGINT) AS user_id,
  {r6('TRY_CAST(value AS DOUBLE)')} AS value, event_type FROM ev""")
def standardize_apply(spark, d):
    out = S.standardize_types(events_as_strings(spark, d))
    return out.select("event_id", "user_id", "value", "event_type")


_STRUCT_COLS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("pages", "url"), ("documents", "source")]


@register("is_structured", union_all([f"""
SELECT '{c}' AS {q('column')}, coalesce(bool_or(regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')), false) AS has_email,
  coalesce(bool_or(regexp_matches({c}, '^[0-9\\s\\-\\+\\(\\)]+$') AND length({c}) > 7), false) AS has_phone,
  coalesce(bool_or(regexp_matches({c}, '^[A-Z]{{2,4}}[0-9]{{4,8}}$')), false) AS has_code,
  coalesce(bool_or(regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')
    OR (regexp_matches({c}, '^[0-9\\s\\-\\+\\(\\)]+$') AND length({c}) > 7)
    OR regexp_matches({c}, '^[A-Z]{{2,4}}[0-9]{{4,8}}$')), false) AS is_structured FROM {t}""" for t, c in _STRUCT_COLS]))
def is_structured(spark, d):
    parts = [S.structured_flags(table(spark, d, t).select(c), [c]) for t, c in _STRUCT_COLS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("is_free_text", union_all([f"""
SELECT '{c}' AS {q('column')}, {r6(f'avg(length({c}))')} AS avg_len, {r6(f'count(DISTINCT {c}) / count({c})')} AS unique_ratio,
  avg(length({c})) > 20 AND count(DISTINCT {c}) / count({c}) > 0.5 AS is_text FROM documents""" for c in ["text", "lang", "source"]]))
def is_free_text(spark, d):
    return S.free_text_flags(table(spark, d, "documents"), ["text", "lang", "source"])


@register("type_issues", with_dirty(union_all(
    [f"""SELECT '{c}' AS {q('column')}, 'numeric_looks_categorical' AS issue FROM dirty
  HAVING count(DISTINCT {c}) / count(*) < 0.05 AND count(DISTINCT {c}) > 2""" for c in DIRTY_NUMERIC]
    + ["""SELECT 'event_type', 'mixed_types' FROM dirty
  HAVING count(TRY_CAST(event_type AS DOUBLE)) > 0 AND count(TRY_CAST(event_type AS DOUBLE)) < count(event_type)"""])))
def type_issues(spark, d):
    return S.type_issues(dirty(spark, d).drop("ts"))


@register("analysis_type", f"""SELECT {r6('avg(length(text))')} AS avg_len,
  CASE WHEN avg(length(text)) > 50 THEN 'text' ELSE 'eda' END AS analysis_type FROM documents""")
def analysis_type(spark, d):
    return S.analysis_type(table(spark, d, "documents"), ["text", "lang", "source"])


_LI_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
             ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@register("dtype_counts", "SELECT dtype, CAST(count(*) AS BIGINT) AS n_columns FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS dtype FROM lineitem HAVING count({c}) > 0" for c, t in _LI_TYPES) + ") GROUP BY dtype")
def dtype_counts(spark, d):
    return S.dtype_counts(table(spark, d, "lineitem"))
