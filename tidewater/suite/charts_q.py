"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import charts as CH
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import q, r6, with_dirty


def _bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    return (f"CASE WHEN {hi} = {lo} THEN 0 ELSE CAST(least(floor((CAST({x} AS DOUBLE) - {lo}) / (({hi} - {lo}) / {bins})), "
            f"{bins - 1}) AS INT) END")


@register("histogram", f"""
SELECT CAST(bin AS INT) AS bin, {r6('lo + bin * (hi - lo) / 30')} AS bin_start, {r6('lo + (bin + 1) * (hi - lo) / 30')} AS bin_end,
  CAST(count(*) AS BIGINT) AS count
FROM (SELECT {_bin_sql('l_extendedprice', 'lo', 'hi', 30)} AS bin, lo, hi FROM lineitem,
  (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) r WHERE l_extendedprice IS NOT NULL)
GROUP BY bin, lo, hi""")
def histogram(spark, d):
    return CH.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30)


@register("box_stats", f"""
SELECT o.o_orderpriority, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3, CAST(count(*) AS BIGINT) AS n,
  {r6('min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
  {r6('max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM orders o JOIN (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) b ON o.o_orderpriority = b.o_orderpriority
GROUP BY o.o_orderpriority, q1, med, q3""")
def box_stats(spark, d):
    return CH.box_stats(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"])


@register("violin_bins", f"""
SELECT o_orderpriority, CAST(bin AS INT) AS bin, {r6('lo + bin * (hi - lo) / 20')} AS bin_start,
  {r6('lo + (bin + 1) * (hi - lo) / 20')} AS bin_end, CAST(count(*) AS BIGINT) AS count,
  {r6('count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority)')} AS density
FROM (SELECT o_orderpriority, {_bin_sql('o_totalprice', 'lo', 'hi', 20)} AS bin, lo, hi FROM orders,
  (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderpriority IS NOT NULL) r
  WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL)
GROUP BY o_orderpriority, bin, lo, hi""")
def violin_bins(spark, d):
    return CH.violin_bins(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", 20)


@register("scatter_bins", f"""
SELECT {_bin_sql('l_quantity', 'lx', 'hx', 20)} AS bin_x, {_bin_sql('l_extendedprice', 'ly', 'hy', 20)} AS bin_y,
  l_returnflag, CAST(count(*) AS BIGINT) AS count
FROM lineitem, (SELECT min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem)
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY ALL""")
def scatter_bins(spark, d):
    return CH.scatter_bins(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20, "l_returnflag")


@register("bar_agg", f"""
SELECT o_orderpriority, {r6('avg(o_totalprice)')} AS mean, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1""")
def bar_agg(spark, d):
    return CH.bar_agg(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@register("line_series", f"""
SELECT strftime(ts, '%Y-%m-%d') AS x, {r6('avg(value)')} AS y, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def line_series(spark, d):
    return CH.line_series(table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), "value")


_SM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scatter_matrix_sql() -> str:
    rng = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SM)
    parts = []
    for a in _SM:
        for c in _SM:
            by_ = "-1" if a == c else _bin_sql(c, f"lo_{c}", f"hi_{c}", 10)
            cond = f"{a} IS NOT NULL" + ("" if a == c else f" AND {c} IS NOT NULL")
            parts.append(f"SELECT '{a}' AS col_x, '{c}' AS col_y, {_bin_sql(a, f'lo_{a}', f'hi_{a}', 10)} AS bin_x, "
                         f"{by_} AS bin_y FROM lineitem, r WHERE {cond}")
    return (f"WITH r AS (SELECT {rng} FROM lineitem) SELECT col_x, col_y, CAST(bin_x AS INT) AS bin_x, "
            f"CAST(bin_y AS INT) AS bin_y, CAST(count(*) AS BIGINT) AS count FROM ("
            + "\nUNION ALL\n".join(parts) + ") GROUP BY ALL")


@register("scatter_matrix", _scatter_matrix_sql())
def scatter_matrix(spark, d):
    return CH.scatter_matrix(table(spark, d, "lineitem"), _SM, 10)


_MP_COLS = ["event_type", "value", "value_sq", "pos_n", "value_sparse"]


@register("missing_pattern", with_dirty(f"""
SELECT CAST(floor((event_id - lo) * 20 / (hi - lo + 1)) AS INT) AS block, c AS {q('column')},
  CAST(count(*) AS BIGINT) AS rows, {r6('avg(CAST(is_null AS DOUBLE))')} AS null_rate
FROM (SELECT event_id, unnest([{', '.join(f"'{c}'" for c in _MP_COLS)}]) AS c,
             unnest([{', '.join(f'{c} IS NULL' for c in _MP_COLS)}]) AS is_null FROM dirty),
     (SELECT min(event_id) AS lo, max(event_id) AS hi FROM dirty)
GROUP BY ALL"""))
def missing_pattern(spark, d):
    return CH.missing_pattern(dirty(spark, d), "event_id", _MP_COLS, 20)


@register("target_analysis", with_dirty(f"""
SELECT 'nulls' AS part, CASE WHEN value IS NULL THEN 'null' ELSE 'non_null' END AS key, CAST(count(*) AS BIGINT) AS count
FROM dirty GROUP BY 2
UNION ALL
SELECT 'histogram', CAST({_bin_sql('value', 'lo', 'hi', 20)} AS VARCHAR), CAST(count(*) AS BIGINT)
FROM dirty, (SELECT min(value) AS lo, max(value) AS hi FROM dirty) WHERE value IS NOT NULL GROUP BY 2"""))
def target_analysis(spark, d):
    return CH.target_analysis(dirty(spark, d), "value", 20)


@register("target_analysis_categorical", with_dirty("""
SELECT 'nulls' AS part, CASE WHEN event_type IS NULL THEN 'null' ELSE 'non_null' END AS key, CAST(count(*) AS BIGINT) AS count
FROM dirty GROUP BY 2
UNION ALL
SELECT * FROM (SELECT 'top_values', event_type, CAST(count(*) AS BIGINT) AS c FROM dirty WHERE event_type IS NOT NULL
  GROUP BY 2 ORDER BY c DESC, 2 LIMIT 10)"""))
def target_analysis_categorical(spark, d):
    return CH.target_analysis(dirty(spark, d), "event_type", 20)


@register("daily_counts", """
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1""")
def daily_counts(spark, d):
    out = CH.daily_counts(table(spark, d, "events"), "ts")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "count")
