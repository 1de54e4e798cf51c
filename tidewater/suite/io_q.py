"""Source / sink queries (S1-S9, K5-K12): round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators.profile import basic_summary, missing_summary
from tidewater.sources import io as IO
from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6

_ORDERS_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def _orders_back(df):
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
                     F.col("o_totalprice").cast("double"),
                     F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("o_orderdate"),
                     "o_orderpriority")


def _round_trip(spark, d, ext):
    o = table(spark, d, "orders")
    path = IO.scratch_path(spark, "orders") + ext
    IO.write(o, path)
    return _orders_back(IO.read(spark, path))


@register("src_csv", _ORDERS_SQL)
def src_csv(spark, d):
    return _round_trip(spark, d, ".csv")


@register("src_tsv", _ORDERS_SQL)
def src_tsv(spark, d):
    return _round_trip(spark, d, ".tsv")


@register("src_json", _ORDERS_SQL)
def src_json(spark, d):
    return _round_trip(spark, d, ".json")


@register("src_parquet", f"""SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def src_parquet(spark, d):
    o = IO.read(spark, f"{d.rstrip('/')}/orders.parquet")
    return o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@register("src_auto", _ORDERS_SQL)
def src_auto(spark, d):
    o = table(spark, d, "orders")
    path = IO.scratch_path(spark, "auto") + ".parquet"
    IO.write(o, path, "parquet")
    return _orders_back(IO.load(spark, path))


@register("src_sql", f"""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, {r6('avg(o_totalprice)')} AS avg_price
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""")
def src_sql(spark, d):
    o = table(spark, d, "orders")
    return IO.sql(spark, "SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS avg_price FROM {orders} "
                         "WHERE o_orderstatus = :status GROUP BY o_orderpriority", {"status": "F"}, orders=o)


@register("src_catalog", "SELECT CAST(count(*) AS BIGINT) AS rows, 11 AS columns FROM lineitem")
def src_catalog(spark, d):
    back = IO.load_dataset(spark, IO.save_dataset(spark, table(spark, d, "lineitem"), "lineitem", "project-1"))
    return back.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(back.columns)))


@register("catalog_save", """
SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS rows, 6 AS columns FROM orders
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT), 11 FROM lineitem""")
def catalog_save(spark, d):
    one, two = (IO.dataset_row(spark, IO.save_dataset(spark, table(spark, d, name), name, "project-1")) for name in ("orders", "lineitem"))
    return one.unionByName(two).select("name", "rows", "columns")


@register("export_summary", """
SELECT 'summary' AS sheet, CAST(NULL AS VARCHAR) AS "column", 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM orders
UNION ALL SELECT 'summary', NULL, 'columns', 6
UNION ALL SELECT 'summary', NULL, 'missing_cells', CAST(count(*) * 6 - count(o_orderkey) - count(o_custkey) - count(o_orderstatus)
  - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority) AS BIGINT) FROM orders
UNION ALL """ + "\nUNION ALL ".join(
    f"SELECT 'types', '{c}', 'non_null', CAST(count({c}) AS BIGINT) FROM orders UNION ALL "
    f"SELECT 'types', '{c}', 'nulls', CAST(count(*) - count({c}) AS BIGINT) FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]))
def export_summary(spark, d):
    sheets = IO.export_summary(table(spark, d, "orders"))
    base = IO.scratch_path(spark, "workbook")
    for name, df in sheets.items():
        IO.write(df, f"{base}/{name}.parquet", "parquet")
    s = spark.read.parquet(f"{base}/summary.parquet")
    t = spark.read.parquet(f"{base}/types.parquet")
    summ = s.select(F.lit("summary").alias("sheet"), F.lit(None).cast("string").alias("column"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rows", "columns", "missing_cells")])).alias("x"))
    types = t.select(F.lit("types").alias("sheet"), "column", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("non_null", "nulls")])).alias("x"))
    return summ.select("sheet", "column", "x.metric", "x.value").unionByName(
        types.select("sheet", "column", "x.metric", "x.value"))


@register("export_batch", """
SELECT 'orders' AS name, TRUE AS ok, CAST(count(*) AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS error FROM orders
UNION ALL SELECT 'lineitem', TRUE, CAST(count(*) AS BIGINT), NULL FROM lineitem
UNION ALL SELECT 'events', TRUE, CAST(count(*) AS BIGINT), NULL FROM events""")
def export_batch(spark, d):
    items = [(n, table(spark, d, n)) for n in ("orders", "lineitem", "events")]
    done = IO.batch_export(spark, items).collect()  # a row for each exported table
    rows = [(r["name"], r["ok"], spark.read.parquet(r["path"]).count() if r["ok"] else None, r["error"]) for r in done]
    return spark.createDataFrame(rows, "name string, ok boolean, n_rows long, error string")


@register("catalog_insert", """
SELECT c_custkey, c_name, c_mktsegment, c_mktsegment <> 'BUILDING' AS inserted FROM customer""")
def catalog_insert(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    existing = cu.where(F.col("c_mktsegment") == "BUILDING").withColumn("inserted", F.lit(False))
    incoming = cu.withColumn("inserted", F.lit(True))
    new_table, _refused = IO.insert_new(existing, incoming, "c_name")
    return new_table


@register("export_expired", """
SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def export_expired(spark, d):
    ev = table(spark, d, "events")
    as_of = ev.agg(F.max("ts")).collect()[0][0]
    return IO.expired_exports(ev, as_of, 7, "ts").select("event_id")


@register("report_sections", f"""
WITH tmpl(position, section) AS (VALUES (1, 'overview'), (2, 'quality'), (3, 'missing_values'), (4, 'correlations'), (5, 'recommendations')),
avail AS (SELECT 'overview' AS section, 'rows=' || CAST(count(*) AS VARCHAR) || ', duplicates=' ||
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS VARCHAR) AS content FROM lineitem
  UNION ALL SELECT 'missing_values', 'columns_with_missing=' || CAST(count(*) AS VARCHAR) FROM (
    {' UNION ALL '.join(f"SELECT '{c}' AS c FROM lineitem HAVING count(*) - count({c}) > 0" for c in ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate'])}))
SELECT CAST(position AS INT) AS position, section, coalesce(content, 'No data available for this section.') AS content
FROM tmpl LEFT JOIN avail USING (section)""")
def report_sections(spark, d):
    li = table(spark, d, "lineitem")
    b = basic_summary(li).select(F.lit("overview").alias("section"), F.concat(
        F.lit("rows="), F.col("n_rows").cast("string"), F.lit(", duplicates="), F.col("n_duplicates").cast("string")).alias("content"))
    m = missing_summary(li, only_missing=True).agg(F.count(F.lit(1)).alias("k")).select(
        F.lit("missing_values").alias("section"), F.concat(F.lit("columns_with_missing="), F.col("k").cast("string")).alias("content"))
    return IO.report_sections(spark, b.unionByName(m))



