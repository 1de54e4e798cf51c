"""Feature engineering / encoding / scaling queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.operators import features as E
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import q, r6, with_dirty

_P = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TWO_PI = repr(2 * math.pi)


@register("feat_products", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r6(f'{a} * {b}')} AS {a}_x_{b}" for i, a in enumerate(_P) for b in _P[i + 1:]) + " FROM lineitem")
def feat_products(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_P)
    out = E.pairwise_products(li, _P)
    return out.drop(*_P)


_GM = [(c, n) for c in ["o_orderstatus", "o_orderpriority"] for n in ["o_orderkey", "o_custkey", "o_totalprice"]]


@register("feat_group_mean", "SELECT o_orderkey, " + ", ".join(
    f"{r6(f'avg({n}) OVER (PARTITION BY {c})')} AS {c}_{n}_mean" for c, n in _GM) + " FROM orders")
def feat_group_mean(spark, d):
    o = table(spark, d, "orders").drop("o_orderdate")
    out = E.category_mean_features(o)
    return out.select("o_orderkey", *[f"{c}_{n}_mean" for c, n in _GM])


def _bins_sql() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]
    parts = [f"""SELECT l_orderkey, l_linenumber, '{c}' AS {q('column')},
  CAST(greatest(0, least(4, ceil(({c} - lo) / ((hi - lo) / 5)) - 1)) AS INT) AS bin
FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi, count(DISTINCT {c}) AS nd FROM lineitem) WHERE nd > 10"""
             for c in cols]
    return "\nUNION ALL\n".join(parts)


@register("feat_bins", _bins_sql())
def feat_bins(spark, d):
    """E3 in long form (key, column, bin): which columns get binned is data-driven."""
    li = table(spark, d, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")
    out = E.equal_width_bins(li)
    binned = [c for c in out.columns if c.endswith("_binned")]
    cells = F.explode(F.array(*[F.struct(F.lit(c[:-len("_binned")]).alias("column"), F.col(c).alias("bin"))
                                for c in binned])).alias("s")
    return out.select("l_orderkey", "l_linenumber", cells).select("l_orderkey", "l_linenumber", "s.column", "s.bin")


@register("feat_text", """
SELECT doc_id, CAST(length(text) AS INT) AS text_length,
  CAST(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS INT) AS text_word_count,
  CAST(length(replace(text, ' ', '')) AS INT) AS text_char_count FROM documents""")
def feat_text(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    out = E.text_features(doc, ["text", "lang", "source"])
    return out.select("doc_id", *[c for c in out.columns if c.startswith("text_")])


def _dt_sql(c: str) -> str:
    return ", ".join([
        f"CAST(year({c}) AS INT) AS {c}_year", f"CAST(month({c}) AS INT) AS {c}_month",
        f"CAST(day({c}) AS INT) AS {c}_day", f"CAST(isodow({c}) - 1 AS INT) AS {c}_weekday",
        f"CAST(hour({c}) AS INT) AS {c}_hour", f"CAST(quarter({c}) AS INT) AS {c}_quarter",
        f"{r6(f'sin({TWO_PI} * month({c}) / 12)')} AS {c}_month_sin",
        f"{r6(f'cos({TWO_PI} * month({c}) / 12)')} AS {c}_month_cos",
        f"{r6(f'sin({TWO_PI} * day({c}) / 31)')} AS {c}_day_sin",
        f"{r6(f'cos({TWO_PI} * day({c}) / 31)')} AS {c}_day_cos"])


@register("feat_datetime", f"SELECT o_orderkey, {_dt_sql('o_orderdate')} FROM orders")
def feat_datetime(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return E.datetime_features(o).drop("o_orderdate")


@register("enc_factorize", with_dirty("""
SELECT d.event_id, CAST(coalesce(c.code, -1) AS BIGINT) AS event_type_code FROM dirty d LEFT JOIN (
  SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM dirty
  WHERE event_type IS NOT NULL GROUP BY event_type) c ON d.event_type = c.event_type"""))
def enc_factorize(spark, d):
    df = dirty(spark, d).select("event_id", "event_type")
    return E.factorize(df, "event_type", ["event_id"]).select("event_id", "event_type_code")


_OH = {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}


def _oh_sql() -> str:
    cols = []
    for c, vals in _OH.items():
        for v in vals:
            cols.append(f"CAST(coalesce({c} = '{v}', false) AS INT) AS \"{c}_{v}\"")
    return "SELECT o_orderkey, " + ", ".join(cols) + " FROM orders"


@register("enc_onehot", _oh_sql())
def enc_onehot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return E.one_hot(E.one_hot(o, "o_orderstatus"), "o_orderpriority")


@register("enc_label", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS BIGINT) AS o_orderstatus_label,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority_label FROM orders""")
def enc_label(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = E.label_encode(E.label_encode(o, "o_orderstatus"), "o_orderpriority")
    return out.select("o_orderkey", "o_orderstatus_label", "o_orderpriority_label")


def _scale_sql(expr_of) -> str:
    return ("SELECT l_orderkey AS k1, l_linenumber AS k2, " + ", ".join(f"{r6(expr_of(c))} AS {c}" for c in _P)
            + " FROM lineitem, (SELECT " + ", ".join(
                f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, "
                f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS q2_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
                for c in _P) + " FROM lineitem)")


def _scaled(spark, d, method):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), *_P)
    return E.scale(li, _P, method)


@register("scale_standard", _scale_sql(lambda c: f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - m_{c}) / s_{c} END"))
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@register("scale_minmax", _scale_sql(lambda c: f"CASE WHEN hi_{c} = lo_{c} THEN 0.0 ELSE ({c} - lo_{c}) / (hi_{c} - lo_{c}) END"))
def scale_minmax(spark, d):
    return _scaled(spark, d, "minmax")


@register("scale_robust", _scale_sql(lambda c: f"({c} - q2_{c}) / CASE WHEN q3_{c} = q1_{c} THEN 1.0 ELSE q3_{c} - q1_{c} END"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@register("transform_chain", "SELECT o_orderkey, o_custkey, " + r6("o_totalprice") + " AS o_totalprice, "
          + ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INT) AS \"{c}_{v}\"" for c, vals in _OH.items() for v in vals)
          + ", " + _dt_sql("o_orderdate") + " FROM orders")
def transform_chain(spark, d):
    o = table(spark, d, "orders")
    return E.transform_chain(o, ["o_orderkey"]).drop("o_orderdate")


@register("class_weights", f"""
SELECT quality, CAST(count(*) AS BIGINT) AS count,
  {r6('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM labels GROUP BY quality""")
def class_weights(spark, d):
    return E.class_weights(table(spark, d, "labels"), "quality")


@register("problem_type", """
SELECT 'quality' AS target, CAST(count(DISTINCT quality) AS BIGINT) AS n_distinct,
  CASE WHEN count(DISTINCT quality) < 10 THEN 'classification' ELSE 'regression' END AS problem_type FROM labels
UNION ALL SELECT 'value', CAST(count(DISTINCT value) AS BIGINT),
  CASE WHEN count(DISTINCT value) < 10 THEN 'classification' ELSE 'regression' END FROM events
UNION ALL SELECT 'event_type', CAST(count(DISTINCT event_type) AS BIGINT), 'classification' FROM events""")
def problem_type(spark, d):
    lab, ev = table(spark, d, "labels"), table(spark, d, "events")
    return (E.problem_type(lab, "quality").unionByName(E.problem_type(ev, "value"))
            .unionByName(E.problem_type(ev, "event_type")))


@register("target_distribution", """
SELECT CAST(quality AS VARCHAR) AS key, CAST(count(*) AS DOUBLE) AS value FROM labels GROUP BY quality""")
def target_distribution(spark, d):
    return E.target_distribution(table(spark, d, "labels"), "quality")


@register("target_distribution_regression", f"""
SELECT * FROM (VALUES ('count', (SELECT CAST(count(value) AS DOUBLE) FROM events)),
  ('mean', (SELECT {r6('avg(value)')} FROM events)), ('std', (SELECT {r6('stddev_samp(value)')} FROM events)),
  ('min', (SELECT {r6('min(value)')} FROM events)), ('q25', (SELECT {r6('quantile_cont(value, 0.25)')} FROM events)),
  ('q50', (SELECT {r6('quantile_cont(value, 0.5)')} FROM events)), ('q75', (SELECT {r6('quantile_cont(value, 0.75)')} FROM events)),
  ('max', (SELECT {r6('max(value)')} FROM events))) t(key, value)""")
def target_distribution_regression(spark, d):
    return E.target_distribution(table(spark, d, "events"), "value")


@register("ml_oversample", """
SELECT l.quality, CAST(count(*) AS BIGINT) AS n_rows FROM labels l
JOIN (SELECT quality, CAST(ceil(max(count(*)) OVER () / count(*)) AS INT) AS r FROM labels GROUP BY quality) x
  ON l.quality = x.quality, range(1, 1000) t(i) WHERE t.i <= x.r GROUP BY l.quality""")
def ml_oversample(spark, d):
    out = E.oversample(table(spark, d, "labels"), "quality")
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n_rows"))


@register("split_stratified")
def split_stratified(spark, d):
    lab = table(spark, d, "labels")
    return E.stratified_split(lab, "quality", "doc_id", 0.2).groupBy("quality", "split").agg(
        F.count(F.lit(1)).alias("n"))
