"""Scalar function queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.functions import scalar as X
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6, with_dirty

NON_WORD_SQL = r"[^\p{L}\p{N}_\s]"


@register("fn_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  CAST(day(o_orderdate) AS INT) AS day, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday,
  CAST(hour(o_orderdate) AS INT) AS hour, CAST(quarter(o_orderdate) AS INT) AS quarter FROM orders""")
def fn_date_parts(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[v.alias(k) for k, v in X.date_parts("o_orderdate").items()])


@register("fn_cyclical", f"""
SELECT o_orderkey, {r6(f'sin({2 * math.pi!r} * month(o_orderdate) / 12)')} AS month_sin,
  {r6(f'cos({2 * math.pi!r} * month(o_orderdate) / 12)')} AS month_cos,
  {r6(f'sin({2 * math.pi!r} * day(o_orderdate) / 31)')} AS day_sin,
  {r6(f'cos({2 * math.pi!r} * day(o_orderdate) / 31)')} AS day_cos FROM orders""")
def fn_cyclical(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[v.alias(k) for k, v in X.cyclical("o_orderdate").items()])


_WORDS_SQL = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"


@register("fn_text_lengths", f"""
SELECT doc_id, CAST(length(text) AS INT) AS length, CAST(len({_WORDS_SQL}) AS INT) AS word_count,
  CAST(length(replace(text, ' ', '')) AS INT) AS char_count FROM documents""")
def fn_text_lengths(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", *[v.alias(k) for k, v in X.text_lengths("text").items()])


@register("fn_clean_text", f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{NON_WORD_SQL}', '', 'g'), '\\s+', ' ', 'g')) AS clean
FROM documents""")
def fn_clean_text(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", X.clean_text("text").alias("clean"))


def _basic_cleaning_sql(col: str) -> str:
    t = f"lower({col})"
    for pat, rep in [(r"http\S+|www\S+|https\S+", ""), (r"\S+@\S+", ""),
                     (r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", ""), (r"<.*?>", ""),
                     (NON_WORD_SQL, " "), (r"\d+", "")]:
        t = f"regexp_replace({t}, '{pat}', '{rep}', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@register("fn_basic_cleaning", f"""
SELECT 'page' AS kind, page_id AS id, {_basic_cleaning_sql('html')} AS clean FROM pages
UNION ALL SELECT 'doc', doc_id, {_basic_cleaning_sql('text')} FROM documents""")
def fn_basic_cleaning(spark, d):
    p = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                         X.basic_cleaning("html").alias("clean"))
    t = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"),
                                             X.basic_cleaning("text").alias("clean"))
    return p.unionByName(t)


@register("fn_email", """
SELECT doc_id, candidate, regexp_matches(candidate, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS is_valid
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+@\\S+')) AS candidate FROM documents)""")
def fn_email(spark, d):
    doc = table(spark, d, "documents")
    cand = doc.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+@\S+"), 0)).alias("candidate"))
    return cand.select("doc_id", "candidate", X.is_valid_email("candidate").alias("is_valid"))


@register("fn_truncate", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS short FROM documents""")
def fn_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate("text", 100).alias("short"))


def _fmt_sql(col: str) -> str:
    v = f"CAST({col} AS DECIMAL(38,10))"

    def f(div, suf):
        return f"CAST(CAST(ROUND({v} / CAST({div} AS DECIMAL(38,0)), 2) AS DECIMAL(38,2)) AS VARCHAR) || '{suf}'"
    return (f"CASE WHEN {v} >= 1000000000 THEN {f(1000000000, 'B')} WHEN {v} >= 1000000 THEN {f(1000000, 'M')} "
            f"WHEN {v} >= 1000 THEN {f(1000, 'K')} ELSE {f(1, '')} END")


@register("fn_format_number", f"SELECT o_orderkey, {_fmt_sql('o_totalprice')} AS pretty FROM orders")
def fn_format_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.format_number("o_totalprice").alias("pretty"))


@register("fn_safe_divide", f"""
SELECT l_orderkey, l_linenumber, {r6('CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_discount END')} AS ratio
FROM lineitem""")
def fn_safe_divide(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.safe_divide("l_extendedprice", "l_discount").alias("ratio"))


@register("fn_clip", with_dirty(f"""
SELECT event_id, {r6('CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, 10.0), 90.0) END')} AS clipped FROM dirty"""))
def fn_clip(spark, d):
    return dirty(spark, d).select("event_id", X.clip("value", 10.0, 90.0).alias("clipped"))


@register("fn_fill_constant", with_dirty("SELECT event_id, coalesce(event_type, 'Unknown') AS event_type FROM dirty"))
def fn_fill_constant(spark, d):
    return dirty(spark, d).select("event_id", X.fill_constant("event_type").alias("event_type"))


@register("fn_md5", """
SELECT o_orderkey, md5(concat_ws(chr(31), CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
  o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'))) AS fingerprint FROM orders""")
def fn_md5(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.fingerprint("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                                F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fingerprint"))


@register("fn_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k,
  CAST(to_json(struct_pack(k := CAST(json_extract(props, '$.k') AS INT))) AS VARCHAR) AS encoded FROM events""")
def fn_json(spark, d):
    ev = table(spark, d, "events")
    parsed = ev.select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"))).alias("encoded"))


@register("fn_array_ops", """
SELECT conv_id, array_to_string(list_append(roles, 'observer'), ',') AS appended,
  array_to_string(list_filter(roles, lambda r: r <> 'assistant'), ',') AS removed,
  list_contains(roles, 'user') AS has_user
FROM (SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY conv_id)""")
def fn_array_ops(spark, d):
    c = table(spark, d, "conversations")
    roles = c.groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return roles.select("conv_id", F.array_join(F.array_append("roles", F.lit("observer")), ",").alias("appended"),
                        F.array_join(F.array_remove("roles", "assistant"), ",").alias("removed"),
                        F.array_contains("roles", "user").alias("has_user"))


WORD_RE = r"\p{L}[\p{L}\p{N}_']*"
WORD_RE_SQL = WORD_RE.replace("'", "''")


@register("fn_syllables", f"""
SELECT doc_id, CAST(coalesce(sum(greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN lower(w) LIKE '%e' THEN 1 ELSE 0 END)), 0) AS BIGINT) AS syllables,
  CAST(count(w) AS BIGINT) AS n_words
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_RE_SQL}')) AS w FROM documents) GROUP BY doc_id""")
def fn_syllables(spark, d):
    doc = table(spark, d, "documents")
    ws = doc.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORD_RE), 0)).alias("w"))
    return ws.groupBy("doc_id").agg(F.sum(X.syllables("w")).cast("long").alias("syllables"),
                                    F.count("w").cast("long").alias("n_words"))


@register("fn_add_ttl", """
SELECT event_id, strftime(ts + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS expires_at FROM events""")
def fn_add_ttl(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", F.date_format(X.add_seconds(F.col("ts").cast("timestamp"), 86400),
                                                "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@register("fn_day_diff", """
SELECT o_orderkey, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders""")
def fn_day_diff(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.day_diff("o_orderdate", F.lit("1992-01-01")).alias("days"))
