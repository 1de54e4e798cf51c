"""Sorts, limits, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6


def head(df, order, n=10):
    """First ``n`` rows in a total order (TakeOrderedAndProject: per-task top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def tail(df, order, n=10):
    """Last ``n`` rows = top-n of the reversed order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def top_counts(df, key, k=10):
    """O3: most frequent keys, ties broken by key (total order)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), key).limit(k)


def hash_sample(df, key, fraction, seed=42):
    """Deterministic sample: rows whose seeded hash of the key falls under the fraction
    (the same rows on every run and every cluster size)."""
    h = F.abs(F.xxhash64(F.col(key), F.lit(seed))) % 1_000_000
    return df.where(h < int(fraction * 1_000_000))


@register("limit_head", f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_head(spark, d):
    return head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@register("limit_tail", f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
def limit_tail(spark, d):
    return tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@register("sort_desc", f"SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_desc(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@register("topk_counts", """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY o_custkey ORDER BY count DESC, o_custkey LIMIT 10""")
def topk_counts(spark, d):
    return top_counts(table(spark, d, "orders"), "o_custkey", 10)


@register("sample_hash")
def sample_hash(spark, d):
    return hash_sample(table(spark, d, "lineitem"), "l_orderkey", 0.1).select("l_orderkey", "l_linenumber")
