"""Exact, distributed quantiles (linear interpolation, as pandas / quantile_cont).

Spark's exact ``percentile`` keeps a value -> count map of a whole group inside
one task, which does not survive a high-cardinality column at scale. Here the
order statistics are located first and read afterwards:

1. one aggregate gives each column's count and, from a quantile sketch with a
   known rank error, two values that enclose each wanted rank;
2. values below each enclosure are counted, values inside it are counted by
   value. Both combine map-side, and an enclosure holds a few ten-thousandths
   of the rows;
3. running sums over the distinct values of an enclosure give the wanted ranks.

There is no size at which the method changes and no number of rounds to exceed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is rows / ACCURACY; an enclosure reaches MARGIN errors to either side.
ACCURACY, MARGIN = 20_000, 3.0


def _value(c: str) -> Column:
    """The column as a double; null for NaN."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, x) with x a non-null, non-NaN double."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _value(c).alias("x")) for c in cols])).alias("cell")
    return df.select(*by, cells).select(*by, "cell.column", "cell.x").where(F.col("x").isNotNull())


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     by: Sequence[str] = (), accuracy: int = 10000) -> DataFrame:
    keys = [*by, "column"]
    agg = long_values(df, cols, by).groupBy(*keys).agg(F.percentile_approx("x", list(probs), accuracy).alias("qs"))
    return agg.select(*keys, F.posexplode("qs").alias("i", "q")).select(
        *keys, F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("p"), "q")


def _enclosures(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by..., column, p, n, lo, hi), one row per group, column and probability; columns without values are absent."""
    e = MARGIN / ACCURACY
    grid = [0.0, 1.0, *[g for p in probs for g in (max(0.0, p - e), min(1.0, p + e))]]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(_value(c)).alias(f"n{i}"), F.percentile_approx(_value(c), grid, ACCURACY).alias(f"a{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    # where the margin is under two ranks, the enclosure is the whole column

    def bound(i: int, k: int, side: int) -> Column:
        return F.when(F.col(f"n{i}") * e < 2, F.get(f"a{i}", side)).otherwise(F.get(f"a{i}", 2 + 2 * k + side))
    found = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.col(f"n{i}").alias("n"), bound(i, k, 0).alias("lo"), bound(i, k, 1).alias("hi"))
        for i, c in enumerate(cols) for k, p in enumerate(probs)])).alias("s")
    return wide.select(*by, found).select(*by, "s.*").where("n > 0")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Returns (by..., column, p, q); groups with no values are absent."""
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    keys = [*by, "column", "p"]
    spots = _enclosures(df, cols, probs, by)
    if by:
        cells = long_values(df, cols, by).alias("v").join(
            spots.alias("t"), F.expr(" and ".join(f"v.`{k}` <=> t.`{k}`" for k in [*by, "column"])))
        cells = cells.select(*[F.col(f"t.`{k}`") for k in keys], "n", "lo", "hi", "x")
    else:
        # a few numbers per column: inlined, so the values meet them without a join
        rows = [r for r in spots.collect()]
        if not rows:
            return spots.select(*keys, F.col("lo").alias("q"))
        structs = [F.struct(F.lit(r["column"]).alias("column"), F.lit(r["p"]).alias("p"), F.lit(r["n"]).alias("n"), F.lit(r["lo"]).alias("lo"),
                            F.lit(r["hi"]).alias("hi"), _value(r["column"]).alias("x")) for r in rows]
        below = df.agg(*[F.struct(F.count_if(s["x"] < s["lo"]).alias("below"), F.min(F.when(s["x"] > s["hi"], s["x"])).alias("above")).alias(f"s{i}")
                         for i, s in enumerate(structs)]).first()
        inside = F.filter(F.array(*structs), lambda s: (s["x"] >= s["lo"]) & (s["x"] <= s["hi"]))
        cells = df.select(F.explode(inside).alias("s")).select("s.*")
    low, high = F.col("x") < F.col("lo"), F.col("x") > F.col("hi")
    counted = (cells.groupBy(*keys, "n", F.when(~low & ~high, F.col("x")).alias("x"))
               .agg(F.count(F.lit(1)).alias("c"), F.count_if(low).alias("below"), F.min(F.when(high, F.col("x"))).alias("above")))
    if not by:
        order = {(r["column"], r["p"]): i for i, r in enumerate(rows)}

        def of(name: str) -> Column:
            out = F
            for (c, p), i in order.items():
                out = out.when((F.col("column") == c) & (F.col("p") == p), F.lit(below[f"s{i}"][name]))
            return out
        counted = counted.withColumn("below", of("below")).withColumn("above", of("above").cast("double"))
    group = Window.partitionBy(*keys)
    running = group.orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select(*keys, "n", "x", F.max("below").over(group).alias("below"), F.max("above").over(group).alias("above"),
                            F.sum(F.when(F.col("x").isNotNull(), F.col("c")).otherwise(0)).over(running).alias("upto"))
    h = (F.col("n") - 1) * F.col("p")
    k = F.floor(h)
    seen = F.col("below") + F.col("upto")
    picked = ranked.groupBy(*keys, "n", "below", "above").agg(
        F.min(F.when(seen > k, F.col("x"))).alias("v0"), F.min(F.when(seen > k + 1, F.col("x"))).alias("v1"))
    v0 = F.when((F.col("below") > k) | F.col("v0").isNull(), F.raise_error("a rank lies outside its enclosure").cast("double")).otherwise(F.col("v0"))
    v1 = F.coalesce("v1", "above", "v0")
    return picked.select(*keys, (v0 + (h - k) * (v1 - v0)).alias("q"))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), method: str = "exact", **kw) -> DataFrame:
    if method == "exact":
        return exact_quantiles(df, cols, probs, by, **kw)
    if method == "approx":
        return approx_quantiles(df, cols, probs, by, **kw)
    raise ValueError(f"unknown quantile method {method!r}")


def quantile_wide(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                  by: Sequence[str] = (), method: str = "exact", names: Sequence[str] | None = None,
                  **kw) -> DataFrame:
    """(by..., column, <name per prob>) - one row per group and column."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    q = quantiles(df, cols, probs, by, method, **kw)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    return q.groupBy(*by, "column").agg(*aggs)
