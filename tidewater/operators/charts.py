"""Chart data (A21-A30): the aggregates behind each chart, never the rendering.

Binning uses the column range (two numbers, collected) inlined as literals,
so every chart is one scan + one small grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.attach import attach
from tidewater.plans.quantiles import quantile_wide


def value_range(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}__lo"), F.max(F.col(c).cast("double")).alias(f"{c}__hi")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"{c}__lo"], r[f"{c}__hi"]) for c in cols}


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bins, left-closed, the last bin also closed; a constant column is one bin (SEM-7)."""
    if lo is None:
        return F.lit(None).cast("int")
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    w = (hi - lo) / bins
    return F.least(F.floor((x.cast("double") - lo) / w), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, bin_start, bin_end, count) for non-empty bins."""
    lo, hi = value_range(df, [col])[col]
    w = (hi - lo) / bins if lo is not None and hi != lo else 0.0
    b = bin_index(F.col(col), lo, hi, bins)
    h = df.where(F.col(col).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select(*by, "bin", (F.lit(lo) + F.col("bin") * w).alias("bin_start"),
                    (F.lit(lo) + (F.col("bin") + 1) * w).alias("bin_end"), "count")


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme values inside the fences), outlier count."""
    by = list(by)
    q = quantile_wide(df, [col], [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"]).drop("column")
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    x = F.col(col).cast("double")
    # q has one row per group: AQE broadcasts it when small, else it is a normal
    # shuffle join; without groups its single row is inlined as literals
    j = attach(df.where(x.isNotNull()).select(*by, x.alias("_x")), q, by)
    inside = (F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence"))
    return j.groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def violin_bins(df: DataFrame, col: str, by: str, bins: int = 20) -> DataFrame:
    """Per category, a shared-range histogram normalised to a density per category."""
    h = histogram(df.where(F.col(by).isNotNull()), col, bins, by=[by])
    tot = h.groupBy(by).agg(F.sum("count").alias("_tot"))
    return h.join(tot, by).withColumn("density", F.col("count") / F.col("_tot")).drop("_tot")


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 20, color: str | None = None) -> DataFrame:
    """2-D binned scatter (optionally per colour) - what to plot at scale instead of points."""
    rng = value_range(df, [x, y])
    bx = bin_index(F.col(x), *rng[x], bins)
    by_ = bin_index(F.col(y), *rng[y], bins)
    keys = [bx.alias("bin_x"), by_.alias("bin_y")] + ([F.col(color)] if color else [])
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("count")))


def bar_agg(df: DataFrame, cat: str, val: str) -> DataFrame:
    """Category -> mean, count."""
    return df.groupBy(cat).agg(F.avg(val).alias("mean"), F.count(F.lit(1)).alias("count"))


def line_series(df: DataFrame, x: Column, y: str, name: str = "x") -> DataFrame:
    """Y averaged per x bucket, ordered by x."""
    return df.groupBy(x.alias(name)).agg(F.avg(y).alias("y"), F.count(F.lit(1)).alias("n")).orderBy(name)


def scatter_matrix(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """For <= 4 columns, 1-D bins on the diagonal (bin_y = -1) and 2-D bins off it,
    in one scan: every row emits one cell per column pair."""
    cols = list(cols)
    if len(cols) > 4:
        raise ValueError("a scatter matrix takes at most four columns; choose them")
    rng = value_range(df, cols)
    b = {c: bin_index(F.col(c), *rng[c], bins) for c in cols}
    cells = []
    for a in cols:
        for c in cols:
            by_ = F.lit(-1) if a == c else b[c]
            ok = F.col(a).isNotNull() & (F.lit(True) if a == c else F.col(c).isNotNull())
            cells.append(F.when(ok, F.struct(F.lit(a).alias("col_x"), F.lit(c).alias("col_y"),
                                              b[a].alias("bin_x"), by_.alias("bin_y"))))
    ex = df.select(F.explode(F.array(*cells)).alias("s")).where(F.col("s").isNotNull()).select("s.*")
    return ex.groupBy("col_x", "col_y", "bin_x", "bin_y").agg(F.count(F.lit(1)).alias("count"))


def missing_pattern(df: DataFrame, key: str, cols: Sequence[str] | None = None, blocks: int = 20) -> DataFrame:
    """Null rate per key-range row block x column (the heat map, reduced)."""
    cols = list(cols or [c for c in df.columns if c != key])
    lo, hi = value_range(df, [key])[key]
    blk = F.floor((F.col(key) - lo) * blocks / (hi - lo + 1)).cast("int")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("is_null"))
                                for c in cols])).alias("s")
    ex = df.select(blk.alias("block"), cells).select("block", "s.*")
    return ex.groupBy("block", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("is_null").cast("double")).alias("null_rate"))


def target_analysis(df: DataFrame, target: str, bins: int = 20, top: int = 10) -> DataFrame:
    """(part, key, count): null vs non-null, then a histogram (numeric target)
    or top value counts (categorical target)."""
    from tidewater.operators.profile import value_counts
    from tidewater.operators.schema import numeric_columns
    nn = (df.groupBy(F.when(F.col(target).isNull(), "null").otherwise("non_null").alias("key"))
          .agg(F.count(F.lit(1)).alias("count")).select(F.lit("nulls").alias("part"), "key", "count"))
    if target in numeric_columns(df):
        h = histogram(df, target, bins).select(F.lit("histogram").alias("part"),
                                               F.col("bin").cast("string").alias("key"), "count")
    else:
        h = value_counts(df, target, top).select(F.lit("top_values").alias("part"),
                                                 F.col("value").cast("string").alias("key"), "count")
    return nn.unionByName(h)


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    """A30."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("count"))
