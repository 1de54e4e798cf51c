"""Profiling, quality scoring and EDA aggregates.

Pattern used throughout: one fused aggregate over the whole table (partial
aggregation on every partition, a single tiny final stage), unpivoted to a
tidy long table. Quantiles use the distributed exact selection in
``tidewater.plans.quantiles``; decisions that change the schema collect only
the one-row decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.stats import kurtosis_sample, skewness_sample
from tidewater.operators.schema import categorical_columns, datetime_columns, numeric_columns
from tidewater.plans.quantiles import quantile_wide


def _cells(df: DataFrame, cols: Sequence[str], cast: str = "string") -> DataFrame:
    """(column, value) long form of the given columns."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols
    ])).alias("s")).select("s.column", "s.value")


def unpivot_row(wide: DataFrame, cols: Sequence[str], metrics: Sequence[str],
                cast: str = "double") -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"`{c}__{m}`").cast(cast).alias(m) for m in metrics])
               for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# --- A1 / A8: rows, distinct rows, duplicates --------------------------------

def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups of identical rows (null-safe: GROUP BY treats nulls as equal)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))


def basic_summary(df: DataFrame) -> DataFrame:
    """A1: n_rows, n_cols, n_distinct, n_duplicates, duplicate_pct - one shuffle."""
    g = duplicate_groups(df)
    return g.agg(F.sum("copies").cast("long").alias("n_rows"),
                 F.count(F.lit(1)).cast("long").alias("n_distinct")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"), "n_distinct",
        (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
        (100.0 * (F.col("n_rows") - F.col("n_distinct")) / F.col("n_rows")).alias("duplicate_pct"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """A8 (SEM-5): duplicates = sum(copies - 1); groups with more than one copy."""
    g = duplicate_groups(df)
    return g.agg(
        F.sum("copies").cast("long").alias("n_rows"),
        F.sum(F.col("copies") - 1).cast("long").alias("duplicate_rows"),
        F.count_if(F.col("copies") > 1).cast("long").alias("duplicate_groups"),
        F.max("copies").cast("long").alias("max_copies"),
    ).select("n_rows", "duplicate_rows",
             (100.0 * F.col("duplicate_rows") / F.col("n_rows")).alias("duplicate_pct"),
             "duplicate_groups", "max_copies")


# --- A2 / A5 / A6 / A7: per-column counts ------------------------------------

def column_profile(df: DataFrame, cols: Sequence[str] | None = None,
                   exact_distinct: bool = True) -> DataFrame:
    """A2: column, dtype, non_null, nulls, n_distinct, null_pct in one fused aggregate."""
    cols = list(cols or df.columns)
    distinct = F.count_distinct if exact_distinct else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__non_null"), distinct(c).alias(f"{c}__n_distinct")]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    structs = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                        F.col(f"`{c}__non_null`").cast("long").alias("non_null"),
                        (F.col("__rows") - F.col(f"`{c}__non_null`")).cast("long").alias("nulls"),
                        F.col(f"`{c}__n_distinct`").cast("long").alias("n_distinct"),
                        (100.0 * (F.col("__rows") - F.col(f"`{c}__non_null`")) / F.col("__rows"))
                        .alias("null_pct"))
               for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def missing_summary(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """A5: column, missing, missing_pct."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in df.columns]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"),
                        F.col(f"`{c}__missing`").cast("long").alias("missing"),
                        (100.0 * F.col(f"`{c}__missing`") / F.col("__rows")).alias("missing_pct"))
               for c in df.columns]
    out = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return out.where(F.col("missing") > 0) if only_missing else out


def missing_tiers(df: DataFrame) -> DataFrame:
    """Severity of each column with missing values: high > 50 %, medium 10-50 %, low."""
    m = missing_summary(df, only_missing=True)
    pct = F.col("missing_pct")
    return m.withColumn("tier", F.when(pct > 50, "high").when(pct > 10, "medium").otherwise("low"))


def missing_cells(df: DataFrame) -> DataFrame:
    """Share of null cells in the whole table."""
    n_cols = len(df.columns)
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("missing_cells")).select(
        (F.col("n_rows") * n_cols).cast("long").alias("total_cells"),
        F.col("missing_cells").cast("long").alias("missing_cells"),
        (100.0 * F.col("missing_cells") / (F.col("n_rows") * n_cols)).alias("missing_pct"))


# --- A3 / A4 / A17 / A18 / A19: descriptive statistics ------------------------

def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (sample), min, max, skew and kurtosis (bias-corrected) per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), F.var_samp(x).alias(f"{c}__var"),
                 skewness_sample(x).alias(f"{c}__skew"), kurtosis_sample(x).alias(f"{c}__kurt")]
    return unpivot_row(df.agg(*aggs), cols,
                       ["count", "mean", "std", "min", "max", "var", "skew", "kurt"])


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                     method: str = "exact") -> DataFrame:
    """A3 (SEM-3): count, mean, std, min, q25, q50, q75, max; linear-interpolated quartiles."""
    cols = list(cols or numeric_columns(df))
    m = moments(df, cols).select("column", F.col("count").cast("long").alias("count"),
                                 "mean", "std", "min", "max")
    q = quantile_wide(df, cols, [0.25, 0.5, 0.75], method=method, names=["q25", "q50", "q75"])
    return m.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def value_counts(df: DataFrame, col: str, top: int | None = 10, dropna: bool = True) -> DataFrame:
    """Value, count ordered by count desc, value asc (total order), optional top-k."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    vc = src.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    vc = vc.orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return vc.limit(top) if top else vc


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4 (SEM-4): n_distinct, most frequent value (ties -> smallest) and its count."""
    cols = list(cols or categorical_columns(df))
    counts = (_cells(df, cols).where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return counts.groupBy("column").agg(
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("top"),
        F.max("cnt").cast("long").alias("freq"))


def mode_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode) with ties resolved to the smallest value (as strings)."""
    return describe_categorical(df, cols).select("column", F.col("top").alias("mode"))


def classify_distribution(skew: F.Column, kurt: F.Column) -> F.Column:
    """Ordered rule chain."""
    return (F.when((F.abs(skew) < 0.5) & (F.abs(kurt) < 0.5), "normal")
            .when(skew > 1, "right_skewed").when(skew < -1, "left_skewed")
            .when(kurt > 1, "heavy_tailed").when(kurt < -1, "light_tailed")
            .otherwise("unknown"))


def distribution_shape(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A17 + A18 (SEM-6): sample skewness / excess kurtosis, normal flag, class."""
    cols = list(cols or numeric_columns(df))
    m = moments(df, cols).where(F.col("count") > 0)
    return m.select("column", "skew", "kurt",
                    ((F.abs("skew") < 0.5) & (F.abs("kurt") < 0.5)).alias("is_normal"),
                    classify_distribution(F.col("skew"), F.col("kurt")).alias("distribution"))


def feature_analysis(df: DataFrame) -> DataFrame:
    """Per column by type; numeric min/max/mean/std, datetime range in days,
    text most common / count / average length. One fused aggregate for the
    first two, one grouped count for the third."""
    num = numeric_columns(df)
    dts = datetime_columns(df)
    txt = categorical_columns(df)
    parts = []
    if num:
        m = moments(df, num)
        parts.append(m.select("column", F.lit("numeric").alias("kind"), "min", "max", "mean", "std",
                              F.lit(None).cast("long").alias("range_days"),
                              F.lit(None).cast("string").alias("most_common"),
                              F.lit(None).cast("long").alias("most_common_count"),
                              F.lit(None).cast("double").alias("avg_length")))
    if dts:
        aggs = []
        for c in dts:
            aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
        w = df.agg(*aggs)
        structs = [F.struct(F.lit(c).alias("column"),
                            F.datediff(F.col(f"`{c}__hi`").cast("date"),
                                       F.col(f"`{c}__lo`").cast("date")).cast("long").alias("range_days"),
                            # whole days between the instants, as timedelta.days
                            F.floor((F.unix_micros(F.col(f"`{c}__hi`").cast("timestamp"))
                                     - F.unix_micros(F.col(f"`{c}__lo`").cast("timestamp")))
                                    / 86400e6).cast("long").alias("days"))
                   for c in dts]
        d = w.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
        parts.append(d.select("column", F.lit("datetime").alias("kind"),
                              *[F.lit(None).cast("double").alias(n) for n in ("min", "max", "mean", "std")],
                              F.col("days").alias("range_days"),
                              F.lit(None).cast("string").alias("most_common"),
                              F.lit(None).cast("long").alias("most_common_count"),
                              F.lit(None).cast("double").alias("avg_length")))
    if txt:
        cat = describe_categorical(df, txt)
        lens = unpivot_row(df.agg(*[F.avg(F.length(F.coalesce(F.col(c), F.lit("nan"))))
                                    .alias(f"{c}__avg_length") for c in txt]), txt, ["avg_length"])
        t = cat.join(lens, "column")
        parts.append(t.select("column", F.lit("text").alias("kind"),
                              *[F.lit(None).cast("double").alias(n) for n in ("min", "max", "mean", "std")],
                              F.lit(None).cast("long").alias("range_days"),
                              F.col("top").alias("most_common"),
                              F.col("freq").alias("most_common_count"), "avg_length"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- A9 / A10: outliers ------------------------------------------------------

def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, by: Sequence[str] = (),
               method: str = "exact") -> DataFrame:
    """(by..., column, q1, q3, iqr, lower, upper)."""
    q = quantile_wide(df, cols, [0.25, 0.75], by=by, method=method, names=["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select(*by, "column", "q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))


def collect_bounds(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds per column are a handful of numbers: safe to bring to the driver
    and inline as literals (no join, no broadcast)."""
    return {r["column"]: (r["lower"], r["upper"]) for r in bounds.collect()}


def outlier_report(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                   min_count: int = 10, method: str = "exact") -> DataFrame:
    """Per numeric column with >= 10 values and at least one outlier:
    n, q1, q3, lower, upper, n_outliers, outlier_pct (of non-null values)."""
    cols = list(cols or numeric_columns(df))
    bounds = iqr_bounds(df, cols, k, method=method).collect()
    b = {r["column"]: r for r in bounds}
    aggs = []
    for c in cols:
        if c not in b:
            continue
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"),
                 F.count_if((x < b[c]["lower"]) | (x > b[c]["upper"])).alias(f"{c}__n_outliers")]
    used = [c for c in cols if c in b]
    counts = unpivot_row(df.agg(*aggs), used, ["n", "n_outliers"], "long")
    spark = df.sparkSession
    bdf = spark.createDataFrame([(r["column"], r["q1"], r["q3"], r["lower"], r["upper"]) for r in bounds],
                                "column string, q1 double, q3 double, lower double, upper double")
    return (counts.join(bdf, "column")
            .where((F.col("n") >= min_count) & (F.col("n_outliers") > 0))
            .select("column", "n", "q1", "q3", "lower", "upper", "n_outliers",
                    (100.0 * F.col("n_outliers") / F.col("n")).alias("outlier_pct")))


def outlier_rows(df: DataFrame, cols: Sequence[str], keys: Sequence[str], method: str = "iqr",
                 threshold: float = 3.0) -> DataFrame:
    """A10: (keys..., column, value) of every outlying cell (IQR 1.5 or |z| > threshold)."""
    if method == "iqr":
        bounds = collect_bounds(iqr_bounds(df, cols))
    elif method == "zscore":
        m = {r["column"]: r for r in moments(df, cols).collect()}
        bounds = {c: (m[c]["mean"] - threshold * m[c]["std"], m[c]["mean"] + threshold * m[c]["std"])
                  for c in cols if m[c]["std"] is not None}
    else:
        raise ValueError(method)
    flagged = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                        ((F.col(c) < lo) | (F.col(c) > hi)).alias("is_out"))
               for c, (lo, hi) in bounds.items()]
    if method == "zscore":
        # strict: |x - mean| / std > threshold
        flagged = []
        for c in bounds:
            mu, sd = m[c]["mean"], m[c]["std"]
            flagged.append(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"),
                                    (F.abs((F.col(c) - mu) / sd) > threshold).alias("is_out")))
    return (df.select(*keys, F.explode(F.array(*flagged)).alias("s"))
            .where(F.col("s.is_out")).select(*keys, "s.column", "s.value"))


# --- A11-A14: quality scores --------------------------------------------------

def _quality_inputs(df: DataFrame) -> DataFrame:
    """n_rows, n_cols, missing_cells, duplicate_rows, typed_cols in one pass + one shuffle."""
    n_cols = len(df.columns)
    typed = sum(1 for f in df.schema.fields if not isinstance(f.dataType, T.StringType))
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"), F.first(nulls).alias("row_nulls"))
    return g.agg(F.sum("copies").alias("n_rows"),
                 F.sum(F.col("copies") * F.col("row_nulls")).alias("missing_cells"),
                 F.sum(F.col("copies") - 1).alias("duplicate_rows")).select(
        F.col("n_rows").cast("long"), F.lit(n_cols).cast("long").alias("n_cols"),
        F.col("missing_cells").cast("long"), F.col("duplicate_rows").cast("long"),
        F.lit(typed).cast("long").alias("typed_cols"))


def quality_product(df: DataFrame) -> DataFrame:
    """round((1 - missing cell ratio) * (1 - duplicate ratio), 3)."""
    q = _quality_inputs(df)
    mr = F.col("missing_cells") / (F.col("n_rows") * F.col("n_cols"))
    dr = F.col("duplicate_rows") / F.col("n_rows")
    return q.select(mr.alias("missing_ratio"), dr.alias("duplicate_ratio"),
                    F.round((1 - mr) * (1 - dr), 3).alias("quality_score"))


def quality_weighted(df: DataFrame) -> DataFrame:
    """100 - 30*missing ratio - 20*duplicate ratio + 10*typed share, clamped to [0, 100]."""
    q = _quality_inputs(df)
    mr = F.col("missing_cells") / (F.col("n_rows") * F.col("n_cols"))
    dr = F.col("duplicate_rows") / F.col("n_rows")
    ts = F.col("typed_cols") / F.col("n_cols")
    score = F.lit(100.0) - mr * 30 - dr * 20 + ts * 10
    return q.select(mr.alias("missing_ratio"), dr.alias("duplicate_ratio"), ts.alias("typed_share"),
                    F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("quality_score"))


def quality_penalty(df: DataFrame) -> DataFrame:
    """Capped penalties - missing (<= 30), duplicates (<= 20), 3 per type issue
    column (<= 15), 2 per outlier column (<= 10); rounded to 2, floored at 0."""
    from tidewater.operators.schema import type_issues
    q = _quality_inputs(df).collect()[0]
    n_issue_cols = type_issues(df).select("column").distinct().count()
    n_out_cols = outlier_report(df).count()
    spark = df.sparkSession
    miss_pct = 100.0 * q["missing_cells"] / (q["n_rows"] * q["n_cols"])
    dup_pct = 100.0 * q["duplicate_rows"] / q["n_rows"]
    row = [(float(min(30.0, miss_pct)), float(min(20.0, dup_pct)), int(n_issue_cols), int(n_out_cols))]
    base = spark.createDataFrame(row, "missing_penalty double, duplicate_penalty double, "
                                      "type_issue_columns long, outlier_columns long")
    score = (F.lit(100.0) - F.col("missing_penalty") - F.col("duplicate_penalty")
             - F.least(F.lit(15.0), F.col("type_issue_columns") * 3.0)
             - F.least(F.lit(10.0), F.col("outlier_columns") * 2.0))
    return base.withColumn("quality_score", F.greatest(F.lit(0.0), F.round(score, 2)))


def quality_gauge(df: DataFrame) -> DataFrame:
    """Score 1 x 100, banded at 50 / 80 / 90."""
    s = quality_product(df).select((F.col("quality_score") * 100).alias("gauge"))
    g = F.col("gauge")
    return s.withColumn("band", F.when(g >= 90, "excellent").when(g >= 80, "good")
                        .when(g >= 50, "fair").otherwise("poor"))


# --- A15 / A16: correlation ---------------------------------------------------

def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson, pairwise complete; long form (col_a, col_b, corr) incl. diagonal.
    One fused aggregate holds every pair (upper triangle), mirrored afterwards."""
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    structs = []
    for i, (a, b) in enumerate(pairs):
        structs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{i}").alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"p{i}").alias("corr")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def strong_correlations(df: DataFrame, cols: Sequence[str] | None = None,
                        threshold: float = 0.7) -> DataFrame:
    """Pairs (in column order) with |r| > threshold."""
    cols = list(cols or numeric_columns(df))
    order = {c: i for i, c in enumerate(cols)}
    cm = corr_matrix(df, cols)
    idx = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return cm.where((idx[F.col("col_a")] < idx[F.col("col_b")]) & (F.abs("corr") > threshold))


# --- A31 / A32: before-after ------------------------------------------------------

def drift_mean(before: DataFrame, after: DataFrame, cols: Sequence[str] | None = None,
               threshold: float = 0.1) -> DataFrame:
    """Relative change of the mean per shared numeric column, flagged above 10 %."""
    cols = list(cols or [c for c in numeric_columns(before) if c in set(numeric_columns(after))])
    b = unpivot_row(before.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols]), cols, ["mean"])
    a = unpivot_row(after.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols]), cols, ["mean"])
    j = b.withColumnRenamed("mean", "mean_before").join(a.withColumnRenamed("mean", "mean_after"), "column")
    change = F.try_divide(F.abs(F.col("mean_after") - F.col("mean_before")), F.abs(F.col("mean_before")))
    return j.select("column", "mean_before", "mean_after", change.alias("relative_change"),
                    (change > threshold).alias("drift"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shapes and column differences as one long table (metric, value)."""
    spark = before.sparkSession
    nb = before.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("rows_before"))
    na = after.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("rows_after"))
    added = [c for c in after.columns if c not in set(before.columns)]
    removed = [c for c in before.columns if c not in set(after.columns)]
    fixed = spark.createDataFrame(
        [("cols_before", len(before.columns)), ("cols_after", len(after.columns)),
         ("cols_added", len(added)), ("cols_removed", len(removed))], "k string, n long")
    return (nb.select(F.col("k").alias("metric"), F.col("n").cast("long").alias("value"))
            .unionByName(na.select(F.col("k").alias("metric"), F.col("n").cast("long").alias("value")))
            .unionByName(fixed.select(F.col("k").alias("metric"), F.col("n").alias("value"))))


def series_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, std, var, skew, kurt, range, cv per series."""
    x = F.col(col).cast("double")
    m = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.var_samp(x).alias("var"), skewness_sample(x).alias("skew"),
        kurtosis_sample(x).alias("kurt"), (F.max(x) - F.min(x)).alias("range"))
    med = quantile_wide(df, [col], [0.5], by=by, names=["median"]).drop("column")
    if by:
        out = m.join(med, list(by), "left")
    else:
        # ungrouped: the median is one number - attach it as a literal
        mv = med.collect()
        out = m.withColumn("median", F.lit(mv[0]["median"] if mv else None).cast("double"))
    return out.select(*by, "n", "mean", "median", "std", "var", "skew", "kurt", "range",
                      F.try_divide(F.col("std"), F.col("mean")).alias("cv"))


# --- A33 / A40-A43: composite reports ---------------------------------------------------

def recommendations(df: DataFrame, cardinality: int = 100, skew: float = 2.0, corr: float = 0.9) -> DataFrame:
    """(category, column, action) rule hits from the profile tables."""
    from tidewater.operators.schema import type_issues
    parts = []
    m = missing_summary(df, only_missing=True)
    parts.append(m.limit(1).select(F.lit("missing").alias("category"), F.lit(None).cast("string").alias("column"),
                                   F.lit("handle_missing").alias("action")))
    parts.append(m.where(F.col("missing_pct") > 50).select(F.lit("missing").alias("category"), "column",
                                                            F.lit("drop_column").alias("action")))
    parts.append(m.where((F.col("missing_pct") > 20) & (F.col("missing_pct") <= 50)).select(
        F.lit("missing").alias("category"), "column", F.lit("impute").alias("action")))
    parts.append(duplicate_summary(df).where(F.col("duplicate_rows") > 0).select(
        F.lit("duplicates").alias("category"), F.lit(None).cast("string").alias("column"),
        F.lit("remove_duplicates").alias("action")))
    parts.append(type_issues(df).limit(1).select(F.lit("types").alias("category"), F.lit(None).cast("string").alias("column"),
                                                 F.lit("standardize_types").alias("action")))
    num = numeric_columns(df)
    parts.append(outlier_report(df, num).select(F.lit("outliers").alias("category"), "column",
                                                F.lit("handle_outliers").alias("action")))
    cats = categorical_columns(df)
    if cats:
        nd = unpivot_row(df.agg(*[F.count_distinct(c).alias(f"{c}__nd") for c in cats]), cats, ["nd"])
        parts.append(nd.where(F.col("nd") > cardinality).select(F.lit("cardinality").alias("category"), "column",
                                                               F.lit("reduce_cardinality").alias("action")))
    if num:
        parts.append(distribution_shape(df, num).where(F.abs("skew") > skew).select(
            F.lit("skew").alias("category"), "column", F.lit("transform_skewed").alias("action")))
        parts.append(strong_correlations(df, num, corr).select(
            F.lit("correlation").alias("category"), F.concat_ws("|", "col_a", "col_b").alias("column"),
            F.lit("drop_collinear").alias("action")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def data_context(df: DataFrame) -> DataFrame:
    """(section, column, metric, value) with shape, nulls and numeric stats."""
    n_rows = df.agg(F.count(F.lit(1)).cast("double").alias("v"))
    shape = n_rows.select(F.lit("shape").alias("section"), F.lit(None).cast("string").alias("column"),
                          F.lit("rows").alias("metric"), F.col("v").alias("value")).unionByName(
        df.sparkSession.createDataFrame([("shape", None, "columns", float(len(df.columns)))],
                                        "section string, column string, metric string, value double"))
    nulls = missing_summary(df).select(F.lit("nulls").alias("section"), "column", F.lit("missing").alias("metric"),
                                       F.col("missing").cast("double").alias("value"))
    num = numeric_columns(df)
    m = moments(df, num)
    stats = m.select(F.lit("stats").alias("section"), "column", F.explode(F.array(*[
        F.struct(F.lit(s).alias("metric"), F.col(s).alias("value")) for s in ("mean", "std", "min", "max")])).alias("s")) \
        .select("section", "column", "s.metric", "s.value")
    return shape.unionByName(nulls).unionByName(stats)


def data_report(df: DataFrame) -> DataFrame:
    """(section, name, metric, value): column types, missing counts, describe()."""
    spark = df.sparkSession
    types = spark.createDataFrame([("types", f.name, f.dataType.simpleString(), 1.0) for f in df.schema.fields],
                                  "section string, name string, metric string, value double")
    miss = missing_summary(df).select(F.lit("missing").alias("section"), F.col("column").alias("name"),
                                      F.lit("missing").alias("metric"), F.col("missing").cast("double").alias("value"))
    d = describe_numeric(df)
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    desc = d.select(F.lit("describe").alias("section"), F.col("column").alias("name"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("value")) for s in stats])).alias("s")) \
        .select("section", "name", "s.metric", "s.value")
    return types.unionByName(miss).unionByName(desc)


def key_insights(df: DataFrame, corr_threshold: float = 0.7) -> DataFrame:
    """Rows, columns, average missing % over columns, number of strong correlations."""
    m = missing_summary(df).agg(F.avg("missing_pct").alias("avg_missing_pct"))
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    k = strong_correlations(df, numeric_columns(df), corr_threshold).agg(F.count(F.lit(1)).alias("strong_correlations"))
    r = (n.collect()[0], m.collect()[0], k.collect()[0])
    return df.sparkSession.createDataFrame(
        [(int(r[0]["n_rows"]), len(df.columns), float(r[1]["avg_missing_pct"]), int(r[2]["strong_correlations"]))],
        "n_rows long, n_cols long, avg_missing_pct double, strong_correlations long")


def eda_summary(df: DataFrame) -> DataFrame:
    """The whole EDA summary as one long table (section, column, metric, value),
    sharing one cached scan of the input."""
    cached = df.cache()
    try:
        basic = basic_summary(cached)
        b = basic.select(F.lit("basic").alias("section"), F.lit(None).cast("string").alias("column"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
            for c in ("n_rows", "n_cols", "n_duplicates")])).alias("s")).select("section", "column", "s.metric", "s.value")
        miss = missing_summary(cached).select(F.lit("missing").alias("section"), "column",
                                              F.lit("missing_pct").alias("metric"), F.col("missing_pct").alias("value"))
        num = numeric_columns(cached)
        shape = distribution_shape(cached, num)
        sk = shape.select(F.lit("distribution").alias("section"), "column", F.explode(F.array(
            F.struct(F.lit("skew").alias("metric"), F.col("skew").alias("value")),
            F.struct(F.lit("kurt").alias("metric"), F.col("kurt").alias("value")))).alias("s")).select(
            "section", "column", "s.metric", "s.value")
        desc = describe_numeric(cached, num)
        ds = desc.select(F.lit("describe").alias("section"), "column", F.explode(F.array(*[
            F.struct(F.lit(s).alias("metric"), F.col(s).cast("double").alias("value"))
            for s in ("mean", "std", "q50")])).alias("s")).select("section", "column", "s.metric", "s.value")
        out = b.unionByName(miss).unionByName(sk).unionByName(ds)
        return cut_checkpointed(out)
    finally:
        cached.unpersist()


def cut_checkpointed(df: DataFrame) -> DataFrame:
    from tidewater.session import cut_lineage
    return cut_lineage(df)


def outlier_samples(df: DataFrame, cols: Sequence[str], order: Sequence[str], n: int = 10,
                    k: float = 1.5) -> DataFrame:
    """A9 samples: the first ``n`` outlying values of each column in row order.
    One distributed top-n (TakeOrderedAndProject) per column, so no column's
    outliers are ever gathered into a single task."""
    bounds = collect_bounds(iqr_bounds(df, cols, k))
    parts = []
    for c, (lo, hi) in bounds.items():
        x = F.col(c)
        top = (df.where((x < lo) | (x > hi)).orderBy(*order).limit(n)
               .select(*order, F.lit(c).alias("column"), x.cast("double").alias("value")))
        parts.append(top.withColumn("rank", F.row_number().over(Window.orderBy(*order))))  # <= n rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop(*order)
