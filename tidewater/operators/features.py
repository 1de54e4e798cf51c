"""Feature engineering, encoding and scaling.

Decisions (distinct counts, category lists, scaling statistics) come from one
aggregate each and are inlined as literals; the per-value code tables of the
encoders have one row per distinct value and are joined back (broadcast when
AQE sees they are small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalar import cyclical, date_parts, text_lengths
from tidewater.operators.schema import categorical_columns, datetime_columns, numeric_columns
from tidewater.plans.ordered import add_positions
from tidewater.plans.quantiles import quantile_wide


#: Hash values that the distinct values of a column are first dealt to.
BUCKETS = 4096


def distinct_counts(df: DataFrame, cols: Sequence[str], above: int) -> dict[str, int]:
    """How many distinct values each column has, exact up to ``above``; for a column of more, a number over ``above``.

    Distinct hash values are never more than distinct values, and at most ``BUCKETS``, so no task
    holds the values of a column that has many; only where they are few are the values themselves counted."""
    if not cols:
        return {}
    kinds = dict(df.dtypes)
    plain = {c: F.col(c) + F.lit(0) if kinds[c] in ("double", "float") else F.col(c) for c in cols}  # -0.0 is 0.0
    dealt = df.agg(*[F.count_distinct(F.when(F.col(c).isNotNull(), F.pmod(F.xxhash64(plain[c]), F.lit(BUCKETS)))).alias(c) for c in cols]).collect()[0]
    few = [c for c in cols if dealt[c] <= above]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in few]).collect()[0] if few else {}
    return {c: exact[c] if c in few else dealt[c] for c in cols}


# E1 -------------------------------------------------------------------------
def pairwise_products(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    prods = [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(cols) for b in cols[i + 1:]]
    return df.select("*", *prods)


# E2 -------------------------------------------------------------------------
def category_mean_features(df: DataFrame, max_cats: int = 3, max_nums: int = 3,
                           max_values: int = 10) -> DataFrame:
    """{cat}_{num}_mean for the first 3 categorical x first 3 numeric columns,
    only for categoricals with <= 10 distinct values. One grouped aggregate per
    categorical column covers all its numeric partners."""
    cats = categorical_columns(df)[:max_cats]
    nums = numeric_columns(df)[:max_nums]
    nd = distinct_counts(df, cats, max_values)
    out = df
    for c in cats:
        if nd[c] > max_values:
            continue
        means = df.groupBy(c).agg(*[F.avg(n).alias(f"{c}_{n}_mean") for n in nums])
        out = out.join(means, out[c].eqNullSafe(means[c]), "left").drop(means[c])
    return out


# E3 -------------------------------------------------------------------------
def equal_width_bins(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 5,
                     min_distinct: int = 10) -> DataFrame:
    """pd.cut(bins=5, labels=False) for numeric columns with > 10 distinct values:
    right-closed bins, the lowest edge widened (SEM-7)."""
    cols = list(cols or numeric_columns(df))
    nd = distinct_counts(df, cols, min_distinct)
    use = [c for c in cols if nd[c] > min_distinct]
    if not use:
        return df
    r = df.agg(*[x for c in use for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]).collect()[0]
    new = []
    for c in use:
        lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
        w = (hi - lo) / bins
        b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col(c) - lo) / w) - 1)).cast("int")
        new.append(b.alias(f"{c}_binned"))
    return df.select("*", *new)


# E4 / E5 ---------------------------------------------------------------------
def text_features(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Length / word count / non-space character count for free-text columns."""
    from tidewater.operators.schema import free_text_flags
    cols = list(cols or categorical_columns(df))
    flags = {r["column"]: r["is_text"] for r in free_text_flags(df, cols).collect()}
    new = []
    for c in cols:
        if flags.get(c):
            tl = text_lengths(F.coalesce(F.col(c), F.lit("nan")))
            new += [tl["length"].alias(f"{c}_length"), tl["word_count"].alias(f"{c}_word_count"),
                    tl["char_count"].alias(f"{c}_char_count")]
    return df.select("*", *new)


def datetime_features(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: year, month, day, weekday, hour, quarter and cyclical month / day."""
    cols = list(cols or datetime_columns(df))
    new = []
    for c in cols:
        new += [v.alias(f"{c}_{k}") for k, v in date_parts(c).items()]
        new += [v.alias(f"{c}_{k}") for k, v in cyclical(c).items()]
    return df.select("*", *new)


# E6 / E7 / E8 ------------------------------------------------------------------------
def rank_distinct(values: DataFrame, order: str, out: str) -> DataFrame:
    """0-based rank of each row of a table of distinct ``order`` values, without a
    single-partition window: the table is range-partitioned on ``order`` (so
    partition ids are monotone in it) and ranked with block-prefix positions."""
    from tidewater.plans.ordered import add_positions
    n = max(1, values.sparkSession.sparkContext.defaultParallelism)
    ranged = values.repartitionByRange(n, order)
    return add_positions(ranged, [], [order], F.spark_partition_id(), out)


def factorize(df: DataFrame, col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """Integer code by first appearance along ``order``; null -> -1.

    The first position of each value is a grouped min (partial aggregation);
    codes are ranked on that per-value table only."""
    out = out or f"{col}_code"
    first = (df.where(F.col(col).isNotNull()).groupBy(col)
             .agg(F.min(F.struct(*[F.col(o) for o in order])).alias("_first")))
    codes = rank_distinct(first, "_first", out).select(col, out)
    return (df.join(codes, col, "left")
            .withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("long")))


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """code = rank of the value in sorted order (LabelEncoder)."""
    out = out or f"{col}_label"
    values = df.where(F.col(col).isNotNull()).select(col).distinct()
    return df.join(rank_distinct(values, col, out).select(col, out), col, "left")


def category_values(df: DataFrame, col: str, limit: int = 1000) -> list:
    vals = df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    if len(vals) > limit:
        raise ValueError(f"{col}: more than {limit} categories for one-hot")
    return sorted(r[0] for r in vals)


def one_hot(df: DataFrame, col: str, values: Sequence | None = None, drop: bool = True) -> DataFrame:
    """get_dummies(prefix=col) appended at the end; the source column dropped."""
    values = list(values if values is not None else category_values(df, col))
    dummies = [(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_{v}") for v in values]
    out = df.select("*", *[F.coalesce(d, F.lit(0)).alias(f"{col}_{v}") for d, v in zip(dummies, values)])
    return out.drop(col) if drop else out


def encode_auto(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """E6/E7 'auto': two values -> factorize; <= 10 -> one-hot; more -> factorize."""
    cats = categorical_columns(df)
    nd = distinct_counts(df, cats, 10)
    out = df
    for c in cats:
        if nd[c] == 2 or nd[c] > 10:
            out = factorize(out, c, order, out="_code").drop(c).withColumnRenamed("_code", c)
        else:
            out = one_hot(out, c)
    return out


# E9 / E10 / E11 ---------------------------------------------------------------------
def scale(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """standard: (x - mean) / population std (SEM-13), std 0 -> 0;
    minmax: (x - min) / (max - min), range 0 -> 0; robust: (x - median) / IQR, IQR 0 -> 1."""
    cols = list(cols or numeric_columns(df))
    exprs = {}
    if method == "standard":
        r = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))]).collect()[0]
        for c in cols:
            m, s = r[f"{c}__m"], r[f"{c}__s"]
            exprs[c] = (F.col(c) - m) / s if s else (F.col(c) - m) * 0.0
    elif method == "minmax":
        r = df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))]).collect()[0]
        for c in cols:
            lo, hi = r[f"{c}__lo"], r[f"{c}__hi"]
            exprs[c] = (F.col(c) - lo) / (hi - lo) if hi != lo else (F.col(c) - lo) * 0.0
    elif method == "robust":
        q = {x["column"]: x for x in quantile_wide(df, cols, [0.25, 0.5, 0.75], names=["q1", "q2", "q3"]).collect()}
        for c in cols:
            iqr = q[c]["q3"] - q[c]["q1"]
            exprs[c] = (F.col(c) - q[c]["q2"]) / (iqr if iqr else 1.0)
    else:
        raise ValueError(method)
    return df.select(*[exprs[c].cast("double").alias(c) if c in exprs else F.col(c) for c in df.columns])


# E12 -------------------------------------------------------------------------------
def transform_chain(df: DataFrame, order: Sequence[str], products: bool = False, interactions: bool = False,
                    binning: bool = False, text: bool = False, encode: bool = True,
                    scale_method: str | None = None, datetime: bool = True) -> DataFrame:
    out = df
    if products:
        out = pairwise_products(out)
    if interactions:
        out = category_mean_features(out)
    if binning:
        out = equal_width_bins(out)
    if text:
        out = text_features(out)
    if encode:
        out = encode_auto(out, order)
    if scale_method:
        out = scale(out, method=scale_method)
    if datetime:
        out = datetime_features(out)
    return out


# E13 / E14 / E15 / E16 -----------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact per-class test quota (round(n_c * test_size)) chosen by a seeded
    hash order. Positions inside each class come from the block-prefix helper, so
    a dominant class is still ranked in parallel."""
    h = F.abs(F.xxhash64(F.col(key), F.lit(seed)))
    withh = df.withColumn("_h", h)
    pos = add_positions(withh, [label], ["_h", key], F.floor(F.col("_h") / (1 << 50)), "_p")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return (pos.join(n, label)
            .withColumn("split", F.when(F.col("_p") < F.round(F.col("_n") * test_size), "test").otherwise("train"))
            .drop("_h", "_p", "_n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """E14: 'balanced' = n / (k * count_c)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).collect()[0]
    return counts.withColumn("weight", F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("count")))


def problem_type(df: DataFrame, target: str, max_classes: int = 10) -> DataFrame:
    """String or < 10 distinct numeric values -> classification, else regression."""
    is_num = target in numeric_columns(df)
    return df.agg(F.count_distinct(target).alias("n_distinct")).select(
        F.lit(target).alias("target"), "n_distinct",
        (F.when(F.col("n_distinct") < max_classes, "classification").otherwise("regression")
         if is_num else F.lit("classification")).alias("problem_type"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Value counts for a classification target, describe() for regression."""
    from tidewater.operators.profile import describe_numeric, value_counts
    kind = problem_type(df, target).collect()[0]["problem_type"]
    if kind == "classification":
        return value_counts(df, target, None).select(F.col("value").cast("string").alias("key"),
                                                     F.col("count").cast("double").alias("value"))
    d = describe_numeric(df, [target])
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    return d.select(F.explode(F.array(*[F.struct(F.lit(s).alias("key"), F.col(s).cast("double").alias("value"))
                                        for s in stats])).alias("s")).select("s.*")


def oversample(df: DataFrame, label: str) -> DataFrame:
    """M31 (re-aimed SMOTE): replicate rows of each class ceil(max / count) times."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    mx = counts.agg(F.max("_c")).collect()[0][0]
    reps = counts.select(label, F.ceil(F.lit(mx) / F.col("_c")).cast("int").alias("_r"))
    return (df.join(reps, label).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_r"))))
            .drop("_r"))


def smote(points: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority oversampling. ``points``: (id, vec array<double>, label).

    Every class grows to the size of the largest one: its missing rows are dealt
    evenly to its rows, in the order of a keyed hash of the id, the first of which take one
    more where it does not come out even. A new row lies between its row and one of the
    ``k`` exact nearest neighbours of the same class; which one, and how far along, are keyed hashes of
    (seed, id, copy). Returns (id, copy, label, nid, weight, vec): copy 0 is the
    row itself. A class of a single row is repeated (nid is null, weight 0). Rows without a label are kept and not
    copied. Ids are distinct; classes are few, their counts reach the driver.
    """
    from tidewater.operators.ml import nearest
    from tidewater.plans.ordered import add_positions

    def number(*parts) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")

    counts = {r[0]: r[1] for r in points.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    base = points.select("id", F.lit(0).alias("copy"), "label", F.lit(None).cast("long").alias("nid"), F.lit(0.0).alias("weight"), "vec")
    most = max(counts.values(), default=0)
    small = sorted(c for c, n in counts.items() if n < most)
    if not small:
        return base
    facts = points.sparkSession.createDataFrame([(c, i, counts[c]) for i, c in enumerate(small)], f"label {points.schema['label'].dataType.simpleString()}, nth int, n long")
    mine = points.select("id", "vec", "label").join(facts, "label")
    ranked = add_positions(mine.withColumn("h", number(F.col("id").cast("string"))), ["label"], ["h", "id"], F.floor(F.col("h") / 65536))
    missing = F.lit(most) - F.col("n")
    times = (F.floor(missing / F.col("n")) + (F.col("_pos") < missing % F.col("n")).cast("int")).cast("int")
    copies = ranked.select("id", "vec", "label", "n", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    alone = copies.where("n = 1").select("id", "copy", "label", F.lit(None).cast("long").alias("nid"), F.lit(0.0).alias("weight"), "vec")
    # one search for all classes: a further coordinate puts them farther apart than any two rows of a class are
    longest = points.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)))).first()[0]
    apart = F.concat("vec", F.array(F.col("nth") * float(4 * longest + 1)))
    found = nearest(mine.select("id", apart.alias("vec"), "label"), k, seed=seed).where(F.col("rn") <= F.lit(k))
    pairs = (found.join(mine.select(F.col("id").alias("qid"), F.col("label").alias("own"), "n"), "qid").where("label = own and rn <= n - 1")
             .select(F.col("qid").alias("id"), "rn", F.col("nid").cast("long").alias("nid")))
    said = [F.col("id").cast("string"), F.col("copy").cast("string")]
    near = F.least(F.lit(k), F.col("n") - 1)
    chosen = (copies.where("n > 1").withColumn("rn", (number(*said, F.lit("n")) % near + 1).cast("int"))
              .withColumn("weight", number(*said, F.lit("w")) / F.lit(4294967296.0)))
    ends = mine.select(F.col("id").alias("nid"), F.col("vec").alias("other"))
    between = F.zip_with("vec", "other", lambda x, y: x + F.col("weight") * (y - x))
    made = chosen.join(pairs, ["id", "rn"]).join(ends, "nid").select("id", "copy", "label", "nid", "weight", between.alias("vec"))
    return base.unionByName(alone).unionByName(made)
