"""Cleaning operators.

Each step is "one statistics job, then a lazy projection": the statistics
(null shares, means, skews, modes, exact medians / quartiles) are a few
numbers per column, collected and inlined as literals. Steps that depend on
the previous step's output (outlier removal column after column) cut the
lineage with a reliable checkpoint between statistics jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalar import clean_text
from tidewater.functions.stats import skewness_sample
from tidewater.operators.schema import (CODE_RE, EMAIL_RE, PHONE_RE, categorical_columns,
                                        numeric_columns)
from tidewater.plans.quantiles import quantile_wide
from tidewater.session import cut_lineage


@dataclass
class CleanLog:
    """Step log (C12): (step, column, action, affected) rows."""
    rows: list[tuple] = field(default_factory=list)

    def add(self, step: str, column: str | None, action: str, affected: int) -> None:
        self.rows.append((len(self.rows) + 1, step, column, action, int(affected)))

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.rows, "seq long, step string, column string, action string, affected long")


# --- statistics --------------------------------------------------------------

def column_stats(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, dict]:
    """rows, nulls, mean and sample skew per column in one aggregate."""
    cols = list(cols or df.columns)
    num = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if c in num:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"{c}__mean"), skewness_sample(x).alias(f"{c}__skew")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in cols:
        out[c] = {"rows": r["__rows"], "nulls": r[f"{c}__nulls"], "numeric": c in num,
                  "mean": r[f"{c}__mean"] if c in num else None,
                  "skew": r[f"{c}__skew"] if c in num else None}
        out[c]["missing_pct"] = 100.0 * out[c]["nulls"] / out[c]["rows"] if out[c]["rows"] else 0.0
    return out


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-null value per column, ties -> smallest (SEM-4).

    Values are counted with one grouped aggregate per type family (numbers
    compared as numbers, strings as strings); only the winners come back."""
    out: dict[str, object] = {}
    num = set(numeric_columns(df))
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    for cast, member in (("bigint", whole), ("double", num - whole), ("string", set(df.columns) - num)):
        fam_cols = [c for c in cols if c in member]
        if not fam_cols:
            continue
        cells = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in fam_cols
        ])).alias("s")).select("s.*").where(F.col("value").isNotNull())
        counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        best = counts.groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))
        for r in best.collect():
            out[r["column"]] = r["mode"]
    return out


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    if not cols:
        return {}
    return {r["column"]: r["median"] for r in
            quantile_wide(df, cols, [0.5], names=["median"]).collect()}


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = []
    for c in df.columns:
        if c in values and values[c] is not None:
            v = values[c]
            lit = F.lit(v)
            if isinstance(types[c], (T.IntegerType, T.LongType, T.ShortType, T.ByteType)) and isinstance(v, float):
                exprs.append(F.coalesce(F.col(c).cast("double"), lit).alias(c))
            else:
                exprs.append(F.coalesce(F.col(c), lit.cast(types[c])).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


# --- C1 / C2 / C3 / C4: missing values -------------------------------------

def missing_plan(df: DataFrame, strategy: str = "auto", variant: str = "processor"):
    """Decide per column: drop it, or fill it with which statistic (and its value).

    auto: > 50 % null -> drop column; > 20 % -> 'advanced' (processor: median if
    |skew| > 1 else mean; staged: median); else mean. Strings -> mode or 'Unknown'.
    impute / mean / median / mode: that statistic for numbers (SEM-12), mode for strings.
    Returns (stats, columns to drop, {column: method}, {column: fill value})."""
    st = column_stats(df)
    cols_missing = [c for c in df.columns if st[c]["nulls"] > 0]
    to_drop, fill_how = [], {}
    for c in cols_missing:
        pct, is_num = st[c]["missing_pct"], st[c]["numeric"]
        if strategy == "auto" and pct > 50:
            to_drop.append(c)
            continue
        if not is_num:
            fill_how[c] = "mode"
        elif strategy == "auto" and pct > 20:
            if variant == "staged":
                fill_how[c] = "median"
            else:
                sk = st[c]["skew"]
                fill_how[c] = "median" if sk is not None and abs(sk) > 1 else "mean"
        elif strategy in ("auto", "impute", "mean"):
            fill_how[c] = "mean"
        elif strategy in ("median", "mode"):
            fill_how[c] = strategy
        else:
            raise ValueError(f"unknown missing strategy {strategy!r}")
    med = medians(df, [c for c, h in fill_how.items() if h == "median"])
    mod = modes(df, [c for c, h in fill_how.items() if h == "mode"])
    values = {}
    for c, how in fill_how.items():
        if how == "mean":
            values[c] = st[c]["mean"]
        elif how == "median":
            values[c] = med.get(c)
        else:
            values[c] = mod.get(c)
            if values[c] is None and not st[c]["numeric"]:
                values[c] = "Unknown"
    return st, to_drop, fill_how, values


def handle_missing(df: DataFrame, strategy: str = "auto", variant: str = "processor",
                   log: CleanLog | None = None) -> DataFrame:
    """C1 (variant='processor') / C3 (variant='staged'); 'drop' removes rows with
    a null in any column that has nulls."""
    if strategy == "drop":
        st = column_stats(df)
        cols_missing = [c for c in df.columns if st[c]["nulls"] > 0]
        if log:
            for c in cols_missing:
                log.add("missing", c, "drop_rows", st[c]["nulls"])
        return df.na.drop(subset=cols_missing) if cols_missing else df
    st, to_drop, fill_how, values = missing_plan(df, strategy, variant)
    if log:
        for c, how in fill_how.items():
            log.add("missing", c, how, st[c]["nulls"])
        for c in to_drop:
            log.add("missing", c, "drop_column", st[c]["nulls"])
    out = _fill(df, values)
    return out.drop(*to_drop) if to_drop else out


def fill_table(df: DataFrame, how: str) -> DataFrame:
    """C4: deep-learning preparation fills. mean/median: numeric columns only;
    mode: every column; drop: rows with any null. Columns without nulls are
    left exactly as they are (types included)."""
    if how == "drop":
        return df.na.drop(how="any")
    st = column_stats(df)
    holes = [c for c in df.columns if st[c]["nulls"] > 0]
    num = [c for c in numeric_columns(df) if c in holes]
    if how == "mean":
        return _fill(df, {c: st[c]["mean"] for c in num})
    if how == "median":
        return _fill(df, medians(df, num))
    if how == "mode":
        return _fill(df, modes(df, holes))
    raise ValueError(how)


# --- C5 / U1 ------------------------------------------------------------------

def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    log: CleanLog | None = None) -> DataFrame:
    """C5 / U1. Without an order column "keep first" equals "keep one" for
    whole-row duplicates, so this is a plain shuffle-dedup with map-side combine."""
    if log:
        n = df.count()
        out = df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()
        log.add("duplicates", None, "drop", n - out.count())
        return out
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


# --- C6 / C7 / C8: outliers ---------------------------------------------------

def iqr_limits(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    q = quantile_wide(df, cols, [0.25, 0.75], names=["q1", "q3"]).collect()
    return {r["column"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"])) for r in q}


def zscore_limits(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> dict[str, tuple[float, float]]:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s")]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[f"{c}__m"] - z * r[f"{c}__s"], r[f"{c}__m"] + z * r[f"{c}__s"])
            for c in cols if r[f"{c}__s"] is not None}


def _clip_expr(c: str, lo: float, hi: float, cast_double: bool) -> F.Column:
    x = F.col(c).cast("double") if cast_double else F.col(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def cap_outliers(df: DataFrame, cols: Sequence[str] | None = None, method: str = "iqr",
                 log: CleanLog | None = None) -> DataFrame:
    """C6 (iqr) / C7 (zscore): clip each numeric column to its bounds; nulls stay null."""
    cols = list(cols or numeric_columns(df))
    limits = iqr_limits(df, cols) if method == "iqr" else zscore_limits(df, cols)
    if log:
        aggs = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in limits.items()]
        r = df.agg(*aggs).collect()[0]
        for c in limits:
            log.add("outliers", c, f"cap_{method}", r[c])
    return df.select(*[_clip_expr(c, *limits[c], cast_double=True).alias(c) if c in limits else F.col(c)
                       for c in df.columns])


def remove_outliers(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
                    min_count: int = 0, log: CleanLog | None = None) -> DataFrame:
    """C8 (SEM-10, SEM-11): column after column, bounds of column k use the rows that
    survived column k-1; rows with a null in the column survive."""
    cols = list(cols or numeric_columns(df))
    cur = df
    for c in cols:
        if min_count:
            n = cur.agg(F.count(c)).collect()[0][0]
            if n < min_count:
                continue
        lim = iqr_limits(cur, [c], k)
        if c not in lim:
            continue
        lo, hi = lim[c]
        x = F.col(c)
        mask = F.coalesce((x < lo) | (x > hi), F.lit(False))
        if log:
            log.add("outliers", c, "remove", cur.where(mask).count())
        cur = cur.where(~mask)  # bounds are literals: one growing filter over the source, nothing is written
    return cur


# --- C9: text columns -------------------------------------------------------------

def structured_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    if not cols:
        return set()
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs.append(F.max(v.rlike(EMAIL_RE) | (v.rlike(PHONE_RE) & (F.length(v) > 7)) | v.rlike(CODE_RE))
                    .alias(c))
    r = df.agg(*aggs).collect()[0]
    return {c for c in cols if r[c]}


def clean_text_columns(df: DataFrame, cols: Sequence[str] | None = None, remove_special: bool = False,
                       remove_numbers: bool = False, lowercase: bool = True) -> DataFrame:
    """Clean every string column that does not look structured; nulls stay null."""
    cols = list(cols or categorical_columns(df))
    skip = structured_columns(df, cols)
    exprs = []
    for c in df.columns:
        if c in cols and c not in skip:
            exprs.append(F.when(F.col(c).isNull(), F.lit(None)).otherwise(
                clean_text(c, remove_special, remove_numbers, lowercase)).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


# --- C10 / C11: chains ---------------------------------------------------------------

def clean_chain(df: DataFrame, missing: str = "auto", duplicates: bool = True,
                outliers: str | None = "iqr", standardize: bool = True, text: bool = True,
                log: CleanLog | None = None) -> DataFrame:
    """Missing -> duplicates -> outliers -> types -> text (SEM-12: steps are flags)."""
    from tidewater.operators.schema import standardize_types
    out = handle_missing(df, missing, "processor", log) if missing else df
    if duplicates:
        out = cut_lineage(drop_duplicates(out, log=log))
    if outliers in ("iqr", "zscore"):
        out = cap_outliers(out, method=outliers, log=log)
    elif outliers == "remove":
        out = remove_outliers(out, log=log)
    if standardize:
        out = standardize_types(out)
    if text:
        out = clean_text_columns(out)
    return out


def preprocess(df: DataFrame, strategy: str = "conservative", log: CleanLog | None = None) -> DataFrame:
    """C11: staged preprocessing: missing -> duplicates -> types -> outliers (cap when conservative,
    sequential removal when aggressive; columns with < 10 values skipped)."""
    from tidewater.operators.schema import standardize_types
    out = handle_missing(df, "auto", "staged", log)
    out = cut_lineage(drop_duplicates(out, log=log))
    out = standardize_types(out)
    num = numeric_columns(out)
    if strategy == "conservative":
        counts = out.agg(*[F.count(c).alias(c) for c in num]).collect()[0]
        return cap_outliers(out, [c for c in num if counts[c] >= 10], "iqr", log)
    if strategy == "aggressive":
        return remove_outliers(out, num, min_count=10, log=log)
    raise ValueError(strategy)
