"""Schema walks and column-type decisions.

Decisions are aggregates over *all* rows (never a head sample); each is one
fused aggregate job whose single result row is the only thing the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalar import EMAIL_VALID_RE

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*categorical_columns(df))


def select_datetime(df: DataFrame) -> DataFrame:
    return df.select(*datetime_columns(df))


def dtype_name(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of populated columns (at least one non-null value) per declared
    type; one fused count over the table decides which columns count."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(types[c]).alias("dtype"), F.col(f"`{c}`").alias("n"))
                                for c in df.columns]))
    return (wide.select(cells.alias("s")).where(F.col("s.n") > 0)
            .groupBy(F.col("s.dtype").alias("dtype")).agg(F.count(F.lit(1)).alias("n_columns")))


def validate_rows(df: DataFrame, min_rows: int = 1, min_cols: int = 1) -> DataFrame:
    """Guard. Counts at most ``min_rows`` rows (limit short-circuits the scan)."""
    seen = df.limit(min_rows).agg(F.count(F.lit(1)).alias("rows_seen"))
    return seen.select(
        "rows_seen",
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        ((F.col("rows_seen") >= min_rows) & F.lit(len(df.columns) >= min_cols)).alias("valid"))


# Patterns of the structured-column test (e-mail, phone, code).
EMAIL_RE = EMAIL_VALID_RE
PHONE_RE = r"^[0-9\s\-\+\(\)]+$"  # plus: length > 7
CODE_RE = r"^[A-Z]{2,4}[0-9]{4,8}$"


def structured_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per string column, does any value look like an e-mail / phone / code."""
    aggs = []
    for c in cols:
        v = F.col(c)
        aggs += [F.max(v.rlike(EMAIL_RE)).alias(f"{c}__email"),
                 F.max(v.rlike(PHONE_RE) & (F.length(v) > 7)).alias(f"{c}__phone"),
                 F.max(v.rlike(CODE_RE)).alias(f"{c}__code")]
    wide = df.agg(*aggs)
    return _stack(wide, cols, ["email", "phone", "code"], "boolean").select(
        "column", F.coalesce("email", F.lit(False)).alias("has_email"),
        F.coalesce("phone", F.lit(False)).alias("has_phone"),
        F.coalesce("code", F.lit(False)).alias("has_code"),
        (F.coalesce("email", F.lit(False)) | F.coalesce("phone", F.lit(False))
         | F.coalesce("code", F.lit(False))).alias("is_structured"))


def free_text_flags(df: DataFrame, cols: Sequence[str], min_avg_len: float = 20.0,
                    min_unique_ratio: float = 0.5) -> DataFrame:
    """Avg length > 20 and unique ratio > 0.5 over non-null values."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.length(c)).alias(f"{c}__avg_len"),
                 F.count(c).alias(f"{c}__n"),
                 F.count_distinct(c).alias(f"{c}__n_distinct")]
    wide = df.agg(*aggs)
    long = _stack(wide, cols, ["avg_len", "n", "n_distinct"], "double")
    ratio = F.col("n_distinct") / F.col("n")
    return long.select(
        "column", "avg_len", ratio.alias("unique_ratio"),
        ((F.col("avg_len") > min_avg_len) & (ratio > min_unique_ratio)).alias("is_text"))


def _stack(wide: DataFrame, cols: Sequence[str], metrics: Sequence[str], cast: str) -> DataFrame:
    """Unpivot a one-row ``{col}__{metric}`` aggregate into (column, metric...)."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"`{c}__{m}`").cast(cast).alias(m) for m in metrics])
               for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


# --- P10 / P11 / P14: type inference over string-typed columns -------------

def _parse_counts(c: str):
    v = F.trim(F.col(c))
    num = v.try_cast("double")
    ts = F.try_to_timestamp(v)
    lower = F.lower(v)
    boolish = lower.isin("true", "false")
    return [F.count(v).alias(f"{c}__n"),
            F.count_if(boolish).alias(f"{c}__n_bool"),
            F.count(num).alias(f"{c}__n_num"),
            F.count_if(num.isNotNull() & (num == F.floor(num))).alias(f"{c}__n_int"),
            F.count(ts).alias(f"{c}__n_ts"),
            F.count_distinct(v).alias(f"{c}__n_distinct"),
            F.avg(F.length(v)).alias(f"{c}__avg_len"),
            F.min(num).alias(f"{c}__min_num"),
            F.max(num).alias(f"{c}__max_num")]


PARSE_METRICS = ["n", "n_bool", "n_num", "n_int", "n_ts", "n_distinct", "avg_len",
                 "min_num", "max_num"]


def parse_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = [a for c in cols for a in _parse_counts(c)]
    return _stack(df.agg(*aggs), cols, PARSE_METRICS, "double")


def semantic_type_expr() -> F.Column:
    """SEM-1 order for string columns: boolean -> number -> timestamp -> categorical -> text -> mixed."""
    n = F.col("n")
    return (F.when(n == 0, "empty")
            .when(F.col("n_bool") == n, "boolean")
            .when(F.col("n_int") == n, "integer")
            .when(F.col("n_num") == n, "float")
            .when(F.col("n_ts") == n, "datetime")
            .when(F.col("n_distinct") / n < 0.5, "categorical")
            .when(F.col("avg_len") > 50, "text")
            .otherwise("mixed"))


def detect_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P10: semantic type per column. Declared non-string types decide directly."""
    cols = list(cols or df.columns)
    declared = {f.name: f.dataType for f in df.schema.fields}
    string_cols = [c for c in cols if isinstance(declared[c], T.StringType)]
    spark = df.sparkSession
    fixed = []
    for c in cols:
        t = declared[c]
        if isinstance(t, T.StringType):
            continue
        kind = ("boolean" if isinstance(t, T.BooleanType) else
                "integer" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else
                "float" if isinstance(t, NUMERIC) else
                "datetime" if isinstance(t, DATETIME) else "mixed")
        fixed.append((c, kind))
    parts = []
    if string_cols:
        prof = parse_profile(df, string_cols)
        parts.append(prof.select("column", semantic_type_expr().alias("semantic_type")))
    if fixed:
        parts.append(spark.createDataFrame(fixed, "column string, semantic_type string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def narrow_int_type(lo: float, hi: float) -> str:
    """Smallest signed integer type holding [lo, hi] (no unsigned types in Spark)."""
    for name, bound in (("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31)):
        if -bound <= lo and hi < bound:
            return name
    return "bigint"


def standardize_types(df: DataFrame, cols: Sequence[str] | None = None,
                      downcast: bool = False) -> DataFrame:
    """P11 (SEM-2): a string column is cast only if *every* non-null value parses.

    Decide-then-project: one aggregate job decides, the cast is a lazy projection.
    """
    cols = [c for c in (cols or df.columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not cols:
        return df
    decisions = {r["column"]: r for r in parse_profile(df, cols).collect()}
    exprs = []
    for c in df.columns:
        d = decisions.get(c)
        if d is None or d["n"] == 0:
            exprs.append(F.col(c))
            continue
        v = F.trim(F.col(c))
        if d["n_int"] == d["n"] and -2.0 ** 63 <= d["min_num"] and d["max_num"] < 2.0 ** 63:
            target = narrow_int_type(d["min_num"], d["max_num"]) if downcast else "bigint"
            # whole numbers keep all digits; forms like 1e3 go through a decimal, never through a double
            exprs.append(F.coalesce(v.try_cast("bigint"), v.try_cast("decimal(38,6)").try_cast("bigint")).cast(target).alias(c))
        elif d["n_num"] == d["n"]:
            exprs.append(v.try_cast("double").alias(c))
        elif d["n_ts"] == d["n"]:
            exprs.append(F.try_to_timestamp(v).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def type_decisions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P11 decision table: (column, target_type)."""
    prof = parse_profile(df, cols)
    n = F.col("n")
    return prof.select(
        "column",
        F.when(n == 0, "string")
        .when(F.col("n_int") == n, "bigint")
        .when(F.col("n_num") == n, "double")
        .when(F.col("n_ts") == n, "timestamp")
        .otherwise("string").alias("target_type"))


def type_issues(df: DataFrame) -> DataFrame:
    """Mixed parse classes in string columns; numeric columns that look categorical
    (unique ratio over all rows < 0.05 and more than 2 values)."""
    num = numeric_columns(df)
    strs = categorical_columns(df)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in num:
        aggs.append(F.count_distinct(c).alias(f"{c}__nd"))
    for c in strs:
        v = F.col(c)
        aggs += [F.count(v).alias(f"{c}__n"), F.count(v.try_cast("double")).alias(f"{c}__nn")]
    wide = df.agg(*aggs)
    parts = []
    for c in num:
        nd, rows = F.col(f"{c}__nd"), F.col("__rows")
        parts.append(F.struct(F.lit(c).alias("column"),
                              F.when((nd / rows < 0.05) & (nd > 2),
                                     F.lit("numeric_looks_categorical")).alias("issue")))
    for c in strs:
        n, nn = F.col(f"{c}__n"), F.col(f"{c}__nn")
        parts.append(F.struct(F.lit(c).alias("column"),
                              F.when((nn > 0) & (nn < n), F.lit("mixed_types")).alias("issue")))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, issue string")
    return wide.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(
        F.col("issue").isNotNull())


def analysis_type(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """P15: 'text' if the mean length of the first text column exceeds 50, else 'eda'."""
    if not text_cols:
        return df.sparkSession.createDataFrame([("eda",)], "analysis_type string")
    return df.agg(F.avg(F.length(text_cols[0])).alias("avg_len")).select(
        "avg_len", F.when(F.col("avg_len") > 50, "text").otherwise("eda").alias("analysis_type"))


def default_target(df: DataFrame) -> str | None:
    """The analysis plan's target choice - the last numeric column."""
    nums = numeric_columns(df)
    return nums[-1] if nums else None
