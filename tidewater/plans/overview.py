"""The flagship report: "what is in this table and how good is it?".

Column profile + numeric description + IQR outliers + weighted quality score
as one long table (section, column, metric, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import profile as P
from tidewater.operators.schema import numeric_columns


def _long(df: DataFrame, section: str, metrics: list[str], column: str | None = "column") -> DataFrame:
    col = F.col(column) if column else F.lit(None).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                for m in metrics])).alias("s")
    return df.select(F.lit(section).alias("section"), col.alias("column"), cells).select(
        "section", "column", "s.metric", "s.value")


def table_overview(df: DataFrame) -> DataFrame:
    num = numeric_columns(df)
    prof = _long(P.column_profile(df), "profile", ["non_null", "nulls", "n_distinct", "null_pct"])
    desc = _long(P.describe_numeric(df, num), "describe",
                 ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])
    outl = _long(P.outlier_report(df, num), "outliers", ["n_outliers", "outlier_pct", "lower", "upper"])
    qual = _long(P.quality_weighted(df), "quality",
                 ["missing_ratio", "duplicate_ratio", "typed_share", "quality_score"], column=None)
    return prof.unionByName(desc).unionByName(outl).unionByName(qual)
