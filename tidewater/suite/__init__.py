"""Registered queries: each key pairs a Spark callable ``(spark, sf_dir) -> DataFrame``
with an optional DuckDB oracle SQL string over the same Parquet tables.

Every query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MODULES = ("profile_q", "schema_q", "charts_q", "clean_q", "features_q", "windows_q",
           "joins_q", "functions_q", "io_q", "timeseries_q", "text_q", "ml_q", "metrics_q",
           "streaming_q", "registry_q", "sorts_q", "extras_q", "models_q")


def round6(c: F.Column) -> F.Column:
    """Six decimals as floor(x * 1e6 + 0.5000001) / 1e6 - the same IEEE steps the
    oracle SQL uses. The boundary sits 1e-13 above the decimal half-way point, so
    values that are exactly half-way in decimal (common for averages of
    two-decimal data) round the same way even when the two engines' sums differ
    in the last bit. ``+ 0.0`` turns -0.0 into 0.0."""
    x = c.cast("double")
    return F.when(F.abs(x) < 1e12, F.floor(x * 1e6 + 0.5000001) / 1e6).otherwise(x) + F.lit(0.0)


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so engines that sum in a different order still agree."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def register(name: str, sql: str | None = None, rounded: bool = True):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query key {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return finalize(df) if rounded else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_loaded = False


def load_all() -> None:
    global _loaded
    if _loaded:
        return
    for m in MODULES:
        importlib.import_module(f"tidewater.suite.{m}")
    _loaded = True
