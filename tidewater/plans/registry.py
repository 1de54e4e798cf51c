"""Named analyses (D1, D2, D4, D6): a registry name -> DataFrame function with
typed parameters, goal-based analysis plans with a status table, custom
vectorised functions and the n-gram table function."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidewater.session import staged


@dataclass
class Analysis:
    fn: Callable[..., DataFrame]
    params: dict[str, type] = field(default_factory=dict)
    description: str = ""


def _registry() -> dict[str, Analysis]:
    from tidewater.operators import charts, profile
    from tidewater.operators.clean import clean_chain
    return {
        "data_quality": Analysis(profile.quality_penalty, {}, "capped quality penalties"),
        "eda_summary": Analysis(profile.eda_summary, {}, "whole EDA summary"),
        "describe": Analysis(profile.describe_numeric, {"method": str}, "describe numeric columns"),
        "correlations": Analysis(profile.corr_matrix, {}, "Pearson correlation matrix"),
        "missing": Analysis(profile.missing_summary, {"only_missing": bool}, "missing values per column"),
        "outliers": Analysis(profile.outlier_report, {"k": float}, "IQR outlier report"),
        "histogram": Analysis(charts.histogram, {"col": str, "bins": int}, "chart data: histogram"),
        "clean": Analysis(clean_chain, {"missing": str, "outliers": str}, "cleaning chain"),
    }


def analyses() -> dict[str, Analysis]:
    return _registry()


def call(name: str, df: DataFrame, **params) -> DataFrame:
    """Run a registered analysis; unknown names and parameters are errors."""
    reg = _registry()
    if name not in reg:
        raise KeyError(f"unknown analysis {name!r}; known: {', '.join(sorted(reg))}")
    a = reg[name]
    for k, v in params.items():
        if k not in a.params:
            raise TypeError(f"{name}: unknown parameter {k!r}")
        if not isinstance(v, a.params[k]):
            raise TypeError(f"{name}: parameter {k!r} must be {a.params[k].__name__}")
    return a.fn(df, **params)


# Analysis plans per goal (ordered registry calls).
PLANS = {
    "comprehensive": ["data_quality", "missing", "describe", "correlations", "outliers", "eda_summary"],
    "quick_insights": ["missing", "describe"],
    "ml_focused": ["data_quality", "correlations", "outliers"],
    "default": ["data_quality", "describe"],
}


def run_plan(df: DataFrame, goal: str = "default") -> DataFrame:
    """Run the goal's steps in order; each step's status, row count and progress."""
    steps = PLANS.get(goal, PLANS["default"])
    rows = []
    for i, name in enumerate(steps, 1):
        try:
            n = staged(call(name, df), f"step_{i}").count()  # written, so that every column is computed
            rows.append((i, name, "completed", int(n), None, 100.0 * i / len(steps)))
        except Exception as e:  # noqa: BLE001 - reported as a status row
            rows.append((i, name, "failed", None, f"{type(e).__name__}: {e}"[:200], 100.0 * i / len(steps)))
    return df.sparkSession.createDataFrame(
        rows, "step int, analysis string, status string, n_rows long, error string, progress_pct double")


# --- D1: custom vectorised functions ---------------------------------------------------

_WS = re.compile(r"[ \t\n\r\f]+")


def _word_count(s: pd.Series) -> pd.Series:
    return s.fillna("").map(lambda x: len([w for w in _WS.split(x.strip(" \t\n\r\f")) if w])).astype("int32")


def word_count_udf():
    """Words separated by ASCII whitespace (Arrow batches, no per-row JVM round trip)."""
    return F.pandas_udf(_word_count, "int")


def register_function(spark: SparkSession, name: str, fn) -> None:
    """Make a (pandas) UDF callable from SQL by name."""
    spark.udf.register(name, fn)


# --- D6: n-grams as a table function ----------------------------------------------------------

class NGrams:
    """One row per n-gram of a space-separated token string (documents kept apart)."""

    def eval(self, text: str, n: int):
        if text is None:
            return
        toks = text.split(" ") if text else []
        yield from zip(map(" ".join, zip(*(toks[i:] for i in range(n)))), range(len(toks)))


def register_ngrams(spark: SparkSession, name: str = "ngrams") -> None:
    spark.udtf.register(name, udtf(NGrams, returnType="ngram: string, position: int", useArrow=True))
