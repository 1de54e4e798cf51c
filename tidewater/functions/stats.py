"""Column expressions for statistics Spark defines differently from pandas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skewness_sample(x: Column) -> Column:
    """SEM-6: bias-corrected sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2); null for n < 3."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(x: Column) -> Column:
    """SEM-6: bias-corrected excess kurtosis G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6); null for n < 4."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
