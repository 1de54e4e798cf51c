"""Attach per-group statistics back to rows.

With group keys this is an equi-join on the keys (the statistics table has one
row per group; AQE broadcasts it when its runtime size is small). Without keys
the statistics are a single row: it is collected and inlined as literals, so
no keyless (cartesian) join is ever planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    keys = list(keys)
    if keys:
        return df.join(stats, keys, how)
    rows = stats.collect()
    if len(rows) > 1:
        raise ValueError("keyless statistics must be a single row")
    if not rows:
        return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in stats.dtypes])
    r = rows[0]
    return df.select("*", *[F.lit(r[c]).cast(t).alias(c) for c, t in stats.dtypes])
