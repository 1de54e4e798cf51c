"""Isolation forest (T12): rows that random cuts set apart early are anomalies.

Each tree sees 256 rows (the method's own sample size), drawn over the whole table: those with the
least hash of (id, tree). A row is offered to a tree if the hash is below a
bound that half as many rows again are expected to meet, so no row is copied for all
trees; the least ones are kept first in each task and then for the tree. A tree is grown in
its own group on the executors and comes back as a few hundred nodes. These are sent to all tasks
(at most 511 nodes a tree, whatever the table's size), where whole batches of rows walk down a tree level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EULER = 0.5772156649
SPAN = 1 << 40


def mean_path(n: np.ndarray | float):
    """The mean depth at which a search for one of ``n`` values ends unsuccessfully."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 1, 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n, 0.0)


def grow(x: np.ndarray, seed: int, limit: int) -> list[tuple[int, int, float, float]]:
    """The nodes (place, feature, threshold, path) of a tree; node i has its children at 2 i + 1 and 2 i + 2,
    a leaf has feature -1 and the path length of rows that end there."""
    rng, nodes, todo = np.random.default_rng(seed), [], [(0, 0, x)]
    while todo:
        place, depth, rows = todo.pop()
        varied = np.flatnonzero(rows.min(0) < rows.max(0)) if len(rows) > 1 and depth < limit else []
        if not len(varied):
            nodes.append((place, -1, 0.0, float(depth + mean_path(len(rows)))))
            continue
        f = int(rng.choice(varied))
        low, high = rows[:, f].min(), rows[:, f].max()
        cut = rng.uniform(low, high)
        left = rows[:, f] < cut
        if not left.any():  # the cut fell on the least value
            cut = np.nextafter(low, high)
            left = rows[:, f] < cut
        nodes.append((place, f, float(cut), 0.0))
        todo += [(2 * place + 1, depth + 1, rows[left]), (2 * place + 2, depth + 1, rows[~left])]
    return nodes


def forest(df: DataFrame, cols: Sequence[str], id_col: str, n_trees: int, sample_size: int, seed: int) -> DataFrame:
    """(tree, place, feature, threshold, path) of all trees, each grown in a group of its own."""
    n = df.count()
    m = min(sample_size, n)
    limit = max(1, math.ceil(math.log2(max(m, 2))))
    bound = min(SPAN, math.ceil(SPAN * 1.5 * m / max(n, 1)))
    values = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    key = lambda t: F.pmod(F.xxhash64(F.col("id"), t, F.lit(seed)), F.lit(SPAN))
    offered = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("tree"), key(t).alias("h"))), lambda s: s["h"] < bound)
    some = df.select(F.col(id_col).alias("id"), values).select("x", F.explode(offered).alias("s")).select("s.tree", "s.h", "x").withColumn("part", F.spark_partition_id())
    first = F.row_number().over(Window.partitionBy("tree", "part").orderBy("h", "x"))
    drawn = some.withColumn("r", first).where(F.col("r") <= m)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("h", "x"))).where(F.col("r") <= m)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        found = grow(np.stack(pdf.sort_values(["r"])["x"].to_numpy()).astype(float), seed * 1_000_003 + tree, limit)
        return pd.DataFrame([(tree, *node) for node in found], columns=["tree", "place", "feature", "threshold", "path"])

    return drawn.groupBy("tree").applyInPandas(one, "tree int, place int, feature int, threshold double, path double")


def paths(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The mean path length of each row; the arrays are (trees, places)."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for f, t, p in zip(feature, threshold, path):
        at = np.zeros(len(x), np.int64)
        while True:
            go = f[at] >= 0
            if not go.any():
                break
            at = np.where(go, 2 * at + 1 + (x[rows, np.maximum(f[at], 0)] >= t[at]), at)
        total += p[at]
    return total / len(feature)


def isolation_forest(df: DataFrame, cols: Sequence[str], id_col: str, n_trees: int = 100, sample_size: int = 256,
                     contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """The rows without a null in ``cols``, with anomaly_score (0 to 1, higher is stranger) and is_anomaly: the score is above its
    (1 - contamination) quantile. ``id_col`` tells rows apart; the draw and so the scores depend on it alone, not on the order of rows.
    An empty table gives no rows."""
    cols = list(cols)
    clean = df.dropna(subset=cols)
    nodes = forest(clean, cols, id_col, n_trees, sample_size, seed).toPandas()  # at most 2 * sample_size - 1 a tree
    if not len(nodes):
        return clean.withColumn("anomaly_score", F.lit(0.0)).withColumn("is_anomaly", F.lit(False))
    places = int(nodes["place"].max()) + 1
    trees = {t: i for i, t in enumerate(sorted(set(nodes["tree"])))}
    at = nodes["tree"].map(trees).to_numpy(), nodes["place"].to_numpy()
    feature, threshold, path = np.full((len(trees), places), -1), np.zeros((len(trees), places)), np.zeros((len(trees), places))
    feature[at], threshold[at], path[at] = nodes["feature"], nodes["threshold"], nodes["path"]
    drawn = min(sample_size, clean.count())
    shared = df.sparkSession.sparkContext.broadcast((feature, threshold, path, float(mean_path(drawn))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, t, p, usual = shared.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("__x").to_numpy(zero_copy_only=False)).astype(float)
                s = 2.0 ** (-paths(x, f, t, p) / usual) if usual > 0 else np.full(len(x), 0.5)
                yield batch.drop_columns(["__x"]).append_column("anomaly_score", pa.array(s))

    rows = clean.withColumn("__x", F.array(*[F.col(c).cast("double") for c in cols]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clean.schema.fields) + ", anomaly_score double"
    from tidewater.session import staged
    scored = staged(rows.mapInArrow(score, ddl), "scores")
    mark = scored.agg(F.percentile_approx("anomaly_score", 1.0 - contamination, 10000)).first()[0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(mark))
