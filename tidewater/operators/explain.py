"""Shapley values of tree models (M24): what each feature adds to a row's prediction.

The trees are read as a table of nodes. A leaf is reached over a path; for each
feature on it, the path asks for an interval (or a set of categories) and keeps a share of
the training rows. A feature that a coalition knows lets the row go on if it fits, any
other feature lets that share of the rows go on. So a leaf's part of the
Shapley value of feature i is

    value * (fits_i - share_i) * sum over the other features' subsets S of
        |S|! (d - |S| - 1)! / d! * product of fits in S * product of shares outside S

which is a polynomial in the number of known features. Rows that fit the same
features of a path have the same values, so they are worked out once for each pattern in a batch.
The values of a row add up to its prediction minus the mean over the training
rows. The model's nodes, which the driver holds anyway, are sent to the tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import shared_dir


@dataclass
class Leaf:
    """The features of a path, what it asks of them, the shares of rows that go on, and the leaf's part of the prediction."""
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    categories: list
    share: np.ndarray
    value: float


def node_table(model, spark) -> DataFrame:
    """(tree, node fields...) of a fitted MLlib tree model, one row a node."""
    path = f"{shared_dir(spark).rstrip('/')}/tidewater/models/{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        return data.select(F.col("treeID").alias("tree"), "nodeData.*")
    return data.select(F.lit(0).alias("tree"), *data.columns)


def _is_classifier(model) -> bool:
    """Whether the leaves hold class counts (boosted trees are regression trees in either case)."""
    return hasattr(model, "numClasses") and not type(model).__name__.startswith("GBT")


def leaves(model, spark, output: int = 1) -> tuple[list[Leaf], float]:
    """The leaves of all trees and the mean prediction. ``output``: the class whose probability is explained
    (of boosted classifiers the margin is explained, of regressions the prediction)."""
    trees: dict[int, dict[int, dict]] = {}
    for r in node_table(model, spark).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict(recursive=True)
    counted = _is_classifier(model)
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0] * len(trees)
    scale = 1.0 if type(model).__name__.startswith("GBT") else 1.0 / len(trees)
    found: list[Leaf] = []
    base = 0.0
    for number, nodes in trees.items():
        cover = {i: float(sum(n["impurityStats"]) if counted else n["impurityStats"][0]) for i, n in nodes.items()}
        factor = scale * weights[number]

        def value(n: dict) -> float:
            if not counted:
                return factor * n["prediction"]
            total = sum(n["impurityStats"])
            return factor * n["impurityStats"][output] / total if total else 0.0

        todo = [(0, {}, 1.0)]
        while todo:
            i, path, reached = todo.pop()
            n = nodes[i]
            if n["leftChild"] < 0:
                base += reached * value(n)
                keys = sorted(path)
                found.append(Leaf(np.array(keys, np.int64), np.array([path[f][0] for f in keys]), np.array([path[f][1] for f in keys]),
                                  [path[f][2] for f in keys], np.array([path[f][3] for f in keys]), value(n)))
                continue
            split = n["split"]
            feature, rule, kinds = split["featureIndex"], split["leftCategoriesOrThreshold"], split["numCategories"]
            for child, is_left in ((n["leftChild"], True), (n["rightChild"], False)):
                low, high, cats, share = path.get(feature, (-math.inf, math.inf, None, 1.0))
                if kinds < 0:  # a threshold: the left child takes what is not above it
                    low, high = (low, min(high, rule[0])) if is_left else (max(low, rule[0]), high)
                else:
                    side = set(rule) if is_left else set(map(float, range(kinds))) - set(rule)
                    cats = side if cats is None else cats & side
                part = cover[child] / cover[i]
                todo.append((child, path | {feature: (low, high, cats, share * part)}, reached * part))
    return found, base


def _pattern_values(fits: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The Shapley values of a leaf of value 1 for each pattern (row) of fits."""
    n, d = fits.shape
    weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.empty((n, d))
    for i in range(d):
        poly = np.zeros((n, d))
        poly[:, 0] = 1
        for j in range(d):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * share[j] + poly[:, :-1] * fits[:, j:j + 1]
                poly[:, 0] *= share[j]
        out[:, i] = (fits[:, i] - share[i]) * (poly @ weight)
    return out


def contributions(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """(rows, features) Shapley values of all rows."""
    out = np.zeros(x.shape)
    for leaf in found:
        d = len(leaf.features)
        if not d:
            continue
        v = x[:, leaf.features]
        fits = (v > leaf.low) & (v <= leaf.high)
        for j, cats in enumerate(leaf.categories):
            if cats is not None:
                fits[:, j] &= np.isin(v[:, j], list(cats))
        patterns, which = np.unique(fits, axis=0, return_inverse=True)
        values = leaf.value * _pattern_values(patterns.astype(float), leaf.share)
        out[:, leaf.features] += values[which.reshape(-1)]
    return out


def tree_explanations(model, data: DataFrame, id_col: str = "doc_id", features: str = "features", output: int = 1) -> DataFrame:
    """(id, base, contributions) of every row of ``data``: the mean prediction and each feature's Shapley value."""
    spark = data.sparkSession
    found, base = leaves(model, spark, output)
    shared = spark.sparkContext.broadcast(found)
    rows = data.select(F.col(id_col).alias("id"), vector_to_array(features).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("x").to_numpy(zero_copy_only=False)).astype(float)
                values = contributions(x, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(x), base)), pa.array(list(values), pa.list_(pa.float64()))],
                                                 names=["id", "base", "contributions"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, base double, contributions array<double>")


def tree_importance(explained: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean_abs_contribution), highest first."""
    spread = explained.select(F.posexplode("contributions").alias("i", "c")).groupBy("i").agg(F.avg(F.abs("c")).alias("mean_abs_contribution"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("feature")
    return spread.select(label, "mean_abs_contribution").orderBy(F.desc("mean_abs_contribution"), "feature")
