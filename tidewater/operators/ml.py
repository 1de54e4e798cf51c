"""Machine learning (M1-M14, M19-M28, M30) with Spark MLlib estimators.

Data preparation is a Pipeline (StringIndexer -> VectorAssembler ->
StandardScaler) fitted on the training split only (SEM-21). Models are MLlib
estimators (distributed training); the exact k-nearest-neighbour and DBSCAN
operators look at all pairs, a tile of two groups of points at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import (ClusteringEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.features import stratified_split
from tidewater.operators.schema import categorical_columns, numeric_columns
from tidewater.plans import tiles
from tidewater.plans.graph import components
from tidewater.session import cut_lineage, shared_dir


# --- M1: setup ----------------------------------------------------------------------

def problem_type_of(df: DataFrame, target: str) -> str:
    """Classification when the target is a string, has < 20 values, or is integral with
    fewer distinct values than 5 % of the rows."""
    r = df.agg(F.count_distinct(target).alias("nd"), F.count(F.lit(1)).alias("n")).collect()[0]
    dt = dict(df.dtypes)[target]
    if dt == "string" or r["nd"] < 20 or (dt in ("int", "bigint") and r["nd"] < 0.05 * r["n"]):
        return "classification"
    return "regression"


def setup(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = 42):
    """Returns (train, test, prep PipelineModel, feature names, problem type).
    Train / test carry ``features`` (scaled vector) and ``label``."""
    kind = problem_type_of(df, target)
    feats = [c for c in df.columns if c not in (target, key)]
    cats = [c for c in feats if c in categorical_columns(df)]
    nums = [c for c in feats if c in numeric_columns(df)]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                            stringOrderType="alphabetAsc") for c in cats]
    if kind == "classification" and dict(df.dtypes)[target] == "string":
        stages.append(StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"))
        lab = None
    else:
        lab = F.col(target).cast("double").alias("label")
    names = nums + [f"{c}__idx" for c in cats]
    stages += [VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="keep"),
               StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    base = df if lab is None else df.withColumn("label", lab)
    if kind == "classification":
        split = stratified_split(base, target, key, test_size, seed)
    else:
        split = base.withColumn("split", F.when(F.abs(F.xxhash64(key, F.lit(seed))) % 1000 < test_size * 1000,
                                                "test").otherwise("train"))
    split = cut_lineage(split)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    prep = Pipeline(stages=stages).fit(train)
    return prep.transform(train), prep.transform(test), prep, names, kind


# --- M2-M10: estimators ----------------------------------------------------------------

def estimator(name: str, kind: str, n_classes: int = 2):
    """Canonical model names (SEM-24) -> MLlib estimator."""
    if kind == "classification":
        binary = n_classes <= 2
        table = {
            "logistic": lambda: LogisticRegression(maxIter=1000),
            "random_forest": lambda: RandomForestClassifier(numTrees=100, seed=42),
            "gradient_boosting": lambda: (GBTClassifier(maxIter=50, maxDepth=3, stepSize=0.1, seed=42) if binary else
                                          OneVsRest(classifier=GBTClassifier(maxIter=50, maxDepth=3, seed=42))),
            "svm": lambda: (LinearSVC(maxIter=100) if binary else OneVsRest(classifier=LinearSVC(maxIter=100))),
            "naive_bayes": lambda: NaiveBayes(modelType="gaussian"),
            "decision_tree": lambda: DecisionTreeClassifier(seed=42),
        }
    else:
        table = {
            "linear": lambda: LinearRegression(),
            "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
            "lasso": lambda: LinearRegression(regParam=1.0, elasticNetParam=1.0),
            "elastic_net": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.5),
            "random_forest": lambda: RandomForestRegressor(numTrees=100, seed=42),
            "gradient_boosting": lambda: GBTRegressor(maxIter=50, maxDepth=3, seed=42),
            "decision_tree": lambda: DecisionTreeRegressor(seed=42),
        }
    if name not in table:
        raise ValueError(f"unknown model {name!r} for {kind}")
    return table[name]()


def mlp(n_features: int, n_classes: int, hidden: Sequence[int] = (64, 32)):
    """Multilayer perceptron classifier."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=200, seed=42)


def evaluate(pred: DataFrame, kind: str) -> dict[str, float]:
    if kind == "classification":
        ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
        return {m: ev.setMetricName(m).evaluate(pred) for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")}
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    return {m: ev.setMetricName(m).evaluate(pred) for m in ("r2", "rmse", "mae", "mse")}


def compare(train: DataFrame, test: DataFrame, kind: str, names: Sequence[str], n_classes: int = 2) -> DataFrame:
    """M2: fit each model on the (cached) split; a model that fails raises."""
    train = train.select("features", "label").cache()
    rows = []
    for name in names:
        model = estimator(name, kind, n_classes).fit(train)
        m = evaluate(model.transform(test), kind)
        rows.append((name, m.get("accuracy") if kind == "classification" else m["r2"],
                     m.get("f1") if kind == "classification" else m["rmse"]))
    train.unpersist()
    spark = test.sparkSession
    primary, secondary = ("accuracy", "f1") if kind == "classification" else ("r2", "rmse")
    return spark.createDataFrame(rows, f"model string, {primary} double, {secondary} double") \
        .orderBy(F.desc_nulls_last(primary))


def cross_validate(train: DataFrame, est, kind: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """K-fold CV with a deterministic fold column; mean and std of the metric."""
    metric = "accuracy" if kind == "classification" else "r2"
    ev = (MulticlassClassificationEvaluator(metricName=metric) if kind == "classification"
          else RegressionEvaluator(metricName=metric))
    cv = CrossValidator(estimator=est, estimatorParamMaps=[{}], evaluator=ev, numFolds=folds, seed=seed)
    model = cv.fit(train.select("features", "label"))
    spark = train.sparkSession
    std = model.stdMetrics[0] if model.stdMetrics else None
    return spark.createDataFrame([(metric, float(model.avgMetrics[0]), None if std is None else float(std), folds)],
                                 "metric string, mean double, std double, folds int")


def grid_search(train: DataFrame, kind: str, folds: int = 3, parallelism: int = 4) -> DataFrame:
    """3-fold grid search over a random forest's depth and size."""
    rf = estimator("random_forest", kind)
    grid = (ParamGridBuilder().addGrid(rf.maxDepth, [3, 5]).addGrid(rf.numTrees, [20, 50]).build())
    metric = "accuracy" if kind == "classification" else "r2"
    ev = (MulticlassClassificationEvaluator(metricName=metric) if kind == "classification"
          else RegressionEvaluator(metricName=metric))
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, seed=42,
                        parallelism=parallelism)
    model = cv.fit(train.select("features", "label"))
    rows = [(int(p[rf.maxDepth]), int(p[rf.numTrees]), float(m)) for p, m in zip(grid, model.avgMetrics)]
    return train.sparkSession.createDataFrame(rows, f"max_depth int, num_trees int, {metric} double")


# --- M21-M24: feature selection / importance / explanations ---------------------------------

def anova_f(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """One-way ANOVA F per feature from grouped sums (one aggregate)."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                              *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)],
                              *[F.sum(F.col(c) * F.col(c)).alias(f"q_{i}") for i, c in enumerate(cols)])
    tot = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
                *[F.sum(f"s_{i}").alias(f"S_{i}") for i in range(len(cols))],
                *[F.sum(f"q_{i}").alias(f"Q_{i}") for i in range(len(cols))],
                *[F.sum(F.col(f"s_{i}") * F.col(f"s_{i}") / F.col("n")).alias(f"B_{i}") for i in range(len(cols))])
    structs = []
    for i, c in enumerate(cols):
        ssb = F.col(f"B_{i}") - F.col(f"S_{i}") * F.col(f"S_{i}") / F.col("N")
        ssw = F.col(f"Q_{i}") - F.col(f"B_{i}")
        f = (ssb / (F.col("k") - 1)) / (ssw / (F.col("N") - F.col("k")))
        structs.append(F.struct(F.lit(c).alias("feature"), f.alias("f_score")))
    return tot.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def importance(model, names: Sequence[str], top: int = 20) -> pd.DataFrame:
    """Tree importances or absolute coefficients, top ``top``."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray()
    else:
        coef = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else model.coefficients.toArray()
        vals = np.abs(np.atleast_2d(coef)).mean(axis=0)
    pdf = pd.DataFrame({"feature": list(names), "importance": vals[:len(names)]})
    return pdf.sort_values(["importance", "feature"], ascending=[False, True]).head(top)


def rfe(train: DataFrame, names: Sequence[str], kind: str, keep: int = 3, trees: int = 50) -> DataFrame:
    """Recursive elimination: fit a 50-tree forest, drop the weakest feature, repeat;
    rank 1 = kept."""
    arr = train.select(vector_to_array("features").alias("a"), "label").cache()
    remaining = list(range(len(names)))
    ranks = {}
    rank = len(names) - keep + 1
    while len(remaining) > keep:
        sub = arr.select(array_to_vector(F.array(*[F.col("a")[i] for i in remaining])).alias("features"), "label")
        est = (RandomForestClassifier if kind == "classification" else RandomForestRegressor)(numTrees=trees, seed=42)
        imp = est.fit(sub).featureImportances.toArray()
        weakest = int(np.argmin(imp))
        ranks[names[remaining[weakest]]] = rank
        rank -= 1
        remaining.pop(weakest)
    for i in remaining:
        ranks[names[i]] = 1
    arr.unpersist()
    return train.sparkSession.createDataFrame(sorted(ranks.items(), key=lambda kv: (kv[1], kv[0])),
                                              "feature string, rank int")


def linear_explanations(model, data: DataFrame, names: Sequence[str]) -> DataFrame:
    """M24 (linear models): mean |w_j (x_j - mean_j)| per feature, exact, one aggregate."""
    coef = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else \
        np.atleast_2d(model.coefficients.toArray())
    w = np.abs(coef).mean(axis=0)
    arr = data.select(vector_to_array("features").alias("a"))
    means = arr.agg(*[F.avg(F.col("a")[i]).alias(f"m{i}") for i in range(len(names))]).collect()[0]
    agg = arr.agg(*[F.avg(F.abs((F.col("a")[i] - means[f"m{i}"]) * float(w[i]))).alias(f"c{i}")
                    for i in range(len(names))]).collect()[0]
    rows = sorted(((n, float(agg[f"c{i}"])) for i, n in enumerate(names)), key=lambda r: (-r[1], r[0]))
    return data.sparkSession.createDataFrame(rows, "feature string, mean_abs_contribution double")


# --- M25: ensembles -----------------------------------------------------------------------

def vote(preds: DataFrame, key: str, kind: str, how: str = "hard") -> DataFrame:
    """(key, model, prediction[, probability]) -> ensemble prediction per key.
    hard: most common prediction (ties -> smallest); soft: mean probability arg-max;
    regression: mean."""
    if kind == "regression":
        return preds.groupBy(key).agg(F.avg("prediction").alias("prediction"))
    if how == "soft":
        probs = preds.select(key, F.posexplode(vector_to_array("probability")).alias("cls", "p"))
        m = probs.groupBy(key, "cls").agg(F.avg("p").alias("p"))
        return m.groupBy(key).agg(F.min_by("cls", F.struct(-F.col("p"), F.col("cls"))).cast("double").alias("prediction"))
    c = preds.groupBy(key, "prediction").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(key).agg(F.min_by("prediction", F.struct(-F.col("c"), F.col("prediction"))).alias("prediction"))


# --- M11-M14, M30: clustering / PCA -------------------------------------------------------

def vectors(df: DataFrame, col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(col).cast("array<double>")))


def kmeans(df: DataFrame, k: int = 10, seed: int = 42):
    """All rows (SEM-22); returns (model, assignments)."""
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df)
    return model, model.transform(df)


def bisecting(df: DataFrame, k: int = 10, seed: int = 42):
    """M13 (re-aimed hierarchical): divisive k-means + silhouette (squared Euclidean)."""
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(df)
    out = model.transform(df)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)
    return model, out, sil


def cluster_summary(assigned: DataFrame, centers: Sequence, key: str = "cluster") -> DataFrame:
    """Members per cluster + centre coordinates (as an array)."""
    spark = assigned.sparkSession
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(centers)],
                              f"{key} int, center array<double>")
    return assigned.groupBy(key).agg(F.count(F.lit(1)).alias("members")).join(c, key)


def pca(df: DataFrame, k: int = 2):
    """Standardise (with mean), project; explained and cumulative ratio."""
    sc = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(df)
    z = sc.transform(df)
    model = PCA(k=k, inputCol="z", outputCol="pcs").fit(z)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    cum = list(np.cumsum(ev))
    spark = df.sparkSession
    var = spark.createDataFrame([(i + 1, ev[i], float(cum[i])) for i in range(k)],
                                "component int, explained_ratio double, cumulative_ratio double")
    return model.transform(z), var


# --- M7 / M12: exact neighbourhoods, tile by tile -----------------------------------------------

def _euclid(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(points: DataFrame, k: int = 5, n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """(qid, nid, label, dist, rn): the exact ``k`` nearest neighbours of every point, itself
    excluded, by distance and then id. ``points``: (id long, vec array<double>, label).

    Every tile of two groups of points (``plans.tiles``) gives the k nearest of each
    point in the other group; the k nearest of these are kept. ``n_pivots``: the number of groups."""
    groups = n_pivots or tiles.groups_for(points.count())
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("id", "label")}

    def side(a: tiles.Points, b: tiles.Points) -> pa.Table:
        i, j, far = tiles.closest(a, b, k)
        # rows of an id that repeats count once for each of them
        _, which, times = np.unique(a.ids, return_inverse=True, return_counts=True)
        again = np.repeat(np.arange(len(i)), times[which[i]])
        i, j, far = i[again], j[again], far[again]
        return pa.table({"qid": a.table["id"].take(pa.array(i)), "nid": b.table["id"].take(pa.array(j)),
                         "label": b.table["label"].take(pa.array(j)), "dist": far})

    def work(a: tiles.Points, b: tiles.Points) -> pa.Table:
        return side(a, b) if a is b else pa.concat_tables([side(a, b), side(b, a)])
    found = tiles.tiled(points.select("id", "vec", "label"), groups, work, f"qid {kinds['id']}, nid {kinds['id']}, label {kinds['label']}, dist double", seed)
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "nid"))).where(F.col("rn") <= k)


def knn_exact(points: DataFrame, k: int = 5, n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """M7: exact k nearest neighbours and majority-vote prediction (ties -> smallest label)."""
    top = nearest(points, k, n_pivots, seed)
    votes = top.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("c"))
    pred = votes.groupBy("qid").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("predicted"))
    return pred.withColumnRenamed("qid", "id")


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, n_pivots: int | None = None,
           seed: int = 42) -> DataFrame:
    """Core points have >= min_samples neighbours within eps (self included);
    clusters are the connected components of core points, named by their smallest
    id; border points join the smallest adjacent cluster; the rest is noise (-1).

    Pairs are never listed: tiles (``plans.tiles``, ``n_pivots`` groups) count each point's neighbours, then give links
    that join what all pairs of core points join, fewer than a tile's points, and last the least cluster near each other point.
    Components come from star contraction, which ends at the fixed point."""
    groups = n_pivots or tiles.groups_for(points.count())
    pts = points.select("id", "vec")

    def count(a: tiles.Points, b: tiles.Points) -> pa.Table:
        rows, columns = [], np.zeros(b.n, int)
        for _, near in tiles.within(a, b, eps):
            rows.append(near.sum(1))
            columns += near.sum(0)
        parts = [(a, np.concatenate(rows))] + ([] if a is b else [(b, columns)])
        return pa.concat_tables([pa.table({"id": p.ids, "deg": n.astype("int64")}) for p, n in parts])
    deg = tiles.tiled(pts, groups, count, "id long, deg long", seed).groupBy("id").agg(F.sum("deg").alias("deg"))
    core = cut_lineage(points.select("id").join(deg, "id", "left").where(
        F.coalesce("deg", F.lit(0)) + 1 >= min_samples).select("id"))

    def link(a: tiles.Points, b: tiles.Points) -> pa.Table:
        i, j = tiles.linked(a, b, eps)
        return pa.table({"a": a.ids[i], "b": b.ids[j]})
    linked = components(tiles.tiled(pts.join(core, "id", "left_semi"), groups, link, "a long, b long", seed))
    labels = cut_lineage(core.join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("lab")))

    def touch(a: tiles.Points, b: tiles.Points) -> pa.Table:
        none = np.iinfo("int64").max
        out = []
        for p, q in [(a, b)] if a is b else [(a, b), (b, a)]:
            rest, named = p.table.filter(p.table["lab"].is_null()), q.table.filter(q.table["lab"].is_valid())
            if rest.num_rows and named.num_rows:
                some, cores = tiles.Points(rest), tiles.Points(named)
                names = cores.table["lab"].to_numpy()
                low = np.concatenate([np.where(near, names, none).min(1) for _, near in tiles.within(some, cores, eps)])
                out.append(pa.table({"qid": some.ids[low < none], "blab": low[low < none]}))
        return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], "int64"), "blab": pa.array([], "int64")})
    named = pts.join(labels.distinct(), "id", "left")
    border = tiles.tiled(named, groups, touch, "qid long, blab long", seed).groupBy("qid").agg(F.min("blab").alias("blab"))
    out = points.select("id").join(labels, "id", "left").join(border.withColumnRenamed("qid", "id"), "id", "left")
    return out.select("id", F.coalesce("lab", "blab", F.lit(-1)).cast("long").alias("cluster"),
                      F.col("lab").isNotNull().alias("is_core"))


# --- M27: persistence ------------------------------------------------------------------------

def save_model(model: PipelineModel, name: str, spark, metadata: dict[str, object]) -> str:
    """Save a model with its metadata under the shared folder, at a new path each time. Returns the path."""
    path = f"{shared_dir(spark).rstrip('/')}/tidewater/models/{name}-{uuid.uuid4().hex}"
    model.write().save(f"{path}/model")
    rows = [("name", name), ("saved_at", dt.datetime.now(dt.timezone.utc).isoformat()), *((k, str(v)) for k, v in metadata.items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{path}/metadata")
    return path


def load_model(spark, path: str) -> tuple[PipelineModel, dict[str, str]]:
    """A saved model and its metadata."""
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}
    return PipelineModel.load(f"{path}/model"), meta
