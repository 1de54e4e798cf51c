"""Machine-learning queries (M1-M30). Model fits are randomised or iterative, so
most keys are rows-only checks; exact k-NN and the ANOVA F test have oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import ml as ML
from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6

_CLF_MODELS = ["logistic", "random_forest", "gradient_boosting", "svm", "naive_bayes", "decision_tree"]


def doc_features(spark, d):
    """labels joined with numeric text features of the documents (whole texts)."""
    doc = table(spark, d, "documents")
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    feats = doc.select(
        "doc_id", "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        (F.length(F.regexp_replace("text", r"\s", "")) / F.greatest(F.size(words), F.lit(1))).alias("avg_word_len"),
        (F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digit_share"),
        (F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"),
        (F.size(F.split("text", "\n"))).cast("double").alias("n_lines"))
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return lab.join(feats, "doc_id")


def classification(spark, d):
    return ML.setup(doc_features(spark, d), "quality", "doc_id")


def regression(spark, d):
    li = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_extendedprice")
    return ML.setup(li, "l_extendedprice", "row_id")


@register("ml_setup")
def ml_setup(spark, d):
    train, test, _, names, kind = classification(spark, d)
    return (train.select(F.lit("train").alias("part"), "label").unionByName(test.select(F.lit("test").alias("part"), "label"))
            .groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("problem_type", F.lit(kind)))


@register("ml_compare")
def ml_compare(spark, d):
    train, test, _, _, kind = classification(spark, d)
    return ML.compare(train, test, kind, _CLF_MODELS)


def _fit_eval(spark, d, name):
    train, test, _, _, kind = classification(spark, d)
    model = ML.estimator(name, kind).fit(train.select("features", "label"))
    m = ML.evaluate(model.transform(test), kind)
    return spark.createDataFrame([(name, *[float(v) for v in m.values()])],
                                 "model string, " + ", ".join(f"{k} double" for k in m))


@register("ml_logistic")
def ml_logistic(spark, d):
    return _fit_eval(spark, d, "logistic")


@register("ml_rf")
def ml_rf(spark, d):
    return _fit_eval(spark, d, "random_forest")


@register("ml_gbt")
def ml_gbt(spark, d):
    return _fit_eval(spark, d, "gradient_boosting")


@register("ml_svm")
def ml_svm(spark, d):
    return _fit_eval(spark, d, "svm")


@register("ml_nb")
def ml_nb(spark, d):
    return _fit_eval(spark, d, "naive_bayes")


@register("ml_tree")
def ml_tree(spark, d):
    return _fit_eval(spark, d, "decision_tree")


@register("ml_mlp")
def ml_mlp(spark, d):
    train, test, _, names, kind = classification(spark, d)
    model = ML.mlp(len(names), 2).fit(train.select("features", "label"))
    m = ML.evaluate(model.transform(test), kind)
    return spark.createDataFrame([("mlp", *[float(v) for v in m.values()])],
                                 "model string, " + ", ".join(f"{k} double" for k in m))


@register("ml_linear")
def ml_linear(spark, d):
    train, test, _, _, kind = regression(spark, d)
    rows = []
    for name in ("linear", "ridge", "lasso", "elastic_net"):
        m = ML.evaluate(ML.estimator(name, kind).fit(train.select("features", "label")).transform(test), kind)
        rows.append((name, *[float(v) for v in m.values()]))
    return spark.createDataFrame(rows, "model string, r2 double, rmse double, mae double, mse double")


@register("ml_linear_simple", f"""
SELECT {r6('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r6('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {r6('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem""")
def ml_linear_simple(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("slope"),
                  F.regr_intercept("l_extendedprice", "l_quantity").alias("intercept"),
                  F.regr_r2("l_extendedprice", "l_quantity").alias("r2"))


def embedding_points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@register("ml_knn", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS nid, b.label, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rn FROM d),
v AS (SELECT qid, label, count(*) AS c FROM t WHERE rn <= 5 GROUP BY 1, 2)
SELECT qid AS id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS r FROM v) WHERE r = 1""")
def ml_knn(spark, d):
    return ML.knn_exact(embedding_points(spark, d), k=5)


@register("ml_kmeans")
def ml_kmeans(spark, d):
    model, out = ML.kmeans(ML.vectors(table(spark, d, "embeddings")), k=10)
    cost = model.summary.trainingCost
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).withColumn("inertia", F.lit(float(cost)))


@register("ml_bisecting")
def ml_bisecting(spark, d):
    _, out, sil = ML.bisecting(ML.vectors(table(spark, d, "embeddings")), k=10)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).withColumn("silhouette", F.lit(float(sil)))


@register("ml_silhouette_order")
def ml_silhouette_order(spark, d):
    """Rank inside each cluster by distance to its centre (layout order)."""
    model, out = ML.kmeans(ML.vectors(table(spark, d, "embeddings")), k=10)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    carr = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centers])
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    dist = F.sqrt(F.aggregate(F.zip_with(v, carr[F.col("cluster")], lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                              lambda s, x: s + x))
    from tidewater.plans.ordered import add_positions, value_blocks
    scored = value_blocks(out.select("vec_id", "cluster", dist.alias("score")), ["cluster"], F.col("score"),
                          min_width=1e-9)
    ranked = add_positions(scored, ["cluster"], ["score", "vec_id"], F.col("_tblk"), "rank").drop("_tblk")
    return ranked.withColumn("rank", F.col("rank") + 1)


@register("ml_dbscan", """
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nb AS MATERIALIZED (SELECT a.id AS qid, b.id AS nid FROM p a JOIN p b ON a.id <> b.id WHERE list_distance(a.v, b.v) <= 1.15),
core AS MATERIALIZED (SELECT id FROM p LEFT JOIN (SELECT qid, count(*) AS c FROM nb GROUP BY qid) d ON id = qid WHERE coalesce(c, 0) + 1 >= 5),
e AS MATERIALIZED (SELECT qid, nid FROM nb WHERE qid IN (SELECT id FROM core) AND nid IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT e.nid, r.root FROM reach r JOIN e ON e.qid = r.id),
lab AS (SELECT id, min(root) AS lab FROM reach GROUP BY id),
border AS (SELECT qid, min(lab) AS blab FROM nb JOIN lab ON nid = id GROUP BY qid),
out AS (SELECT p.id, coalesce(lab, blab, -1) AS cluster, lab IS NOT NULL AS is_core FROM p LEFT JOIN lab USING (id) LEFT JOIN border ON p.id = qid)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS members, CAST(count(*) FILTER (is_core) AS BIGINT) AS core FROM out GROUP BY 1""")
def ml_dbscan(spark, d):
    out = ML.dbscan(embedding_points(spark, d), eps=1.15, min_samples=5)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("is_core").cast("int")).alias("core"))


@register("ml_pca")
def ml_pca(spark, d):
    _, var = ML.pca(ML.vectors(table(spark, d, "embeddings")), k=5)
    return var


@register("ml_cluster_summary")
def ml_cluster_summary(spark, d):
    model, out = ML.kmeans(ML.vectors(table(spark, d, "embeddings")), k=10)
    return ML.cluster_summary(out, model.clusterCenters())


@register("ml_cv")
def ml_cv(spark, d):
    train, _, _, _, kind = classification(spark, d)
    return ML.cross_validate(train, ML.estimator("logistic", kind), kind, 5)


@register("ml_grid")
def ml_grid(spark, d):
    train, _, _, _, kind = classification(spark, d)
    return ML.grid_search(train, kind, 3)


_FS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _anova_sql() -> str:
    parts = []
    for c in _FS:
        parts.append(f"""SELECT '{c}' AS feature, {r6(f'''((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1))
  / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*)))''')} AS f_score
FROM (SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY 1)""")
    return "\nUNION ALL\n".join(parts)


@register("fs_univariate", _anova_sql())
def fs_univariate(spark, d):
    return ML.anova_f(table(spark, d, "lineitem"), "l_returnflag", _FS)


@register("fs_rfe")
def fs_rfe(spark, d):
    train, _, _, names, kind = classification(spark, d)
    return ML.rfe(train, names, kind, keep=3, trees=50)


@register("fs_importance")
def fs_importance(spark, d):
    train, _, _, names, kind = classification(spark, d)
    model = ML.estimator("random_forest", kind).fit(train.select("features", "label"))
    return spark.createDataFrame(ML.importance(model, names))


@register("ml_explain")
def ml_explain(spark, d):
    train, test, _, names, kind = classification(spark, d)
    model = ML.estimator("logistic", kind).fit(train.select("features", "label"))
    return ML.linear_explanations(model, test, names)


@register("ml_ensemble")
def ml_ensemble(spark, d):
    train, test, _, _, kind = classification(spark, d)
    parts = []
    for name in ("logistic", "random_forest", "decision_tree"):
        model = ML.estimator(name, kind).fit(train.select("features", "label"))
        parts.append(model.transform(test).select("doc_id", F.lit(name).alias("model"), "prediction", "probability"))
    preds = parts[0].unionByName(parts[1]).unionByName(parts[2])
    hard = ML.vote(preds, "doc_id", kind, "hard").withColumnRenamed("prediction", "hard")
    soft = ML.vote(preds, "doc_id", kind, "soft").withColumnRenamed("prediction", "soft")
    return hard.join(soft, "doc_id").join(test.select("doc_id", "label"), "doc_id")


@register("ml_auto")
def ml_auto(spark, d):
    """Setup -> compare -> pick the best -> importance of the best model."""
    train, test, _, names, kind = classification(spark, d)
    comp = ML.compare(train, test, kind, ["logistic", "random_forest", "decision_tree"])
    best = comp.first()["model"]
    model = ML.estimator(best, kind).fit(train.select("features", "label"))
    imp = spark.createDataFrame(ML.importance(model, names))
    return imp.withColumn("best_model", F.lit(best))


@register("ml_save_load")
def ml_save_load(spark, d):
    from pyspark.ml import Pipeline
    train, test, prep, _, kind = classification(spark, d)
    pipe = Pipeline(stages=[ML.estimator("logistic", kind)]).fit(train.select("features", "label"))
    path = ML.save_model(pipe, "logistic_quality", spark, {"kind": kind, "algorithm": "logistic", "train_rows": train.count()})
    loaded, meta = ML.load_model(spark, path)
    a = pipe.transform(test).select("doc_id", F.col("prediction").alias("p1"))
    b = loaded.transform(test).select("doc_id", F.col("prediction").alias("p2"))
    return a.join(b, "doc_id").withColumn("same", F.col("p1") == F.col("p2")).withColumn("algorithm", F.lit(meta["algorithm"]))


@register("ml_learning_curve")
def ml_learning_curve(spark, d):
    train, test, _, _, kind = classification(spark, d)
    rows = []
    for frac in (0.2, 0.4, 0.6, 0.8, 1.0):
        part = train.sample(fraction=frac, seed=42) if frac < 1.0 else train
        m = ML.evaluate(ML.estimator("logistic", kind).fit(part.select("features", "label")).transform(test), kind)
        rows.append((frac, float(m["accuracy"]), float(m["f1"])))
    return spark.createDataFrame(rows, "train_fraction double, accuracy double, f1 double")
