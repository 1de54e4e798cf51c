"""Evaluation queries (M15-M18, M29) on stand-in predictions from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import metrics as M
from tidewater.operators.charts import histogram
from tidewater.sources.tables import table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6


def _labels(spark, d):
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


def _regression(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(p, "l_partkey").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
                                          (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))


def _scores(spark, d):
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return lab.join(doc, "doc_id")


_CM = "(SELECT quality AS label, toxic AS prediction, count(*) AS c FROM labels GROUP BY 1, 2)"
_REPORT = f"""rep AS (
  SELECT cls, CAST(coalesce(sup, 0) AS BIGINT) AS support,
    CASE WHEN coalesce(prd, 0) > 0 THEN coalesce(tp, 0) / prd ELSE 0.0 END AS precision,
    CASE WHEN coalesce(sup, 0) > 0 THEN coalesce(tp, 0) / sup ELSE 0.0 END AS recall
  FROM (SELECT label AS cls, sum(c) AS sup FROM {_CM} GROUP BY 1) s
  FULL OUTER JOIN (SELECT prediction AS cls, sum(c) AS prd FROM {_CM} GROUP BY 1) p USING (cls)
  LEFT JOIN (SELECT label AS cls, c AS tp FROM {_CM} WHERE label = prediction) t USING (cls)),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rep)"""


@register("metric_class_report", f"""WITH {_REPORT}
SELECT cls AS class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, support FROM rep2""")
def metric_class_report(spark, d):
    return M.class_report(_labels(spark, d))


@register("metric_classification", f"""WITH {_REPORT}
SELECT {r6('(SELECT avg(CAST(quality = toxic AS DOUBLE)) FROM labels)')} AS accuracy,
  {r6('sum(precision * support) / sum(support)')} AS precision, {r6('sum(recall * support) / sum(support)')} AS recall,
  {r6('sum(f1 * support) / sum(support)')} AS f1 FROM rep2""")
def metric_classification(spark, d):
    return M.classification_metrics(_labels(spark, d))


@register("metric_confusion", "SELECT quality AS label, toxic AS prediction, CAST(count(*) AS BIGINT) AS count FROM labels GROUP BY 1, 2")
def metric_confusion(spark, d):
    return M.confusion(_labels(spark, d))


_REG = "(SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * p_retailprice AS prediction FROM lineitem JOIN part ON l_partkey = p_partkey)"


@register("metric_regression", f"""
SELECT {r6('avg((prediction - label) ^ 2)')} AS mse, {r6('sqrt(avg((prediction - label) ^ 2))')} AS rmse,
  {r6('avg(abs(prediction - label))')} AS mae, {r6('1 - sum((prediction - label) ^ 2) / (var_pop(label) * count(*))')} AS r2 FROM {_REG}""")
def metric_regression(spark, d):
    return M.regression_metrics(_regression(spark, d))


_ROC = """per AS (SELECT CAST(n_chars AS DOUBLE) AS threshold, sum(CAST(quality = 1 AS BIGINT)) AS tp, sum(CAST(quality <> 1 AS BIGINT)) AS fp
  FROM labels JOIN documents USING (doc_id) GROUP BY 1),
roc AS (SELECT threshold, sum(tp) OVER w / (SELECT sum(tp) FROM per) AS tpr, sum(fp) OVER w / (SELECT sum(fp) FROM per) AS fpr
  FROM per WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("metric_roc", f"WITH {_ROC} SELECT {r6('threshold')} AS threshold, {r6('tpr')} AS tpr, {r6('fpr')} AS fpr FROM roc")
def metric_roc(spark, d):
    return M.roc_curve(_scores(spark, d))


@register("metric_auc", f"""WITH {_ROC}
SELECT {r6('sum((fpr - coalesce(pf, 0.0)) * (tpr + coalesce(pt, 0.0)) / 2)')} AS auc FROM (
  SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr, tpr) AS pf, lag(tpr) OVER (ORDER BY fpr, tpr) AS pt FROM roc)""")
def metric_auc(spark, d):
    return M.auc(M.roc_curve(_scores(spark, d)))


@register("metric_residuals", f"""
SELECT CAST(bin AS INT) AS bin, {r6('lo + bin * (hi - lo) / 20')} AS bin_start, {r6('lo + (bin + 1) * (hi - lo) / 20')} AS bin_end,
  CAST(count(*) AS BIGINT) AS count FROM (
  SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((r - lo) / ((hi - lo) / 20)), 19) AS INT) END AS bin, lo, hi
  FROM (SELECT label - prediction AS r FROM {_REG}), (SELECT min(label - prediction) AS lo, max(label - prediction) AS hi FROM {_REG}))
GROUP BY bin, lo, hi""")
def metric_residuals(spark, d):
    res = M.residuals(_regression(spark, d), "l_orderkey")
    return histogram(res, "residual", 20)
