"""Model evaluation (M15-M18, M29) from (label, prediction[, score]) columns.

Everything is grouped aggregation over the prediction table; the ROC curve
uses block prefix sums over the distinct scores, so no single-task window
over the whole table is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.ordered import prefix_sums


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Long form (label, prediction, count)."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """M15 per class: precision, recall, f1, support (zero division -> 0)."""
    cm = confusion(df, label, pred)
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("count").alias("predicted"))
    j = sup.join(prd, "cls", "full_outer").join(tp, "cls", "left").na.fill(0, ["support", "predicted", "tp"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select(F.col("cls").alias("class"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("long").alias("support"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1."""
    rep = class_report(df, label, pred)
    acc = df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))
    w = rep.agg(*[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1")])
    a = acc.collect()[0]["accuracy"]
    return w.select(F.lit(a).cast("double").alias("accuracy"), "precision", "recall", "f1")


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R^2 in one aggregate."""
    e = F.col(pred) - F.col(label)
    a = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
               F.var_pop(label).alias("_v"), F.count(F.lit(1)).alias("_n"))
    return a.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.col("_sse") / (F.col("_v") * F.col("_n"))).alias("r2"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", blocks: int = 4096) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, descending; tied scores
    form one step."""
    per = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("tp"), F.sum((F.col(label) != 1).cast("long")).alias("fp"))
    tot = per.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"), F.min("threshold").alias("lo"),
                  F.max("threshold").alias("hi")).collect()[0]
    lo, hi = tot["lo"], tot["hi"]
    width = (hi - lo) / blocks if hi != lo else 1.0
    # descending order = ascending order of -threshold; block index monotone in it
    block = F.floor((F.lit(hi) - F.col("threshold")) / width)
    cum = prefix_sums(per, [], [F.desc("threshold")], block, ["tp", "fp"])
    return cum.select("threshold", (F.col("tp_cum") / tot["P"]).alias("tpr"), (F.col("fp_cum") / tot["N"]).alias("fpr"))


def auc(roc: DataFrame, blocks: int = 4096) -> DataFrame:
    """Trapezoid area under (fpr, tpr) including the (0, 0) start point. Each
    step's area needs the previous point: computed as the area between
    consecutive points ordered by fpr then tpr, via lag inside blocks plus a
    carried previous point (the ROC table has one row per distinct score)."""
    from tidewater.plans.ordered import add_positions, rows_frame
    pos = add_positions(roc, [], ["fpr", "tpr"], F.floor(F.col("fpr") * blocks))
    seg = rows_frame(pos, [], 2, lambda _f, o: {"pf": F.lag("fpr", 1).over(o), "pt": F.lag("tpr", 1).over(o)})
    area = (F.col("fpr") - F.coalesce("pf", F.lit(0.0))) * (F.col("tpr") + F.coalesce("pt", F.lit(0.0))) / 2
    return seg.agg(F.sum(area).alias("auc"))


def residuals(df: DataFrame, key: str, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Residual per row."""
    return df.select(key, (F.col(label) - F.col(pred)).alias("residual"))
