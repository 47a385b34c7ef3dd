"""Classifier metrics over predictions (y, pred, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.operators.order import numbered


def _ratio(a, b):
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1, false-positive rate and accuracy; a zero denominator gives 0."""
    hit = lambda y, p: F.count_if((F.col("y") == y) & (F.col("pred") == p))
    c = predictions.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(fp, fp + tn).alias("fpr"), _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def auc(predictions: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks, ties averaged; NaN with one class. Ranks are places in a distributed sort, so that no task needs all scores."""
    placed = numbered(predictions.select("y", "score"), "score")
    per = placed.groupBy("score").agg(F.avg("place").alias("rank"), F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    sums = per.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return sums.select(F.when((p == 0) | (q == 0), F.lit(float("nan"))).otherwise((F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def majority(predictions: DataFrame) -> DataFrame:
    """The larger class (a tie: 1), its accuracy, and the share of positives."""
    rate = predictions.agg(F.avg(F.col("y").cast("double")).alias("positive_rate"))
    one = F.col("positive_rate") >= 0.5
    return rate.select(F.when(one, 1).otherwise(0).alias("majority"), F.when(one, F.col("positive_rate")).otherwise(1 - F.col("positive_rate")).alias("accuracy"), "positive_rate")


def calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins of the score."""
    bin_ = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = predictions.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg(F.col("y").cast("double")).alias("r"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("r"))) / F.sum("n")).alias("ece"))


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa of two 0/1 labels (a, b)."""
    s = pairs.agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.sum("a").alias("a1"), F.sum("b").alias("b1"))
    n = F.col("n")
    po = F.col("same") / n
    pe = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    return s.select(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))
