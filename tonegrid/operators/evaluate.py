"""Metrics over ``(label DOUBLE, prediction DOUBLE)`` rows with 1.0 for positive.

Everything derives from the four confusion counts, so any metric is one map-side aggregate.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    hit, said = F.col("label") == 1.0, F.col("prediction") == 1.0
    return df.groupBy(*(by or [])).agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(~hit & ~said).alias("tn"),
        F.count_if(hit & ~said).alias("fn"),
    )


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(…, n, accuracy, error_rate, tpr, fpr, auc_hard, precision, recall, f1)``; NULL where undefined.

    ``auc_hard`` is the area under the ROC curve of the 0/1 predictions themselves: the curve has
    the one inner point (fpr, tpr), which makes the area (tpr + 1 - fpr) / 2.
    """
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    x = confusion(df, by).withColumn("n", tp + fp + tn + fn)
    x = x.withColumn("accuracy", _ratio(tp + tn, F.col("n"))).withColumn("error_rate", _ratio(fp + fn, F.col("n")))
    x = x.withColumn("tpr", _ratio(tp, tp + fn)).withColumn("fpr", _ratio(fp, fp + tn))
    x = x.withColumn("auc_hard", (F.col("tpr") + 1.0 - F.col("fpr")) / 2.0)
    x = x.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", F.col("tpr"))
    return x.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def accuracy(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics(df, by).select(*(by or []), "accuracy")


def error_rate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics(df, by).select(*(by or []), "error_rate")


def auc_hard(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics(df, by).select(*(by or []), "auc_hard")


def roc_points(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The three points of the ROC curve of 0/1 predictions: ``(…, point, fpr, tpr)``."""
    corner = lambda v: F.struct(F.lit(v).alias("fpr"), F.lit(v).alias("tpr"))
    points = F.array(corner(0.0), F.struct("fpr", "tpr"), corner(1.0))
    x = metrics(df, by).select(*(by or []), F.posexplode(points).alias("point", "p"))
    return x.select(*(by or []), "point", "p.fpr", "p.tpr")


def auc_ranked(df: DataFrame, score: str = "probability") -> float:
    """Area under the full ROC curve of a probability, margin or 0/1 column."""
    return BinaryClassificationEvaluator(rawPredictionCol=score, labelCol="label").evaluate(df)


def best_of(series: DataFrame, param: str = "k", metric: str = "auc_hard") -> DataFrame:
    """The highest value of a sweep and the smallest parameter that reaches it."""
    top = F.max(F.struct(F.col(metric), (-F.col(param)).alias("p"))).alias("m")
    return series.where(F.col(metric).isNotNull()).agg(top).select(
        F.col(f"m.{metric}").alias(metric), (-F.col("m.p")).alias(param)
    )
