"""Metrics from predictions, baselines and the verdict."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.models.features import CLASSIFICATION


def confusion(predictions: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """(real, predicho, n): rows per pair of classes, present pairs only."""
    return predictions.groupBy(*(by or []), F.col(label).cast("string").alias("real"), F.col(prediction).cast("string").alias("predicho")).agg(
        F.count(F.lit(1)).alias("n"))


def labels(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every class that occurs, real or predicted."""
    real = predictions.select(F.col(label).cast("string").alias("clase"))
    return real.union(predictions.select(F.col(prediction).cast("string"))).distinct()


def classification_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from a confusion table, one row or one per group."""
    by = list(by or [])
    sides = cells.select(*by, "n", (F.col("real") == F.col("predicho")).alias("hit"), F.explode(F.array(
        F.struct(F.col("real").alias("clase"), F.lit(True).alias("is_real")),
        F.struct(F.col("predicho").alias("clase"), F.lit(False).alias("is_real")))).alias("x"))
    real = F.col("x.is_real")
    per = sides.groupBy(*by, "x.clase").agg(
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("real"), F.sum(F.when(~real, F.col("n")).otherwise(0)).alias("predicho"),
        F.sum(F.when(real & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    recall = F.when(F.col("real") > 0, F.col("hits") / F.col("real"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("real") + F.col("predicho")).cast("double")), F.lit(0.0))
    return per.groupBy(*by).agg(
        (F.sum("hits") / F.sum("real")).alias("exactitud"), F.avg(recall).alias("exactitud_balanceada"), F.avg(f1).alias("f1_macro"))


def regression_metrics(predictions: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """R², MAE, RMSE and MAPE (targets nearer to zero than 1e-9 left out) in one aggregation."""
    y, p = F.col(label), F.col(prediction)
    out = predictions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(y - p, 2)).alias("sse"), F.var_pop(y).alias("vy"),
        F.avg(F.abs(y - p)).alias("mae"), F.avg(F.when(F.abs(y) >= 1e-9, F.abs((y - p) / y))).alias("mape"))
    return out.select(*(by or []), (1 - F.try_divide("sse", F.col("n") * F.col("vy"))).alias("r2"), "mae",
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mape")


def residuals(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    return predictions.withColumn("residuo", F.col(label) - F.col(prediction))


def baseline_class(train: DataFrame, label: str) -> Column:
    """The most frequent class of the training rows, ties to the smallest."""
    counts = train.groupBy(F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by("c", F.struct(-F.col("n"), F.col("c")))).scalar()


def baseline_mean(train: DataFrame, label: str) -> Column:
    return train.agg(F.avg(label)).scalar()


def beats_baseline(task: str, score: Column, base: Column) -> Column:
    """Balanced accuracy by more than 0.02, or R² by more than 0.05 over the baseline or zero."""
    return score > base + 0.02 if task == CLASSIFICATION else score > F.greatest(base, F.lit(0.0)) + 0.05


def verdict(task: str, score: Column, base: Column, leaks: Column) -> Column:
    """fuga, no_supera, debil or claro, in that order of precedence."""
    weak = score < (0.6 if task == CLASSIFICATION else 0.4)
    return F.when(leaks > 0, "fuga").when(~beats_baseline(task, score, base), "no_supera").when(weak, "debil").otherwise("claro")
