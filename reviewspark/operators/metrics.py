"""Classification metrics per group of predictions, and their summary over folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import score_slice

METRICS = ["f1", "precision", "recall", "auc"]


def confusion_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.count_if((F.col("prediction") == 1) & (F.col("label") == 1)).alias("tp")
    false_alarm = F.count_if((F.col("prediction") == 1) & (F.col("label") == 0)).alias("fp")
    missed = F.count_if((F.col("prediction") == 0) & (F.col("label") == 1)).alias("fn")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(top, bottom):
        return F.when(bottom == 0, 0.0).otherwise(top / bottom)

    return (
        scored.groupBy(*by)
        .agg(hit, false_alarm, missed)
        .select(
            *by,
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
            ratio(tp, tp + fp).alias("precision"),
            ratio(tp, tp + fn).alias("recall"),
        )
    )


def roc_auc(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, tied scores sharing their rank; NaN with one class only.

    Rows are first added up per distinct score. Running totals are taken inside value ranges and the totals of
    the lower ranges are added.
    """
    tied = scored.groupBy(*by, "probability").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    tied = tied.withColumn("_slice", score_slice(scored, "probability"))
    keys = [*by, "_slice"]
    slices = tied.groupBy(*keys).agg(F.sum("neg").alias("_neg"))
    below = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(*keys, F.coalesce(F.sum("_neg").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tied.withColumn("_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(starts, keys)
    beaten = F.col("pos") * (F.col("_start") + F.col("_inside") + F.col("neg") / 2)
    total = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(
        F.when(total == 0, F.lit(float("nan"))).otherwise(F.sum(beaten) / total).alias("auc")
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """f1, precision, recall and auc of (label, prediction, probability) rows, per ``by`` or over all rows."""
    keys = list(by) or ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(1))
    out = confusion_metrics(rows, keys).join(roc_auc(rows, keys), keys)
    return out if by else out.drop("_all")


def long_metrics(metrics: DataFrame, by: Sequence[str] = ("fold",), names: Sequence[str] = METRICS) -> DataFrame:
    return metrics.unpivot(list(by), list(names), "metric", "value")


def metric_summary(folds: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean and population standard deviation per metric; NaN as soon as one fold is NaN."""
    broken = F.max(F.isnan("value"))
    nan = F.lit(float("nan"))
    return folds.groupBy(*by).agg(
        F.when(broken, nan).otherwise(F.avg("value")).alias("mean"),
        F.when(broken, nan).otherwise(F.stddev_pop("value")).alias("std"),
    )
