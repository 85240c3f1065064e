"""Model quality and group fairness from labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.plans.scan import CHUNK, range_chunks, running


def _ratio(top: Column, bottom: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _complete(scores: DataFrame) -> DataFrame:
    """Rows with a label and a score; without either there is nothing to judge."""
    return scores.filter(F.col("y").isNotNull() & F.col("p").isNotNull())


def binary_metrics(scores: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of (y, p) at a threshold; rows without y or p are left out."""
    hit, real = F.col("p") >= threshold, F.col("y") == 1
    counts = _complete(scores).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
    )
    tp, fp, fn, n = (F.col(c) for c in ("tp", "fp", "fn", "n"))
    return counts.select(
        *keys,
        "n",
        ((n - fp - fn) / n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _by_score(scores: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Positives and negatives per distinct score, cut into contiguous chunks."""
    points = _complete(scores).groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    return range_chunks(points, keys, [order])


def roc_auc(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties averaged; null with one class only.

    The running count of negatives is a distributed scan over distinct scores.
    """
    points = _by_score(scores, keys, F.col("p"))
    ranked = running(points, keys, CHUNK, ["p"], sums={"neg_upto": F.col("neg")})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return (
        ranked.groupBy(*keys)
        .agg(F.sum(won).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .select(
            *keys,
            F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / F.col("pos") / F.col("neg")).alias(
                "roc_auc"
            ),
        )
    )


def average_precision(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under the precision-recall curve; 0 without positives."""
    points = _by_score(scores, keys, F.col("p").desc())
    ranked = running(
        points, keys, CHUNK, [F.col("p").desc()],
        sums={"tp": F.col("pos"), "fp": F.col("neg")},
    )
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return (
        ranked.groupBy(*keys)
        .agg(F.sum(step).alias("area"), F.sum("pos").alias("pos"))
        .select(*keys, _ratio(F.col("area"), F.col("pos")).alias("average_precision"))
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts for every pair of classes, including the empty ones."""
    counts = predictions.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    classes = counts.agg(
        F.array_sort(F.array_union(F.collect_set("y"), F.collect_set("yhat"))).alias("c")
    )
    grid = classes.select(F.explode("c").alias("y"), "c").select("y", F.explode("c").alias("yhat"))
    return grid.join(counts, ["y", "yhat"], "left").select(
        "y", "yhat", F.coalesce("n", F.lit(0)).alias("n")
    )


def multiclass_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy, macro precision / recall / F1 and support-weighted F1."""
    counts = predictions.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    side = F.explode(
        F.array(
            F.struct(F.col("y").alias("c"), F.lit(1).alias("real"), F.lit(0).alias("said")),
            F.struct(F.col("yhat").alias("c"), F.lit(0).alias("real"), F.lit(1).alias("said")),
        )
    )
    per_class = (
        counts.select("n", (F.col("y") == F.col("yhat")).alias("right"), side.alias("s"))
        .groupBy("s.c")
        .agg(
            F.sum(F.when(F.col("right") & (F.col("s.real") == 1), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.col("n") * F.col("s.real")).alias("support"),
            F.sum(F.col("n") * F.col("s.said")).alias("predicted"),
        )
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    f1 = _ratio(2 * tp, support + predicted)
    return per_class.agg(
        (F.sum(tp) / F.sum(support)).alias("accuracy"),
        F.avg(_ratio(tp, predicted)).alias("precision_macro"),
        F.avg(_ratio(tp, support)).alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * support) / F.sum(support)).alias("f1_weighted"),
    )


def roc_auc_ovr(class_scores: DataFrame) -> DataFrame:
    """Macro one-versus-rest area from rows (class, y, p)."""
    return roc_auc(class_scores, ["class"]).agg(F.avg("roc_auc").alias("roc_auc_ovr"))


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """R2, mean absolute error and root mean squared error of (y, yhat)."""
    error = F.col("y") - F.col("yhat")
    summed = predictions.groupBy(*keys).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y").alias("spread"),
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("spread") == 0, flat).otherwise(1 - F.col("mse") / F.col("spread"))
    return summed.select(*keys, r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"))


def fairness_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Selection, true-positive and false-positive rate per group ``g``; 0 where empty.

    Rows without y or p are left out.
    """
    hit = F.col("p") >= threshold
    real, unreal = F.col("y") == 1, F.col("y") == 0
    return _complete(scores).groupBy(F.col("g").cast("string").alias("g")).agg(
        F.avg(hit.cast("double")).alias("selection_rate"),
        _ratio(F.count_if(hit & real), F.count_if(real)).alias("tpr"),
        _ratio(F.count_if(hit & unreal), F.count_if(unreal)).alias("fpr"),
    )


def fairness_gaps(rates: DataFrame) -> DataFrame:
    """Largest difference between groups per rate."""
    return rates.agg(
        *[
            (F.max(c) - F.min(c)).alias(f"{c}_gap")
            for c in ("selection_rate", "tpr", "fpr")
        ]
    )
