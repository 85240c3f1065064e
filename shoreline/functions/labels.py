"""Text forms of outputs and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_label(x: Column) -> Column:
    """Canonical text of a number: no ``.0`` on whole numbers, never scientific."""
    small = F.abs(x) < F.lit(9e18)
    # Numbers too large for a bigint have no fraction.
    whole = F.when(small, F.floor(x).cast("double") == x).otherwise(F.abs(x) < float("inf"))
    plain = F.regexp_replace(x.cast("decimal(38,21)").cast("string"), "0+$", "")
    scientific = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16) | (F.abs(x) < 1e-3) & (F.abs(x) >= 1e-4)
    return (
        F.when(whole & small, x.cast("bigint").cast("string"))
        .when(whole, F.format_string("%.0f", x))
        .when(scientific, plain)
        .otherwise(x.cast("string"))
    )


def output_label(prediction: Column, output: Column) -> Column:
    """Class label of an event: the class id if present, else the numeric output."""
    return F.coalesce(prediction.cast("string"), number_label(output.cast("double")))


def binary_probability(probabilities: Column) -> Column:
    """P(class 1) for two classes, otherwise the largest class probability."""
    return F.when(F.size(probabilities) == 2, F.element_at(probabilities, 2)).otherwise(
        F.array_max(probabilities)
    )


def prediction_label(task: Column, class_name: Column, prediction: Column, output: Column) -> Column:
    """Human-facing label: class name, ``Class n`` for numeric classes, or two decimals."""
    numeric = class_name.rlike(r"^-?\d+(\.\d+)?$")
    named = F.when(numeric, F.concat(F.lit("Class "), class_name)).otherwise(class_name)
    fallback = F.coalesce(
        F.concat(F.lit("Class "), prediction.cast("string")), F.lit("prediction")
    )
    return F.when(
        task == "regression", F.format_string("%.2f", F.coalesce(output, F.lit(0.0)))
    ).otherwise(F.coalesce(F.when(prediction.isNotNull(), named), fallback))


def humanize(name: Column) -> Column:
    """Underscores to spaces, first letter upper case; blank names are kept."""
    cleaned = F.trim(F.regexp_replace(name, "_", " "))
    first, rest = F.left(cleaned, F.lit(1)), F.right(cleaned, F.length(cleaned) - 1)
    return F.when(cleaned == "", name).otherwise(F.concat(F.upper(first), rest))


def join_names(names: Column) -> Column:
    """``a``; ``a and b``; ``a, b, and c``."""
    size = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(size - 1, F.lit(1))), ", ")
    return (
        F.when(size == 0, "")
        .when(size == 1, F.get(names, F.lit(0)))
        .when(size == 2, F.array_join(names, " and "))
        .otherwise(F.concat(head, F.lit(", and "), F.element_at(names, -1)))
    )
