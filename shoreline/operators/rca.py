"""Root causes and symptoms among drifted features.

Inputs: ``node_drift`` (model_id, window_id, node, verdict, psi, p_value, ...), the closure of
the declared graph and its topological order. Where these have a ``model_id``, every model has a graph of its
own, and nodes of equal names in other graphs don't count. The model output is never a cause or a symptom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.config import (
    DRIFT,
    INSUFFICIENT_DATA,
    OUTPUT_NODE,
    ROOT_CAUSE,
    STABLE,
    SYMPTOM,
    WARNING,
)
from shoreline.plans.sizing import broadcast_if_small

WINDOW = ("model_id", "window_id")


def _by_model(table: DataFrame) -> list[str]:
    """``model_id`` where the table holds the graphs of several models."""
    return ["model_id"] if "model_id" in table.columns else []


def _drifted(node_drift: DataFrame) -> DataFrame:
    return node_drift.filter((F.col("verdict") == DRIFT) & (F.col("node") != OUTPUT_NODE))


def _drifted_above(node_drift: DataFrame, closure: DataFrame) -> DataFrame:
    """(window, node) pairs with a drifted ancestor at any distance."""
    drifted = _drifted(node_drift).select(*WINDOW, "node")
    model = _by_model(closure)
    upward = closure.select(*model, F.col("descendant").alias("node"), "ancestor")
    candidates = drifted.join(broadcast_if_small(upward), [*model, "node"])
    above = drifted.withColumnRenamed("node", "ancestor")
    return candidates.join(above, [*WINDOW, "ancestor"], "left_semi").select(*WINDOW, "node").distinct()


def rca_roots(node_drift: DataFrame, closure: DataFrame) -> DataFrame:
    """Drifted features without a drifted ancestor (also those the graph does not mention)."""
    below = _drifted_above(node_drift, closure)
    return _drifted(node_drift).join(below, [*WINDOW, "node"], "left_anti")


def rca_symptoms(node_drift: DataFrame, closure: DataFrame) -> DataFrame:
    """Drifted features with a drifted ancestor, even across a stable node."""
    below = _drifted_above(node_drift, closure)
    return _drifted(node_drift).join(below, [*WINDOW, "node"], "left_semi")


def severity(psi: Column | str = "psi", p_value: Column | str = "p_value") -> Column:
    """Ranking value of a root: the index if present, else 1 - p."""
    psi = F.col(psi) if isinstance(psi, str) else psi
    p = F.col(p_value) if isinstance(p_value, str) else p_value
    return F.coalesce(psi, F.lit(1.0) - p, F.lit(0.0))


def root_severity(roots: DataFrame) -> DataFrame:
    """Roots of each window ranked by severity, ties by name."""
    # A group has at most one row per node of the model.
    rank = Window.partitionBy(*WINDOW).orderBy(F.col("severity").desc(), "node")
    return roots.withColumn("severity", severity()).withColumn("rank", F.row_number().over(rank))


def symptom_paths(
    node_drift: DataFrame, roots: DataFrame, closure: DataFrame, order: DataFrame
) -> DataFrame:
    """Per root the drifted descendants in topological order (empty array if none)."""
    model, placed = _by_model(closure), _by_model(order)
    downward = closure.select(*model, F.col("ancestor").alias("node"), F.col("descendant").alias("below"))
    drifted = _drifted(node_drift).select(*WINDOW, F.col("node").alias("below"))
    places = order.select(*placed, F.col("node").alias("below"), "level")
    hits = (
        roots.select(*WINDOW, "node")
        .join(broadcast_if_small(downward), [*model, "node"])
        .join(drifted, [*WINDOW, "below"])
        .join(broadcast_if_small(places), [*placed, "below"])
    )
    ordered = F.array_sort(F.collect_list(F.struct("level", "below")))
    paths = hits.groupBy(*WINDOW, "node").agg(
        F.transform(ordered, lambda s: s["below"]).alias("symptom_path")
    )
    empty = F.array().cast("array<string>")
    return (
        roots.select(*WINDOW, "node")
        .join(paths, [*WINDOW, "node"], "left")
        .withColumn("symptom_path", F.coalesce("symptom_path", empty))
    )


def classify_nodes(node_drift: DataFrame, closure: DataFrame) -> DataFrame:
    """ROOT_CAUSE, SYMPTOM, WARNING, INSUFFICIENT_DATA or STABLE for every node and window."""
    below = _drifted_above(node_drift, closure).withColumn("has_cause", F.lit(True))
    drifted_feature = (F.col("verdict") == DRIFT) & (F.col("node") != OUTPUT_NODE)
    return node_drift.join(below, [*WINDOW, "node"], "left").select(
        *node_drift.columns,
        F.when(drifted_feature & F.col("has_cause"), SYMPTOM)
        .when(drifted_feature, ROOT_CAUSE)
        .when(F.col("verdict").isin(WARNING, INSUFFICIENT_DATA), F.col("verdict"))
        .otherwise(STABLE)
        .alias("classification"),
    )


def rca_evidence(node_drift: DataFrame, paths: DataFrame) -> DataFrame:
    """Test results of each root and of the nodes on its path, as a map by node."""
    members = paths.select(
        *WINDOW,
        F.col("node").alias("root"),
        F.explode(F.concat(F.array("node"), F.col("symptom_path"))).alias("node"),
    )
    result = F.struct("verdict", "statistic", "p_value", "psi", "current_n", "baseline_n")
    entry = F.struct("node", result.alias("result"))
    return (
        members.join(node_drift, [*WINDOW, "node"])
        .groupBy(*WINDOW, "root")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("evidence"))
    )


def primary_root(ranked: DataFrame, paths: DataFrame) -> DataFrame:
    """First-ranked root of each window with its path."""
    return ranked.filter(F.col("rank") == 1).join(paths, [*WINDOW, "node"]).select(
        *WINDOW, F.col("node").alias("root_cause"), "severity", "symptom_path"
    )
