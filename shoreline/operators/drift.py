"""Two-sample comparison of windows with a baseline.

Each current value is placed in a *cell*: the number of baseline values below it (``lt``), the
number at or below it (``le``) and its stability-index bin. The pair (lt, le) is exactly what
the two-sample statistic needs to know about the value, so counting rows per
(model, window, node, cell) is one map-side-combined aggregation that feeds both the KS
statistic and the stability index, and no group of raw values is ever gathered. A node has at
most two cells per distinct baseline value however many rows the window has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.config import (
    CONTINUOUS,
    DEFAULTS,
    DRIFT,
    PSI_EPSILON,
    DriftConfig,
)
from shoreline.functions.pvalues import with_ks_pvalue
from shoreline.functions.verdicts import combine_verdict, ks_verdict, psi_verdict
from shoreline.operators.profile import (
    Baseline,
    bin_of,
    most_edges,
    collect_batch_categories,
    collect_batch_features,
    split_columns,
)
from shoreline.plans.materialize import stored
from shoreline.plans.scan import CHUNK, range_chunks, running
from shoreline.plans.sizing import broadcast_if_small

NODE = ("model_id", "node")
WINDOW_NODE = ("model_id", "window_id", "node")
# Baseline values per stretch of a running sum over cells.
STRETCH = 100_000


def _share_term(current: Column, base: Column) -> Column:
    """One bin's contribution, both shares floored."""
    c = F.greatest(current, F.lit(PSI_EPSILON))
    b = F.greatest(base, F.lit(PSI_EPSILON))
    return (c - b) * F.log(c / b)


def baseline_cells(values: DataFrame, baseline: Baseline) -> DataFrame:
    """Counts per (model, window, node, lt, le, bin).

    ``values`` has model_id, window_id, node, value. Values of windows and of the baseline, counted, are laid out
    once in the order (model, node, value, window), a baseline value before its equals. Inside a
    stretch of that order ``le`` is a running sum of baseline values, and ``lt`` is ``le`` without the last baseline
    value if that is an equal one; one row per stretch carries both forward. Nothing is joined on a
    value, so a value that all windows hold is spread over as many stretches as it needs.
    """
    binned = baseline.nodes.filter(F.col("edges").isNotNull()).select(*NODE, "edges")
    points = values.groupBy(*WINDOW_NODE, "value").agg(F.count("*").alias("n")).withColumn("b", F.lit(0).cast("bigint"))
    marks = baseline.values.groupBy(*NODE, "value").agg(F.count("*").alias("b"))
    marks = marks.withColumn("window_id", F.lit(None).cast(values.schema["window_id"].dataType)).withColumn("n", F.lit(0).cast("bigint"))
    laid_out = range_chunks(points.unionByName(marks), list(NODE), ["value", F.asc_nulls_first("window_id")])
    last = F.when(F.col("b") > 0, F.struct("value", "b"))
    ranked = running(
        laid_out, list(NODE), CHUNK, ["_local"], sums={"le": F.col("b")}, maxima={"last": last}
    ).filter("n > 0")
    equal = F.when(F.col("last.value") == F.col("value"), F.col("last.b")).otherwise(0)
    return (
        ranked.join(broadcast_if_small(binned), list(NODE))
        .groupBy(*WINDOW_NODE, (F.col("le") - equal).alias("lt"), "le", bin_of("value", "edges", most_edges(binned)).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )


def continuous_statistics(
    cells: DataFrame, nodes: DataFrame, config: DriftConfig = DEFAULTS
) -> DataFrame:
    """KS statistic and stability index per (model, window, node); null below the minimum.

    KS: between the cells that hold current values one of the two distribution functions is
    constant, so the largest gap is reached just before or just after such a cell.

    Index: an empty bin contributes a constant that depends on the baseline alone, so the sum
    is that constant over all bins plus a correction for the bins that hold values. No grid of
    windows and bins is built. With one bin or none the index is 0.

    A node has up to two cells per baseline value, so the running sum is cut into stretches of
    ``STRETCH`` baseline values; one row per stretch is carried forward.
    """
    sizes = nodes.select(*NODE, "baseline_n", "n_bins", "base_props")
    kept = stored(cells, "cells")
    totals = kept.groupBy(*WINDOW_NODE).agg(F.sum("n").alias("current_n"))
    steps = (
        running(
            kept.withColumn(CHUNK, F.expr(f"lt div {STRETCH}")), list(WINDOW_NODE), CHUNK,
            ["lt", "le", "bin"], sums={"cum": F.col("n")},
        )
        .join(broadcast_if_small(stored(totals, "totals")), list(WINDOW_NODE))
        .join(broadcast_if_small(sizes), list(NODE))
    )
    base_n, cur_n = F.col("baseline_n"), F.col("current_n")
    before = F.abs((F.col("cum") - F.col("n")) / cur_n - F.col("lt") / base_n)
    after = F.abs(F.col("cum") / cur_n - F.col("le") / base_n)
    per_bin = steps.groupBy(*WINDOW_NODE, "current_n", "baseline_n", "n_bins", "base_props", "bin")
    per_bin = per_bin.agg(F.max(F.greatest(before, after)).alias("gap"), F.sum("n").alias("n"))
    share = F.get("base_props", F.col("bin"))
    correction = _share_term(F.col("n") / cur_n, share) - _share_term(F.lit(0.0), share)
    empty = F.aggregate(
        "base_props", F.lit(0.0), lambda a, b: a + _share_term(F.lit(0.0), b)
    )
    enough = F.least("current_n", "baseline_n") >= config.min_samples
    return (
        per_bin.groupBy(*WINDOW_NODE, "current_n", "baseline_n", "n_bins", "base_props")
        .agg(F.max("gap").alias("gap"), F.sum(correction).alias("correction"))
        .select(
            *WINDOW_NODE,
            "current_n",
            "baseline_n",
            "n_bins",
            F.when(enough, F.col("gap")).alias("statistic"),
            F.when(
                enough, F.when(F.col("n_bins") > 1, F.col("correction") + empty).otherwise(0.0)
            ).alias("psi"),
        )
    )


def ks_statistic(cells: DataFrame, nodes: DataFrame, config: DriftConfig = DEFAULTS) -> DataFrame:
    """Two-sample KS statistic with both sample sizes."""
    return continuous_statistics(cells, nodes, config).drop("psi", "n_bins")


def ks_test(
    statistic: DataFrame,
    config: DriftConfig = DEFAULTS,
    *,
    p_method: str,
    threshold: Column | None = None,
) -> DataFrame:
    """Full test row; statistic and p-value are null when a side has too few samples."""
    limit = threshold if threshold is not None else F.lit(config.ks_pvalue)
    return (
        with_ks_pvalue(statistic, "current_n", "baseline_n", "statistic", p_method)
        .withColumn("threshold", limit)
        .withColumn("verdict", ks_verdict("p_value", F.col("threshold")))
    )


def psi_continuous(cells: DataFrame, nodes: DataFrame, config: DriftConfig = DEFAULTS) -> DataFrame:
    """Stability index of numeric nodes with its verdict."""
    return (
        continuous_statistics(cells, nodes, config)
        .drop("statistic")
        .withColumn("verdict", psi_verdict("psi", config.psi_warning, config.psi_drift))
    )


def psi_bins_continuous(
    cells: DataFrame, nodes: DataFrame, config: DriftConfig = DEFAULTS
) -> DataFrame:
    """Per-bin shares and contributions for nodes with enough samples on both sides."""
    counts = cells.groupBy(*WINDOW_NODE, "bin").agg(F.sum("n").alias("n"))
    per_window = counts.groupBy(*WINDOW_NODE).agg(
        F.sum("n").alias("current_n"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin")
    )
    enough = F.least("current_n", "baseline_n") >= config.min_samples
    shares = (
        per_window.join(
            broadcast_if_small(nodes.select(*NODE, "baseline_n", "labels", "base_props")), list(NODE)
        )
        .filter(enough)
        .select(
            *WINDOW_NODE,
            "current_n",
            "by_bin",
            "labels",
            F.posexplode("base_props").alias("bin", "baseline_prop"),
        )
        .withColumn(
            "current_prop",
            F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)) / F.col("current_n"),
        )
    )
    return shares.select(
        *WINDOW_NODE,
        "bin",
        F.get("labels", F.col("bin")).alias("label"),
        "baseline_prop",
        "current_prop",
        _share_term(F.col("current_prop"), F.col("baseline_prop")).alias("contribution"),
    )


def category_counts(values: DataFrame) -> DataFrame:
    """Current counts per (model, window, node, category)."""
    return values.groupBy(*WINDOW_NODE, F.col("cat").alias("category")).agg(
        F.count("*").alias("n")
    )


def psi_bins_categorical(counts: DataFrame, categories: DataFrame) -> DataFrame:
    """Per-category shares: the baseline's categories and those new in the window."""
    totals = counts.groupBy(*WINDOW_NODE).agg(F.sum("n").alias("current_n"))
    grid = totals.join(categories.select(*NODE, "category", "prop"), list(NODE))
    both = grid.drop("current_n").join(counts, [*WINDOW_NODE, "category"], "full_outer")
    return (
        both.join(totals, list(WINDOW_NODE))
        .withColumn("baseline_prop", F.coalesce("prop", F.lit(0.0)))
        .withColumn("current_prop", F.coalesce(F.col("n"), F.lit(0)) / F.col("current_n"))
        .select(
            *WINDOW_NODE,
            F.col("category").alias("label"),
            "baseline_prop",
            "current_prop",
            _share_term(F.col("current_prop"), F.col("baseline_prop")).alias("contribution"),
        )
    )


def psi_categorical(
    counts: DataFrame, categories: DataFrame, config: DriftConfig = DEFAULTS
) -> DataFrame:
    """Stability index over categories; only the current side is gated.

    As in :func:`psi_continuous`, categories without current values enter as a constant per
    node, so baseline categories are not repeated for every window.
    """
    shares = categories.select(
        *NODE, "category", "prop", "n", _share_term(F.lit(0.0), F.col("prop")).alias("empty")
    )
    per_node = shares.groupBy(*NODE).agg(
        F.sum("empty").alias("all_empty"), F.sum("n").alias("baseline_n")
    )
    totals = counts.groupBy(*WINDOW_NODE).agg(F.sum("n").alias("current_n"))
    known = broadcast_if_small(shares.select(*NODE, "category", "prop", "empty"))
    base = F.coalesce(F.col("prop"), F.lit(0.0))
    correction = _share_term(F.col("n") / F.col("current_n"), base) - F.coalesce(
        F.col("empty"), F.lit(0.0)
    )
    summed = (
        counts.join(totals, list(WINDOW_NODE))
        .join(known, [*NODE, "category"], "left")
        .groupBy(*WINDOW_NODE, "current_n")
        .agg(F.sum(correction).alias("correction"))
    )
    return summed.join(broadcast_if_small(per_node), list(NODE)).select(
        *WINDOW_NODE,
        "current_n",
        "baseline_n",
        F.when(
            F.col("current_n") >= config.min_samples, F.col("correction") + F.col("all_empty")
        ).alias("psi"),
    )


def load_thresholds(
    nodes: DataFrame, overrides: DataFrame | None = None, config: DriftConfig = DEFAULTS
) -> DataFrame:
    """Nodes with their thresholds: the override where one is set, otherwise the default.

    Overrides with a ``model_id`` hold for that model alone, others for the node of every model.
    """
    fields = ("ks_pvalue", "psi_warning", "psi_drift")
    defaults = {f: F.lit(float(getattr(config, f))) for f in fields}
    base = nodes.select(*NODE, "kind", "baseline_n")
    if overrides is None:
        return base.select("*", *[c.alias(f) for f, c in defaults.items()])
    on = [c for c in NODE if c in overrides.columns]
    return base.join(broadcast_if_small(overrides), on, "left").select(
        *base.columns, *[F.coalesce(F.col(f), c).alias(f) for f, c in defaults.items()]
    )


def detect_drift(
    numeric: DataFrame,
    text: DataFrame,
    windows: DataFrame,
    baseline: Baseline,
    config: DriftConfig = DEFAULTS,
    *,
    thresholds: DataFrame | None = None,
    p_method: str,
) -> DataFrame:
    """Verdict of every baseline node in every window.

    ``numeric``: model_id, window_id, node, value. ``text``: model_id, window_id, node, cat.
    ``windows``: distinct (model_id, window_id); a node without values in a window is
    INSUFFICIENT_DATA.
    """
    cells = baseline_cells(numeric, baseline)
    columns = [*WINDOW_NODE, "current_n", "statistic", "psi"]
    measured = (
        continuous_statistics(cells, baseline.nodes, config)
        .select(*columns)
        .unionByName(
            psi_categorical(category_counts(text), baseline.categories, config)
            .withColumn("statistic", F.lit(None).cast("double"))
            .select(*columns)
        )
    )
    checks = load_thresholds(baseline.nodes, thresholds, config)
    grid = windows.select("model_id", "window_id").join(broadcast_if_small(checks), "model_id")
    continuous = F.col("kind") == CONTINUOUS
    joined = grid.join(measured, list(WINDOW_NODE), "left").withColumn(
        "current_n", F.coalesce("current_n", F.lit(0))
    )
    return (
        with_ks_pvalue(joined, "current_n", "baseline_n", "statistic", p_method)
        .withColumn(
            "ks_verdict", F.when(continuous, ks_verdict("p_value", F.col("ks_pvalue")))
        )
        .withColumn("psi_verdict", psi_verdict("psi", F.col("psi_warning"), F.col("psi_drift")))
        .withColumn("verdict", combine_verdict("ks_verdict", "psi_verdict"))
        .select(
            *WINDOW_NODE,
            "kind",
            "current_n",
            "baseline_n",
            "statistic",
            "p_value",
            "psi",
            "ks_verdict",
            "psi_verdict",
            "verdict",
        )
    )


def drift_from_frame(
    frame: DataFrame,
    columns: Sequence[str],
    baseline: Baseline,
    config: DriftConfig = DEFAULTS,
    **options,
) -> DataFrame:
    """One batch (wide rows with model_id) as a single window."""
    numbers, texts = split_columns(frame, columns)
    batch = frame.withColumn("window_id", F.lit(0).cast("bigint"))
    ids = ["model_id", "window_id"]
    windows = baseline.nodes.select("model_id", F.lit(0).cast("bigint").alias("window_id")).distinct()
    return detect_drift(
        collect_batch_features(batch, ids, numbers),
        collect_batch_categories(batch, ids, texts),
        windows,
        baseline,
        config,
        **options,
    )


def drifted_nodes(node_drift: DataFrame, positions: DataFrame) -> DataFrame:
    """Drifted nodes per window as an array in baseline order (bounded by the model's nodes).

    ``positions`` has node and pos, and model_id where models differ.
    """
    on = [c for c in NODE if c in positions.columns]
    hits = node_drift.filter(F.col("verdict") == DRIFT).join(
        broadcast_if_small(positions.select(*on, "pos")), on
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "node")))
    return hits.groupBy("model_id", "window_id").agg(
        F.transform(ordered, lambda s: s["node"]).alias("drifted_nodes")
    )
