"""Reference profiling, unpivoting and baselines.

A baseline is three tables keyed by ``(model_id, node)``: ``nodes`` (kind, counts, bin edges and
the baseline share of each bin), ``values`` (numeric sample) and ``categories`` (shares). It is
computed once per model version and stored; comparing a window only reads it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.config import CATEGORICAL, CONTINUOUS, DEFAULTS, OUTPUT_NODE, DriftConfig
from shoreline.functions.labels import number_label, output_label
from shoreline.plans.materialize import stored
from shoreline.plans.scan import CHUNK, dense_index, range_chunks, running
from shoreline.plans.sizing import broadcast_if_small


@dataclass(frozen=True)
class Baseline:
    """Baseline tables of one or many models."""

    nodes: DataFrame
    values: DataFrame
    categories: DataFrame


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Feature kind per column: numbers and booleans continuous, strings categorical."""
    kinds: dict[str, str] = {}
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            kinds[field.name] = CONTINUOUS
        elif isinstance(field.dataType, T.StringType):
            kinds[field.name] = CATEGORICAL
        else:
            raise TypeError(
                f"column {field.name}: a feature must be a number, boolean or string, "
                f"not {field.dataType.simpleString()}"
            )
    return kinds


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide frame to one row per (row, node); nulls and NaN are no sample."""
    kinds = column_kinds(df, columns)
    entries = []
    for name in columns:
        numeric = kinds[name] == CONTINUOUS
        entries.append(
            F.struct(
                F.lit(name).alias("node"),
                F.lit(kinds[name]).alias("kind"),
                (F.col(name).cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
                (F.lit(None).cast("string") if numeric else F.col(name)).alias("cat"),
            )
        )
    long = df.select(*ids, F.explode(F.array(*entries)).alias("f")).select(*ids, "f.*")
    return long.filter(
        (F.col("num").isNotNull() & ~F.isnan("num")) | F.col("cat").isNotNull()
    )


def _no_rows(df: DataFrame, ids: Sequence[str], name: str, kind: str) -> DataFrame:
    none = F.lit(None)
    return df.select(*ids, none.cast("string").alias("node"), none.cast(kind).alias(name)).filter(
        F.lit(False)
    )


def collect_batch_features(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Numeric columns of a frame as (ids, node, value); reads those columns only."""
    if not columns:
        return _no_rows(df, ids, "value", "double")
    return (
        df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(list(ids), list(columns), "node", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def collect_batch_categories(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Text columns of a frame as (ids, node, cat); reads those columns only."""
    if not columns:
        return _no_rows(df, ids, "cat", "string")
    return (
        df.select(*ids, *columns)
        .unpivot(list(ids), list(columns), "node", "cat")
        .filter(F.col("cat").isNotNull())
    )


def split_columns(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Continuous and categorical column names."""
    kinds = column_kinds(df, columns)
    return (
        [c for c in columns if kinds[c] == CONTINUOUS],
        [c for c in columns if kinds[c] == CATEGORICAL],
    )


def split_values(long: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Mixed rows (num, cat) as (keys, node, value) and (keys, node, cat)."""
    numeric = long.filter(F.col("num").isNotNull()).select(*keys, "node", F.col("num").alias("value"))
    return numeric, long.filter(F.col("cat").isNotNull()).select(*keys, "node", "cat")


def unpivot_features(events: DataFrame, nodes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Feature map (``map<string, struct<num, text>>``) to one row per event and node.

    Numeric nodes take number values only; categorical nodes take any value as text. Only
    nodes of the model's baseline are kept.
    """
    entries = events.select(*ids, F.explode("features").alias("node", "v"))
    kinds = broadcast_if_small(nodes.select("model_id", "node", "kind"))
    joined = entries.join(kinds, ["model_id", "node"])
    numeric = F.col("kind") == CONTINUOUS
    text = F.coalesce(F.col("v.text"), number_label(F.col("v.num")))
    return joined.select(
        *ids,
        "node",
        "kind",
        F.when(numeric & ~F.isnan("v.num"), F.col("v.num")).alias("num"),
        F.when(~numeric, text).alias("cat"),
    ).filter(F.col("num").isNotNull() | F.col("cat").isNotNull())


def output_node_values(events: DataFrame, ids: Sequence[str], classifier: Column) -> DataFrame:
    """Output node per event: class label for classifiers, number for regressors."""
    label = output_label(F.col("prediction"), F.col("output"))
    return events.select(
        *ids,
        F.lit(OUTPUT_NODE).alias("node"),
        F.when(classifier, CATEGORICAL).otherwise(CONTINUOUS).alias("kind"),
        F.when(~classifier & ~F.isnan("output"), F.col("output")).alias("num"),
        F.when(classifier, label).alias("cat"),
    ).filter(F.col("num").isNotNull() | F.col("cat").isNotNull())


def reference_profile(
    df: DataFrame, columns: Sequence[str], config: DriftConfig = DEFAULTS
) -> DataFrame:
    """Kind, non-null count and row count per column, in one aggregation."""
    if not columns:
        raise ValueError("the reference has no columns")
    kinds = column_kinds(df, columns)
    counted = df.agg(
        F.count("*").alias("n_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("pos"),
                    F.lit(name).alias("node"),
                    F.lit(kinds[name]).alias("kind"),
                    F.count(
                        F.nanvl(F.col(name).cast("double"), F.lit(None))
                        if kinds[name] == CONTINUOUS
                        else F.col(name)
                    ).alias("n"),
                )
                for i, name in enumerate(columns)
            ]
        ).alias("features"),
    )
    too_few = F.concat(
        F.lit("the reference has too few rows: "), F.col("n_rows").cast("string")
    )
    checked = counted.withColumn(
        "n_rows",
        F.when(F.col("n_rows") >= config.min_reference_rows, F.col("n_rows")).otherwise(
            F.raise_error(too_few).cast("bigint")
        ),
    )
    return checked.select("n_rows", F.explode("features").alias("f")).select("f.*", "n_rows")


def category_proportions(text: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each category among the non-null values of (keys, node)."""
    group = [*keys, "node"]
    counts = text.filter(F.col("cat").isNotNull()).groupBy(*group, "cat").agg(
        F.count("*").alias("n")
    )
    # Totals come from a second aggregation: a window would put a whole node in one task.
    totals = counts.groupBy(*group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).select(
        *group, F.col("cat").alias("category"), "n", (F.col("n") / F.col("total")).alias("prop")
    )


def with_row_hash(df: DataFrame, row_key: Column) -> DataFrame:
    """Adds the row key as text and its md5, once per row rather than once per feature."""
    keyed = df.withColumn("row_key", row_key.cast("string"))
    return keyed.withColumn("row_hash", F.md5(F.col("row_key").cast("binary")))


def _magnitude(hex_text: str) -> Column:
    """Size class of a hash: its length without leading zeros, then its first digit."""
    digits = F.ltrim(F.col(hex_text), F.lit("0"))
    lead = F.instr(F.lit("123456789abcdef"), F.left(digits, F.lit(1)))
    return F.length(digits) * 16 + lead


def hash_classes(numeric: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (keys, node, size class of the hash): at most 480 groups a node."""
    return numeric.groupBy(*keys, "node", _magnitude("row_hash").alias("class")).agg(
        F.count("*").alias("n")
    )


def reference_sample(
    numeric: DataFrame,
    keys: Sequence[str],
    cap: int | None = DEFAULTS.baseline_cap,
    classes: DataFrame | None = None,
) -> DataFrame:
    """All values per (keys, node), or the ``cap`` of them whose row has the smallest md5.

    ``numeric`` has keys, node, value and the columns of :func:`with_row_hash`. The size classes
    of the hashes are counted first (combined on the map side). The smallest classes that
    together reach the cap hold the whole sample, so about twice the cap is ranked per node
    however large the input is.
    """
    group = [*keys, "node"]
    if cap is None:
        return numeric.select(*group, "value")
    counted = classes if classes is not None else stored(hash_classes(numeric, keys), "classes")
    below = Window.partitionBy(*group).orderBy("class")
    cut = (
        counted.withColumn("upto", F.sum("n").over(below))
        .filter(F.col("upto") - F.col("n") < cap)
        .groupBy(*group)
        .agg(F.max("class").alias("_cut"))
    )
    # One row per baseline node, from the stored counts.
    kept = numeric.join(broadcast_if_small(cut), group).filter(
        _magnitude("row_hash") <= F.col("_cut")
    )
    rank = Window.partitionBy(*group).orderBy("row_hash", "row_key", "value")
    return (
        kept.withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= cap)
        .select(*group, "value")
    )


def representative_row(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row, in ``order``, with a value in every feature."""
    return df.dropna(subset=list(columns)).orderBy(*order).limit(1).select(*columns)


def _first(outputs: DataFrame, order: Sequence[str], rows: int | None) -> DataFrame:
    # A distributed index: no single task sorts a very large model.
    if rows is None:
        return outputs
    return dense_index(outputs, ["model_id"], order, "_row").filter(F.col("_row") < rows)


def output_baseline(
    outputs: DataFrame, order: Sequence[str] = (), rows: int | None = DEFAULTS.output_rows
) -> DataFrame:
    """Class shares over all reference rows, or the first ``rows`` in ``order``, per model.

    ``outputs`` has model_id, prediction, output.
    """
    labelled = output_node_values(_first(outputs, order, rows), ["model_id"], F.lit(True))
    return category_proportions(labelled, ["model_id"])


def output_baseline_values(
    outputs: DataFrame, order: Sequence[str] = (), rows: int | None = DEFAULTS.output_rows
) -> DataFrame:
    """Regression form of :func:`output_baseline`: the output values themselves."""
    return output_node_values(_first(outputs, order, rows), ["model_id"], F.lit(False)).select(
        "model_id", "node", F.col("num").alias("value")
    )


def feature_spread(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population standard deviation per node; a constant feature counts as 1."""
    return long.groupBy(*keys, "node").agg(
        F.coalesce(F.nullif(F.stddev_pop("num"), F.lit(0.0)), F.lit(1.0)).alias("spread")
    )


def _linear_quantiles(values: DataFrame, group: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``raw``: linear interpolation between neighbours, from the nearer one; ``baseline_n``.

    Ranks are a distributed running sum over the distinct values; only the two neighbours of
    each point are gathered, so a node may have any number of values.
    """
    marks = values.groupBy(*group, "value").agg(F.count("*").alias("b"))
    chunks = range_chunks(marks, group, ["value"])
    ranked = running(chunks, group, CHUNK, ["value"], sums={"le": F.col("b")})
    sizes = stored(marks.groupBy(*group).agg(F.sum("b").alias("baseline_n")), "sizes")
    # Places of the neighbours, counted from 0.
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(points)]))
    last = F.col("baseline_n") - 1
    place = F.col("at.p") * last
    low = F.floor(place)
    wanted = sizes.withColumn("at", each).select(
        *group, "at.i", (place - low).alias("part"), low.alias("low"), F.least(low + 1, last).alias("high")
    )
    asked = wanted.groupBy(*group).agg(F.collect_list(F.struct("i", "part", "low", "high")).alias("asked"))
    held = lambda place: (place >= F.col("le") - F.col("b")) & (place < F.col("le"))
    met = ranked.join(broadcast_if_small(stored(asked, "asked")), group).withColumn(
        "met", F.filter("asked", lambda w: held(w["low"]) | held(w["high"]))
    )
    near = (
        met.filter(F.size("met") > 0)
        .select(*group, "value", "le", "b", F.explode("met").alias("w"))
        .groupBy(*group, "w.i", "w.part")
        .agg(
            F.max(F.when(held(F.col("w.low")), F.col("value"))).alias("a"),
            F.max(F.when(held(F.col("w.high")), F.col("value"))).alias("z"),
        )
    )
    a, z, part = F.col("a"), F.col("z"), F.col("part")
    value = F.when(part < 0.5, a + (z - a) * part).otherwise(z - (z - a) * (1 - part))
    raw = near.groupBy(*group).agg(F.collect_list(value).alias("raw"))
    return raw.join(broadcast_if_small(sizes), group)


def quantile_edges(
    values: DataFrame, bins: int = DEFAULTS.psi_bins, keys: Sequence[str] = ("model_id",),
    approximate: bool = False,
) -> DataFrame:
    """De-duplicated linear-interpolated quantiles, outer edges open.

    Exact for any number of values; ``approximate`` reads them once and sorts nothing.
    """
    # Evenly spaced as multiples of one step: 3 * 0.1, not 0.3.
    points = [*[i * (1.0 / bins) for i in range(bins)], 1.0]
    if approximate:
        raw = F.percentile_approx("value", F.array(*[F.lit(p) for p in points]), F.lit(10_000))
        found = values.groupBy(*keys, "node").agg(raw.alias("raw"), F.count("*").alias("baseline_n"))
    else:
        # The built-in percentile rounds differently where an edge falls on a value, which
        # moves that value to another bin; so the interpolation is written out.
        found = _linear_quantiles(values, [*keys, "node"], points)
    low, high = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    return (
        found.withColumn("raw", F.array_sort(F.array_distinct("raw")))
        .select(
            *keys,
            "node",
            "baseline_n",
            F.when(F.size("raw") > 1, F.concat(low, _inner("raw"), high))
            .otherwise(high)
            .alias("edges"),
            (F.size("raw") - 1).alias("n_bins"),
        )
    )


def _inner(edges: str) -> Column:
    """Edges without the first and the last."""
    size = F.size(edges)
    return F.slice(F.col(edges), F.lit(2), F.greatest(size - 2, F.lit(0)))


WRITTEN_OUT = 64  # edges that are compared one by one


def most_edges(edges: DataFrame) -> int:
    """Size of the largest array of ``edges`` in a table of one row per node."""
    return edges.agg(F.max(F.size("edges"))).first()[0] or 0


def bin_of(value: Column | str, edges: Column | str, most: int | None = None) -> Column:
    """Half-open bin of a value: the number of inner edges at or below it.

    With ``most``, the largest number of edges (see :func:`most_edges`), the comparisons are written out, so that they are
    compiled; a function over the array is interpreted for every row.
    """
    v = F.col(value) if isinstance(value, str) else value
    below = lambda e: (e <= v) & (e > F.lit(float("-inf")))
    if most is None or most > WRITTEN_OUT:
        return F.when(F.size(edges) > 2, F.size(F.filter(edges, below))).otherwise(0)
    found = F.lit(0)
    for i in range(most):
        found = found + F.when(below(F.get(edges, F.lit(i))), 1).otherwise(0)
    return F.when(F.size(edges) > 2, found).otherwise(0)


def baseline_bins(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Baseline share of every bin, empty bins included."""
    key = ["model_id", "node"]
    grid = (
        edges.filter(F.col("n_bins") > 0)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)))
        .select(
            *key,
            "baseline_n",
            "n_bins",
            "bin",
            F.get("edges", F.col("bin")).alias("low"),
            F.get("edges", F.col("bin") + 1).alias("high"),
        )
    )
    counts = (
        values.join(edges.select(*key, "edges"), key)
        .groupBy(*key, bin_of("value", "edges", most_edges(edges)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("baseline_n")
    return grid.join(counts, [*key, "bin"], "left").select(
        *grid.columns, share.alias("baseline_prop")
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def bin_labels(edges: pd.Series) -> pd.Series:
    """``[low, high)`` with four significant digits, one call per node of the baseline."""
    return edges.map(
        lambda e: None if e is None else [f"[{a:.4g}, {b:.4g})" for a, b in zip(e[:-1], e[1:])]
    )


def build_baseline(
    reference: DataFrame,
    columns: Sequence[str],
    row_key: Column,
    config: DriftConfig = DEFAULTS,
    output_categories: DataFrame | None = None,
    output_values: DataFrame | None = None,
) -> Baseline:
    """Baseline tables from reference rows with model_id and the feature ``columns``.

    All reference rows count unless ``config.baseline_cap`` is set; then the numeric columns
    are read twice (hash classes, then the sample). The text columns are read once. ``output_categories`` (see :func:`output_baseline`) adds the
    output node of classifiers, ``output_values`` (see :func:`output_baseline_values`) that of regressors; a model
    belongs to one of the two. The output node is never sampled.
    """
    key = ["model_id", "node"]
    numbers, texts = split_columns(reference, columns)
    shares_of = category_proportions(
        collect_batch_categories(reference, ["model_id"], texts), ["model_id"]
    )
    if output_categories is not None:
        shares_of = shares_of.unionByName(output_categories)
    categories = stored(shares_of, "baseline-categories")
    if config.baseline_cap is None:
        numeric = collect_batch_features(reference, ["model_id"], numbers)
        kept = reference_sample(numeric, ["model_id"], None).select(*key, "value")
        counts = None
    else:
        hashed = with_row_hash(reference, row_key)
        numeric = collect_batch_features(hashed, ["model_id", "row_hash", "row_key"], numbers)
        classes = stored(hash_classes(numeric, ["model_id"]), "classes")
        kept = reference_sample(numeric, ["model_id"], config.baseline_cap, classes).select(*key, "value")
        counts = classes.groupBy(*key).agg(F.sum("n").alias("n"))
    if output_values is not None:
        kept = kept.unionByName(output_values.select(*key, "value"))
    values = stored(kept, "baseline-values")
    held = values.groupBy(*key).agg(F.count("*").alias("n"))
    counts = held if counts is None else counts.unionByName(held.filter(F.col("node") == OUTPUT_NODE))
    edges = stored(quantile_edges(values, config.psi_bins), "edges")
    # A handful of bins per node, in bin order.
    in_order = F.array_sort(F.collect_list(F.struct("bin", "baseline_prop")))
    shares = baseline_bins(values, edges).groupBy(*key).agg(
        F.transform(in_order, lambda s: s["baseline_prop"]).alias("base_props")
    )
    continuous = counts.select(*key, F.lit(CONTINUOUS).alias("kind"), "n")
    categorical = categories.groupBy(*key).agg(
        F.lit(CATEGORICAL).alias("kind"), F.sum("n").alias("n")
    )
    nodes = (
        continuous.unionByName(categorical)
        .join(edges.withColumnRenamed("baseline_n", "sampled"), key, "left")
        .join(shares, key, "left")
        .select(
            *key,
            "kind",
            "n",
            F.coalesce("sampled", "n").alias("baseline_n"),
            "n_bins",
            "edges",
            bin_labels("edges").alias("labels"),
            "base_props",
        )
    )
    return Baseline(stored(nodes, "baseline-nodes"), values, categories)


def graph_baseline(long: DataFrame, feature_nodes: DataFrame) -> DataFrame:
    """Reference rows of the graph's feature nodes only."""
    return long.join(broadcast_if_small(feature_nodes.select("node").distinct()), "node", "left_semi")
