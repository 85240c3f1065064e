"""Resampling and shifting of reference rows, to see what a shift would trigger."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.config import DEFAULTS, DriftConfig
from shoreline.operators.drift import detect_drift
from shoreline.operators.profile import Baseline, feature_spread, split_values
from shoreline.plans.materialize import stored
from shoreline.plans.scan import dense_index
from shoreline.plans.sizing import broadcast_if_small

SHIFT_PER_INTENSITY = 1.5  # standard deviations
JITTER = 0.05  # standard deviations


def hash_number(text: Column) -> Column:
    """60-bit integer from the md5 of a text: the same value on every run and partitioning."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def resample_reference(reference: DataFrame, order: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """``n`` rows drawn with replacement; adds ``draw`` (0 .. n-1).

    Draw i takes the row whose index is a hash of (seed, i), so a re-run task draws the same.
    """
    indexed = dense_index(reference, [], order, "_index")
    size = indexed.count()
    if size == 0:
        raise ValueError("the reference is empty")
    draws = reference.sparkSession.range(n).select(
        F.col("id").alias("draw"),
        F.pmod(
            hash_number(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))),
            F.lit(size),
        ).alias("_index"),
    )
    return indexed.join(broadcast_if_small(draws), "_index").drop("_index")


def shift_features(
    values: DataFrame,
    amount: Column,
    targets: Sequence[str] | None = None,
    keys: Sequence[str] = ("model_id",),
    jitter_key: Column | None = None,
    jitter: float = JITTER,
) -> DataFrame:
    """Move numeric nodes by ``amount`` of their standard deviations.

    ``jitter_key`` (text) adds normal noise of ``jitter`` deviations, drawn from its hash.
    """
    spread = stored(feature_spread(values.filter(F.col("num").isNotNull()), keys), "spread")
    moved = values.join(broadcast_if_small(spread), [*keys, "node"], "left")
    shift = amount * F.col("spread")
    if jitter_key is not None:
        shift = shift + unit_normal(jitter_key) * F.lit(jitter) * F.col("spread")
    chosen = F.col("num").isNotNull()
    if targets:
        chosen = chosen & F.col("node").isin(*targets)
    return moved.withColumn("num", F.when(chosen, F.col("num") + shift).otherwise(F.col("num"))).drop(
        "spread"
    )


def unit_normal(key: Column) -> Column:
    """Standard normal number from the hash of a text (Box-Muller)."""
    scale = float(1 << 60)
    u = (hash_number(F.concat(key, F.lit(":u"))) + 1) / F.lit(scale + 1)
    v = hash_number(F.concat(key, F.lit(":v"))) / F.lit(scale)
    return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def scale_shift(
    values: DataFrame, k: float, targets: Sequence[str], row_key: Column,
    keys: Sequence[str] = ("model_id",),
) -> DataFrame:
    """Shift by ``k`` deviations plus a small repeatable jitter."""
    key = F.concat_ws(":", F.col("node"), row_key.cast("string"))
    return shift_features(values, F.lit(float(k)), targets, keys, jitter_key=key)


def shift_sensitivity(
    values: DataFrame,
    baseline: Baseline,
    intensities: Sequence[float],
    targets: Sequence[str] | None = None,
    config: DriftConfig = DEFAULTS,
    *,
    p_method: str,
) -> DataFrame:
    """Drift verdicts of a sample under each shift intensity; intensity 0 is the control.

    ``values`` is the unpivoted sample (model_id, node, num, cat). All intensities run as one
    plan: the window number is the place of the intensity in the list.
    """
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).cast("bigint").alias("window_id"), F.lit(float(x)).alias("intensity"))
                for i, x in enumerate(intensities)
            ]
        )
    )
    levels = values.withColumn("_g", grid).select(*values.columns, "_g.window_id", "_g.intensity")
    # The spread is that of the unshifted sample, which is the same at every intensity.
    shifted = shift_features(
        levels, F.col("intensity") * SHIFT_PER_INTENSITY, targets, ["model_id", "window_id"]
    )
    windows = levels.select("model_id", "window_id").distinct()
    numeric, text = split_values(shifted, ["model_id", "window_id"])
    found = detect_drift(numeric, text, windows, baseline, config, p_method=p_method)
    return found.withColumn(
        "intensity", F.element_at(F.array(*[F.lit(float(x)) for x in intensities]), F.col("window_id").cast("int") + 1)
    )
