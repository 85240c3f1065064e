"""Windows over prediction events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.config import DEFAULTS, DriftConfig
from shoreline.plans.scan import dense_index


def count_windows(
    events: DataFrame,
    size: int = DEFAULTS.window_size,
    order: Sequence[str | Column] = ("ts", "event_id"),
    group: Sequence[str] = ("model_id",),
) -> DataFrame:
    """Tumbling windows of ``size`` events in arrival order, numbered from 0 per model.

    ``order`` must be total. The trailing partial window is kept. A model that holds most
    of the events is cut into ranges like any other (see ``plans.scan``).
    """
    if size < 1:
        raise ValueError("the window size must be positive")
    indexed = dense_index(events, group, order, "_n")
    return indexed.withColumn("window_id", F.expr(f"_n div {size}")).drop("_n")


def time_windows(
    events: DataFrame, duration: str, lateness: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Event-time tumbling windows; with ``lateness`` a watermark bounds late data."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark(ts, lateness)
    return timed.withColumn("window", F.window(ts, duration))


def window_summary(
    events: DataFrame,
    features: Sequence[str],
    config: DriftConfig = DEFAULTS,
    keys: Sequence[str] = ("model_id", "window_id"),
) -> DataFrame:
    """Count, sufficiency, bounds, numeric feature means and distinct sources per window."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        (F.count("*") >= config.window_min_samples).alias("sufficient"),
        *[F.avg(f).alias(f"mean_{f}") for f in features],
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def window_bounds(
    events: DataFrame, keys: Sequence[str] = ("model_id", "window_id")
) -> DataFrame:
    """First and last event time per window."""
    return events.groupBy(*keys).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("event_count")
    )
