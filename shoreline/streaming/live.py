"""Continuous monitoring with Structured Streaming.

Each micro-batch is handled by the batch operators. Two small tables are carried from batch to
batch: the events of each model's unfilled window (fewer than the window size) and the number
of windows already closed. They are written per batch number, so a repeated batch starts from
the same state and writes the same results. A model with most of the traffic is numbered by the
distributed index and is not tied to one task, which a keyed stateful operator would do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoreline.config import DEFAULTS, DriftConfig
from shoreline.operators.drift import detect_drift
from shoreline.operators.profile import Baseline
from shoreline.operators.report import evaluate_windows
from shoreline.operators.sequences import incident_carry, incident_states, last_emitted
from shoreline.operators.windows import time_windows
from shoreline.plans.materialize import stored
from shoreline.plans.scan import dense_index
from shoreline.plans.sizing import broadcast_if_small
from shoreline.sources.history import (
    append_window_history,
    read_before,
    write_batch,
    written_batches,
)


@dataclass
class LiveWindows:
    """Count windows over a stream.

    ``evaluate(rows, batch_id)`` receives the events of the windows that closed in a batch,
    with window_id. ``path`` is shared storage for the carried state.
    """

    path: str
    evaluate: Callable[[DataFrame, int], None]
    size: int = DEFAULTS.window_size
    order: tuple[str, ...] = ("ts", "event_id")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Handler for ``foreachBatch``."""
        spark = batch.sparkSession
        open_before = read_before(spark, f"{self.path}/open", batch_id)
        closed_before = read_before(spark, f"{self.path}/closed", batch_id)
        rows = batch.withColumn("_turn", F.lit(1))
        if open_before is not None:
            rows = rows.unionByName(open_before.withColumn("_turn", F.lit(0)))
        # Events carried over arrived earlier than those of this batch.
        indexed = stored(dense_index(rows, ["model_id"], ["_turn", *self.order], "_n"), "numbered")
        totals = indexed.groupBy("model_id").agg(F.count("*").alias("_total"))
        if closed_before is None:
            counts = totals.withColumn("_closed", F.lit(0).cast("bigint"))
        else:
            counts = totals.join(closed_before, "model_id", "full_outer").select(
                "model_id",
                F.coalesce("_total", F.lit(0)).alias("_total"),
                F.coalesce("closed", F.lit(0)).alias("_closed"),
            )
        counts = stored(counts.withColumn("_full", F.expr(f"_total div {self.size}")), "counts")
        placed = indexed.join(broadcast_if_small(counts), "model_id").withColumn(
            "_w", F.expr(f"_n div {self.size}")
        )
        done = placed.filter(F.col("_w") < F.col("_full")).withColumn(
            "window_id", F.col("_w") + F.col("_closed")
        )
        self.evaluate(done.select(*batch.columns, "window_id"), batch_id)
        waiting = placed.filter(F.col("_w") >= F.col("_full")).select(*batch.columns)
        write_batch(waiting, f"{self.path}/open", batch_id)
        write_batch(
            counts.select("model_id", (F.col("_closed") + F.col("_full")).alias("closed")),
            f"{self.path}/closed",
            batch_id,
        )

    def flush(self, spark: SparkSession) -> None:
        """Close the unfilled windows at the end of a bounded run."""
        batches = written_batches(spark, f"{self.path}/closed")
        if not batches:
            return
        waiting = read_before(spark, f"{self.path}/open")
        closed = read_before(spark, f"{self.path}/closed")
        rows = waiting.join(broadcast_if_small(closed), "model_id").withColumnRenamed(
            "closed", "window_id"
        )
        if not rows.isEmpty():
            self.evaluate(rows, batches[-1] + 1)

    def start(self, events: DataFrame, checkpoint: str, *, bounded: bool = False, **trigger) -> StreamingQuery:
        """Run on a stream of events."""
        return _start(events, checkpoint, self.on_batch, bounded, trigger)


@dataclass
class LiveIncidents:
    """Incident states on a stream of window results (model_id, window_id, drifted).

    Carries one row per model between batches. States are written below ``path``.
    """

    path: str
    open_after: int = DEFAULTS.open_after
    close_after: int = DEFAULTS.close_after

    def on_batch(self, flags: DataFrame, batch_id: int) -> None:
        before = read_before(flags.sparkSession, f"{self.path}/carry", batch_id)
        states = stored(
            incident_states(flags, self.open_after, self.close_after, before=before), "states"
        )
        write_batch(states.drop("calm_at", "moved_at", "decided"), f"{self.path}/states", batch_id)
        write_batch(incident_carry(states, before), f"{self.path}/carry", batch_id)

    def start(self, flags: DataFrame, checkpoint: str, *, bounded: bool = False, **trigger) -> StreamingQuery:
        return _start(flags, checkpoint, self.on_batch, bounded, trigger)


@dataclass
class LiveMonitor:
    """The whole chain on a stream of events: windows, drift, causes, alerts, incidents, history.

    ``numeric`` and ``text`` turn the events of closed windows into values (see ``profile``);
    ``score`` fills missing outputs before that. Histories and carried state are kept below
    ``path``, one folder per batch.
    """

    path: str
    baseline: Baseline
    closure: DataFrame
    order: DataFrame
    numeric: Callable[[DataFrame], DataFrame]
    text: Callable[[DataFrame], DataFrame]
    p_method: str
    config: DriftConfig = DEFAULTS
    score: Callable[[DataFrame], DataFrame] | None = None
    with_graph: bool = True

    def __post_init__(self) -> None:
        self.windows = LiveWindows(f"{self.path}/windowing", self.evaluate, self.config.window_size)

    def evaluate(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows = stored(self.score(rows) if self.score is not None else rows, "closed")
        if rows.isEmpty():
            return
        found = detect_drift(
            self.numeric(rows),
            self.text(rows),
            rows.select("model_id", "window_id").distinct(),
            self.baseline,
            self.config,
            p_method=self.p_method,
        )
        alerts_before = read_before(spark, f"{self.path}/alert_carry", batch_id)
        incidents_before = read_before(spark, f"{self.path}/incident_carry", batch_id)
        outcome = evaluate_windows(
            rows,
            found,
            self.closure,
            self.order,
            with_graph=self.with_graph,
            cooldown=self.config.cooldown_seconds,
            open_after=self.config.open_after,
            close_after=self.config.close_after,
            alerts_before=alerts_before,
            incidents_before=incidents_before,
        )
        append_window_history(outcome.results, self.path, batch_id)
        if outcome.alerts is not None:
            write_batch(outcome.alerts, f"{self.path}/alerts", batch_id)
            write_batch(
                last_emitted(outcome.alerts, alerts_before), f"{self.path}/alert_carry", batch_id
            )
        write_batch(
            incident_carry(outcome.states, incidents_before), f"{self.path}/incident_carry", batch_id
        )

    def start(self, events: DataFrame, checkpoint: str, *, bounded: bool = False, **trigger) -> StreamingQuery:
        return self.windows.start(events, checkpoint, bounded=bounded, **trigger)

    def flush(self, spark: SparkSession) -> None:
        self.windows.flush(spark)


def _start(
    stream: DataFrame, checkpoint: str, handler: Callable, bounded: bool, trigger: dict
) -> StreamingQuery:
    """``bounded`` reads what is there and stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler)
    if bounded:
        trigger = {"availableNow": True}
    return (writer.trigger(**trigger) if trigger else writer).start()


def time_window_stream(
    events: DataFrame, duration: str, lateness: str, features: list[str]
) -> DataFrame:
    """Event-time window counts and means; windows close once the watermark has passed."""
    timed = time_windows(events, duration, lateness)
    return timed.groupBy("model_id", "window").agg(
        F.count("*").alias("event_count"), *[F.avg(f).alias(f"mean_{f}") for f in features]
    )
