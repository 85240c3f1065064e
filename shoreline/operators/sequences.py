"""Alerts and incidents: operators on the ordered sequence of windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.config import DEFAULTS, DRIFT, OUTPUT_NODE, STABLE, WARNING
from shoreline.plans.materialize import stored
from shoreline.plans.scan import CHUNK, running

WINDOW = ("model_id", "window_id")
WINDOWS_PER_CHUNK = 100_000
# A cool-down block spans this many cool-downs: a key's blocks are folded in parallel.
COOLDOWNS_PER_BLOCK = 1000


def window_status(node_drift: DataFrame) -> DataFrame:
    """DRIFT / WARNING / STABLE per window from its features.

    The output node counts for ``any_drift`` (incidents) but not for ``status``.
    """
    feature = F.col("node") != OUTPUT_NODE
    verdict = F.col("verdict")
    return (
        node_drift.groupBy(*WINDOW)
        .agg(
            F.count_if(feature & (verdict == DRIFT)).alias("drifted_count"),
            F.count_if(feature & (verdict == WARNING)).alias("warning_count"),
            F.count_if(verdict == "INSUFFICIENT_DATA").alias("n_insufficient"),
            F.bool_or(verdict == DRIFT).alias("any_drift"),
        )
        .withColumn(
            "status",
            F.when(F.col("drifted_count") > 0, DRIFT)
            .when(F.col("warning_count") > 0, WARNING)
            .otherwise(STABLE),
        )
    )


def incident_code(root: Column, model: Column, window: Column) -> Column:
    """Stable alert id: sha1 prefix of root, model version and window."""
    text = F.concat_ws(":", root, model, window.cast("string"))
    return F.concat(F.lit("inc-"), F.substring(F.sha1(text.cast("binary")), 1, 12))


def root_cause_alerts(ranked: DataFrame, paths: DataFrame, times: DataFrame) -> DataFrame:
    """One candidate alert per root and window; symptoms never alert.

    ``times`` has model_id, window_id, ts (epoch seconds, the alert clock).
    """
    return (
        ranked.select(*WINDOW, "node", "severity")
        .join(paths, [*WINDOW, "node"])
        .join(times, list(WINDOW))
        .select(
            incident_code(F.col("node"), F.col("model_id"), F.col("window_id")).alias("incident_id"),
            F.col("node").alias("root_cause"),
            *WINDOW,
            "symptom_path",
            "severity",
            "ts",
        )
    )


def _next_index(t: np.ndarray, cooldown: float) -> np.ndarray:
    """For each time the first time at least one cool-down later."""
    return np.searchsorted(t, t + cooldown, side="left")


def alert_cooldown(
    alerts: DataFrame,
    cooldown: float = DEFAULTS.cooldown_seconds,
    cooldowns_per_block: int = COOLDOWNS_PER_BLOCK,
    before: DataFrame | None = None,
) -> DataFrame:
    """Adds ``emitted``: greedy suppression within ``cooldown`` of the last emitted alert.

    ``alerts`` has root_cause, model_id, window_id and ts; ``before`` (root_cause, model_id,
    last_ts) is what earlier batches emitted last. The rule is sequential per key, but
    a block of time only depends on the past through the last emission before it. Each block is
    therefore summarised in parallel (for every alert that could be its first emission: the
    last one that follows from it), the summaries of a key are chained, and the blocks are then
    replayed in parallel. A key that holds most alerts is spread over its blocks.
    """
    if cooldown <= 0:
        return alerts.withColumn("emitted", F.lit(True))
    key = ["root_cause", "model_id"]
    span = float(cooldown) * cooldowns_per_block
    # At most one alert per key and time can be emitted: the one of the first window.
    marked = alerts.withColumn("_block", F.floor(F.col("ts") / F.lit(span)))
    times = marked.groupBy(*key, "_block", "ts").agg(F.min("window_id").alias("_first"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["ts"].to_numpy(dtype=float))
        nxt = _next_index(t, cooldown)
        last = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        # The first emission is the first alert at or after (last emission + cool-down), and
        # that is less than one cool-down into the block, or the block's first alert after it.
        start = pdf["_block"].iloc[0] * span
        zone = min(len(t), int(np.searchsorted(t, start + cooldown, side="left")) + 1)
        return pd.DataFrame(
            {
                **{k: pdf[k].iloc[0] for k in key},
                "_block": pdf["_block"].iloc[0],
                "first": t[:zone],
                "exit": t[last[:zone]],
            }
        )

    def chain(pdf: pd.DataFrame, past: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({k: [] for k in [*key, "_block", "ready"]})
        pdf = pdf.sort_values(["_block", "first"])
        blocks = pdf["_block"].to_numpy()
        first, leave = pdf["first"].to_numpy(), pdf["exit"].to_numpy()
        ready = -np.inf if past.empty else float(past["last_ts"].iloc[0]) + cooldown
        rows: list[tuple[int, float]] = []
        bounds = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows.append((int(blocks[a]), ready))
            at = a + int(np.searchsorted(first[a:b], ready, side="left"))
            if at < b:
                ready = leave[at] + cooldown
        out = pd.DataFrame(rows, columns=["_block", "ready"])
        for k in key:
            out[k] = pdf[k].iloc[0]
        return out[[*key, "_block", "ready"]]

    def replay(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("ts")
        t = left["ts"].to_numpy(dtype=float)
        nxt = _next_index(t, cooldown)
        at = int(np.searchsorted(t, right["ready"].iloc[0], side="left"))
        kept = []
        while at < len(t):
            kept.append(at)
            at = int(nxt[at])
        return left.iloc[kept][[*key, "_block", "ts", "_first"]]

    types = {f.name: f.dataType.simpleString() for f in marked.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in key) + ", _block bigint"
    entries = times.groupBy(*key, "_block").applyInPandas(
        summarise, f"{head}, first double, exit double"
    )
    past = (
        before.select(*key, F.col("last_ts").cast("double").alias("last_ts"))
        if before is not None
        else alerts.select(*key, F.lit(0.0).alias("last_ts")).limit(0)
    )
    ready = (
        entries.groupBy(*key)
        .cogroup(past.groupBy(*key))
        .applyInPandas(chain, f"{head}, ready double")
    )
    emitted = (
        times.groupBy(*key, "_block")
        .cogroup(ready.groupBy(*key, "_block"))
        .applyInPandas(replay, f"{head}, ts {types['ts']}, _first {types['window_id']}")
    )
    hits = emitted.select(*key, "ts", F.col("_first").alias("window_id"), F.lit(True).alias("_hit"))
    return alerts.join(hits, [*key, "ts", "window_id"], "left").withColumn(
        "emitted", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def last_emitted(cooled: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Time of the last emitted alert per key, to be given to the next batch."""
    now = cooled.filter("emitted").select(
        "root_cause", "model_id", F.col("ts").cast("double").alias("last_ts")
    )
    both = now if before is None else now.unionByName(before)
    return both.groupBy("root_cause", "model_id").agg(F.max("last_ts").alias("last_ts"))


def suppressed_alerts(cooled: DataFrame) -> DataFrame:
    """Candidates held back by the cool-down."""
    return cooled.filter(~F.col("emitted")).drop("emitted")


_CARRY = ("calm_at", "moved_at", "decided")


def incident_states(
    flags: DataFrame,
    open_after: int = DEFAULTS.open_after,
    close_after: int = DEFAULTS.close_after,
    chunk_size: int = WINDOWS_PER_CHUNK,
    before: DataFrame | None = None,
) -> DataFrame:
    """:func:`incident_lifecycle` with the columns that :func:`incident_carry` keeps.

    Streaks, the last deciding window and the number of openings are running maxima and sums,
    so the windows of one model are processed in chunks. ``before`` is the carry of earlier
    batches: it enters as one row per model in front of the new windows.
    """
    group, order = ["model_id"], ["window_id"]
    at, drifted, seed = F.col("window_id"), F.col("drifted"), F.col("_seed")
    own = flags.columns
    rows = flags.withColumn("_seed", F.lit(False))
    kept = {c: F.lit(None).cast("bigint") for c in ("_calm_at", "_moved_at", "_decided", "_opened")}
    rows = rows.select("*", *[c.alias(n) for n, c in kept.items()])
    if before is not None:
        known = before.select(
            "model_id", "window_id", F.lit(False).alias("drifted"), F.lit(True).alias("_seed"),
            F.col("calm_at").alias("_calm_at"), F.col("moved_at").alias("_moved_at"),
            F.col("decided").alias("_decided"), F.col("incident_no").alias("_opened"),
        )
        rows = rows.unionByName(known, allowMissingColumns=True)
    base = rows.withColumn(CHUNK, F.expr(f"window_id div {int(chunk_size)}"))
    runs = running(
        base, group, CHUNK, order,
        maxima={
            "calm_at": F.when(seed, F.col("_calm_at")).when(~drifted, at),
            "moved_at": F.when(seed, F.col("_moved_at")).when(drifted, at),
        },
    )
    # A streak reaches back to the last window with the other flag.
    other = F.when(drifted, F.col("calm_at")).otherwise(F.col("moved_at"))
    streak = at - F.coalesce(other, F.lit(-1))
    decides = (
        F.when(seed, F.col("_decided"))
        .when(drifted & (streak >= open_after), at * 2 + 1)
        .when(~drifted & (streak >= close_after), at * 2)
    )
    # Each scan reads its input twice, so the one-row-per-window tables between them are stored.
    marked = stored(runs.withColumn("_decides", decides), "incident-marks")
    states = running(
        marked, group, CHUNK, order,
        maxima={"decided": F.col("_decides")},
        maxima_before={"_previous": F.col("_decides")},
    )
    is_open = F.coalesce(F.col("decided") % 2 == 1, F.lit(False))
    was_open = F.coalesce(F.col("_previous") % 2 == 1, F.lit(False))
    turned = states.withColumn(
        "transition",
        F.when(seed, F.lit(None).cast("string")).when(is_open & ~was_open, "OPENED").when(was_open & ~is_open, "CLOSED"),
    ).withColumn("incident_status", F.when(is_open, "OPEN"))
    turned = stored(turned, "incident-turns")
    opened = (F.coalesce(F.col("transition"), F.lit("")) == "OPENED").cast("bigint")
    counted = F.coalesce(F.when(seed, F.col("_opened")), opened)
    numbered = running(turned, group, CHUNK, order, sums={"incident_no": counted})
    return numbered.filter(~seed).select(
        *own, "incident_no", "incident_status", "transition", *_CARRY
    )


def incident_carry(states: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """What the next batch needs: one row per model."""
    fields = ["model_id", "window_id", "incident_no", *_CARRY]
    rows = states.select(*fields)
    if before is not None:
        rows = rows.unionByName(before.select(*fields))
    rest = F.struct(*[c for c in fields if c != "model_id"])
    return rows.groupBy("model_id").agg(F.max_by(rest, "window_id").alias("s")).select(
        "model_id", "s.*"
    )


def incident_lifecycle(
    flags: DataFrame,
    open_after: int = DEFAULTS.open_after,
    close_after: int = DEFAULTS.close_after,
    chunk_size: int = WINDOWS_PER_CHUNK,
) -> DataFrame:
    """Incident state after each window.

    ``flags`` has model_id, window_id (0, 1, 2, ... per model) and drifted. Adds ``incident_no``
    (incidents opened so far), ``incident_status`` (OPEN or null) and ``transition`` (OPENED,
    CLOSED or null).
    """
    return incident_states(flags, open_after, close_after, chunk_size).drop(*_CARRY)


def incident_summary(
    states: DataFrame, open_after: int = DEFAULTS.open_after
) -> DataFrame:
    """One row per incident.

    ``states`` is :func:`incident_lifecycle` with root_cause and symptom_path per window. The
    drifted windows before the opening count; cause and path are the first ones known.
    """
    at = F.col("window_id")
    live = F.col("drifted") & (F.col("incident_status") == "OPEN")
    has_path = F.size(F.coalesce("symptom_path", F.array().cast("array<string>"))) > 0
    return (
        states.filter((F.col("incident_status") == "OPEN") | (F.col("transition") == "CLOSED"))
        .groupBy("model_id", "incident_no")
        .agg(
            F.min(F.when(F.col("transition") == "OPENED", at)).alias("opened_window"),
            (F.count_if(live) + F.lit(open_after - 1)).alias("drifted_windows"),
            F.max(F.when(live, at)).alias("last_window"),
            F.min_by("root_cause", F.when(live & F.col("root_cause").isNotNull(), at)).alias(
                "root_cause"
            ),
            F.min_by("symptom_path", F.when(live & has_path, at)).alias("symptom_path"),
            F.max(F.when(F.col("transition") == "CLOSED", at)).alias("closed_window"),
        )
        .withColumn("status", F.when(F.col("closed_window").isNull(), "OPEN").otherwise("CLOSED"))
        .withColumn("incident_id", F.format_string("live-inc-%04d", F.col("incident_no")))
    )


def incident_snapshot(incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The open incident of each model, and the closed ones."""
    return incidents.filter(F.col("status") == "OPEN"), incidents.filter(F.col("status") == "CLOSED")
