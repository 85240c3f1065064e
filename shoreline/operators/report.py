"""Window records, reports and the queries on their history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.config import DEFAULTS, OUTPUT_NODE
from shoreline.operators import rca, sequences
from shoreline.operators.windows import window_bounds
from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

WINDOW = ("model_id", "window_id")
_ALERTS = "array<struct<incident_id: string, root_cause: string, symptom_path: array<string>>>"


def output_drift(node_drift: DataFrame) -> DataFrame:
    """The output node's own block per window."""
    return node_drift.filter(F.col("node") == OUTPUT_NODE).select(
        *WINDOW, "verdict", "statistic", "p_value", "psi", F.col("current_n").alias("samples")
    )


@dataclass(frozen=True)
class Evaluation:
    """Window records with the tables that the next batch continues from."""

    results: DataFrame
    alerts: DataFrame | None
    states: DataFrame


def window_results(*args, **options) -> DataFrame:
    """The window records of :func:`evaluate_windows`."""
    return evaluate_windows(*args, **options).results


def evaluate_windows(
    events: DataFrame,
    node_drift: DataFrame,
    closure: DataFrame,
    order: DataFrame,
    *,
    model_version: Column | None = None,
    session_id: Column | None = None,
    with_graph: bool = True,
    cooldown: float = 0,
    graph_nodes: list[str] | None = None,
    graph_edges: list[list[str]] | None = None,
    open_after: int = DEFAULTS.open_after,
    close_after: int = DEFAULTS.close_after,
    alerts_before: DataFrame | None = None,
    incidents_before: DataFrame | None = None,
) -> Evaluation:
    """One record per window: bounds, status, per-feature results, causes, alerts, incident.

    ``events`` has model_id, window_id, ts. Everything is keyed by (model_id, window_id).
    """
    node_drift = stored(node_drift, "node-drift")
    roots = rca.rca_roots(node_drift, closure)
    ranked = stored(rca.root_severity(roots), "roots")
    paths = stored(rca.symptom_paths(node_drift, ranked, closure, order), "paths")
    symptoms = rca.rca_symptoms(node_drift, closure).groupBy(*WINDOW).agg(
        F.array_sort(F.collect_list("node")).alias("symptoms")
    )
    bounds = window_bounds(events)
    status = sequences.window_status(node_drift)
    feature = F.struct(
        "verdict",
        F.col("statistic").alias("ks_statistic"),
        F.col("p_value").alias("ks_p_value"),
        "psi",
    )
    drifted = (F.col("verdict") == "DRIFT") & (F.col("node") != OUTPUT_NODE)
    features = node_drift.groupBy(*WINDOW).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", feature.alias("r"))))).alias(
            "per_feature"
        ),
        F.array_sort(F.collect_list(F.when(drifted, F.col("node")))).alias("drifted_features"),
        F.first(
            F.when(
                F.col("node") == OUTPUT_NODE,
                F.struct("verdict", "statistic", "p_value", "psi", F.col("current_n").alias("samples")),
            ),
            ignorenulls=True,
        ).alias("output_drift"),
    )
    candidates = ranked.groupBy(*WINDOW).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda s: s["node"]
        ).alias("root_cause_candidates")
    )
    first = rca.primary_root(ranked, paths).select(
        *WINDOW,
        F.col("root_cause").alias("primary_root_cause"),
        F.col("symptom_path").alias("primary_symptom_path"),
    )
    none = F.array().cast("array<string>")
    base = (
        bounds.join(status, list(WINDOW))
        .join(features, list(WINDOW))
        .join(candidates, list(WINDOW), "left")
        .join(symptoms, list(WINDOW), "left")
        .join(first, list(WINDOW), "left")
    )
    if with_graph:
        times = bounds.select(*WINDOW, F.col("end_ts").cast("timestamp").cast("double").alias("ts"))
        cooled = stored(
            sequences.alert_cooldown(
                sequences.root_cause_alerts(ranked, paths, times), cooldown, before=alerts_before
            ),
            "alerts",
        )
        alerts = cooled.filter("emitted").groupBy(*WINDOW).agg(
            F.array_sort(
                F.collect_list(F.struct("incident_id", "root_cause", "symptom_path"))
            ).alias("alerts")
        )
        base = base.join(alerts, list(WINDOW), "left")
    else:
        cooled = None
        base = base.withColumn("alerts", F.lit(None).cast(_ALERTS))
    flags = status.select(*WINDOW, F.col("any_drift").alias("drifted"))
    all_states = stored(
        sequences.incident_states(flags, open_after, close_after, before=incidents_before),
        "incident-states",
    )
    states = all_states.select(
        *WINDOW,
        F.when(
            F.col("incident_status") == "OPEN", F.format_string("live-inc-%04d", F.col("incident_no"))
        ).alias("incident_id"),
        "incident_status",
    )
    nodes = F.array(*[F.lit(n) for n in graph_nodes or []]).cast("array<string>")
    edges = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in graph_edges or []]).cast(
        "array<array<string>>"
    )
    results = base.join(states, list(WINDOW)).select(
        (F.col("window_id") + 1).alias("sequence"),
        "model_id",
        (model_version if model_version is not None else F.col("model_id")).alias("model_version"),
        (session_id if session_id is not None else F.lit(None).cast("string")).alias("session_id"),
        nodes.alias("graph_nodes"),
        edges.alias("graph_edges"),
        "window_id",
        F.col("start_ts").alias("start_timestamp"),
        F.col("end_ts").alias("end_timestamp"),
        "event_count",
        "status",
        "any_drift",
        "n_insufficient",
        "drifted_features",
        "drifted_count",
        "per_feature",
        "output_drift",
        F.lit(with_graph).alias("dependencies_available"),
        F.col("root_cause_candidates").isNotNull().alias("has_root_cause"),
        F.coalesce("root_cause_candidates", none).alias("root_cause_candidates"),
        "primary_root_cause",
        F.coalesce("symptoms", none).alias("symptoms"),
        F.coalesce("primary_symptom_path", none).alias("primary_symptom_path"),
        "alerts",
        "incident_id",
        "incident_status",
        F.current_timestamp().alias("evaluated_at"),
    )
    return Evaluation(results, cooled, all_states)


def monitoring_report(
    node_drift: DataFrame,
    closure: DataFrame,
    order: DataFrame,
    alerts: DataFrame,
    *,
    edges: DataFrame | None = None,
    windows: DataFrame | None = None,
    baseline_version: str | None = None,
    dataset_version: str | None = None,
    code_commit: str | None = None,
) -> DataFrame:
    """Report row and Markdown text per window.

    ``alerts`` has model_id, window_id, incident_id, root_cause (the emitted ones), ``edges`` the
    declared graph, ``windows`` model_id, window_id and ended_at. Lists are bounded by the nodes of a model.
    Report ids follow from model, window and baseline, so a repeated batch gives the same ones.
    """
    classified = rca.classify_nodes(node_drift, closure)
    ranked = stored(rca.root_severity(rca.rca_roots(node_drift, closure)), "roots")
    paths = rca.symptom_paths(node_drift, ranked, closure, order)
    tests = F.concat_ws(
        ", ",
        F.concat(F.lit("distribution test "), F.col("ks_verdict")),
        F.concat(F.lit("stability index "), F.col("psi_verdict")),
    )
    line = F.concat(F.lit("* "), F.col("node"), F.lit(": "), F.col("classification"), F.lit(" ("), tests, F.lit(")"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["line"]), "\n")
    names_where = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("node"))))
    result = F.struct("verdict", "statistic", "p_value", "psi", "current_n", "baseline_n")
    nodes = classified.groupBy(*WINDOW).agg(
        lines(F.collect_list(F.struct("node", line.alias("line")))).alias("node_lines"),
        F.count("*").alias("node_count"),
        names_where(F.col("verdict") == "DRIFT").alias("drifted_nodes"),
        names_where(F.col("classification") == "SYMPTOM").alias("symptoms"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("node", "classification")))
        ).alias("classifications"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", result.alias("result"))))).alias("drift"),
    )
    follows = F.when(
        F.size("symptom_path") > 0, F.concat(F.lit(", then "), F.array_join("symptom_path", ", "))
    ).otherwise("")
    cause = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("node"), F.lit(" at "),
        F.format_string("%.3f", F.col("severity")), follows,
    )
    found = ranked.join(paths, [*WINDOW, "node"])
    causes = found.groupBy(*WINDOW).agg(
        lines(F.collect_list(F.struct("rank", cause.alias("line")))).alias("cause_lines"),
        F.array_sort(F.collect_list(F.struct("rank", "node", "severity", "symptom_path"))).alias("root_causes"),
    )
    alert = F.concat(F.lit("* "), F.col("root_cause"), F.lit(" as "), F.col("incident_id"))
    alert_lines = alerts.groupBy(*WINDOW).agg(
        lines(F.collect_list(F.struct("root_cause", alert.alias("line")))).alias("alert_lines"),
        F.count("*").alias("alert_count"),
        F.min_by("incident_id", "root_cause").alias("incident_id"),
    )
    model = [c for c in ("model_id",) if c in order.columns]
    placed = order.groupBy(*model).agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("_n"))
    graph = placed.select(*model, F.transform("_n", lambda n: n["node"]).alias("graph_nodes"))
    if not model:  # one graph for all models: a table of one row
        model, graph = ["_one"], graph.withColumn("_one", F.lit(1))
    if edges is not None:
        pairs = edges if model == ["model_id"] else edges.withColumn("_one", F.lit(1))
        pairs = pairs.groupBy(*model).agg(F.array_sort(F.collect_list(F.array("parent", "child"))).alias("graph_edges"))
        graph = graph.join(pairs, model, "left")
    graph = broadcast_if_small(stored(graph, "graphs"))
    rows = nodes.join(causes, list(WINDOW), "left").join(alert_lines, list(WINDOW), "left")
    rows = rows.withColumn("_one", F.lit(1)).join(graph, model, "left")
    if windows is not None:
        rows = rows.join(windows.select(*WINDOW, "ended_at"), list(WINDOW), "left")
    versions = {"baseline": baseline_version, "data": dataset_version, "code": code_commit}
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("model_id"), F.lit(", window "), F.col("window_id").cast("string")),
        F.lit(", ".join(f"{k} {v}" for k, v in versions.items() if v is not None) or "no versions given"),
        F.concat(F.size("drifted_nodes").cast("string"), F.lit(" of "), F.col("node_count").cast("string"), F.lit(" nodes drift.")),
        F.lit("\n## Nodes"),
        F.col("node_lines"),
        F.lit("\n## Where it starts"),
        F.coalesce("cause_lines", F.lit("No feature starts a drift in this window.")),
        F.when(F.size("symptoms") > 0, F.concat(F.lit("Carried on by: "), F.array_join("symptoms", ", "))),
        F.lit("\n## Alerts sent"),
        F.coalesce("alert_lines", F.lit("nothing")),
    )
    version = lambda v: F.lit(v).cast("string")
    return rows.select(
        F.concat(F.lit("rpt-"), F.substring(F.sha1(F.concat_ws(":", "model_id", "window_id", version(baseline_version))), 1, 12)).alias("report_id"),
        *WINDOW,
        "incident_id",
        *(["ended_at"] if windows is not None else []),
        version(baseline_version).alias("baseline_version"),
        version(dataset_version).alias("dataset_version"),
        version(code_commit).alias("code_commit"),
        "classifications",
        "drift",
        "drifted_nodes",
        "symptoms",
        F.col("cause_lines").isNotNull().alias("has_root_cause"),
        "root_causes",
        F.coalesce("alert_count", F.lit(0)).alias("alert_count"),
        "graph_nodes",
        *(["graph_edges"] if edges is not None else []),
        text.alias("markdown"),
    )


def latest_report(reports: DataFrame, active: DataFrame) -> DataFrame:
    """Newest report of each active model, or the reason there is none.

    ``reports`` has model_id, window_id, ts; ``active`` has model_id.
    """
    newest = reports.groupBy("model_id").agg(
        F.max_by(F.struct(*[c for c in reports.columns if c != "model_id"]), F.struct("ts", "window_id")).alias(
            "report"
        )
    )
    return active.select("model_id").join(newest, "model_id", "left").select(
        "model_id",
        F.col("report").isNotNull().alias("available"),
        F.when(F.col("report").isNull(), "no monitoring report yet").alias("detail"),
        "report",
    )


def scope_to_model(records: DataFrame, model_id: str | None) -> DataFrame:
    """Records of one model; no model gives none, records without a model never match."""
    return records.filter(F.col("model_id") == F.lit(model_id).cast("string"))


def window_history(
    results: DataFrame, limit: int | None, model_id: str | None = None, all_models: bool = False
) -> DataFrame:
    """Last ``limit`` windows of a model, or of all of them, newest first."""
    rows = results if all_models else scope_to_model(results, model_id)
    ordered = rows.orderBy(F.col("sequence").desc(), "model_id")
    return ordered.limit(limit) if limit else ordered


def monitoring_counters(
    node_drift: DataFrame, roots: DataFrame, cooled_alerts: DataFrame
) -> DataFrame:
    """Totals over the result tables, one pass over each."""
    per_window = node_drift.groupBy(*WINDOW).agg(
        F.count("*").alias("nodes"), F.count_if(F.col("verdict") == "DRIFT").alias("drifted")
    )
    parts = [
        per_window.agg(
            F.count("*").alias("windows_processed"),
            F.sum("nodes").alias("nodes_checked"),
            F.sum("drifted").alias("drifted_nodes"),
        ),
        roots.agg(F.count("*").alias("root_causes")),
        cooled_alerts.agg(
            F.count_if("emitted").alias("alerts_emitted"),
            F.count_if(~F.col("emitted")).alias("alerts_suppressed"),
        ),
    ]
    # Three rows with different columns become one.
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])
    return totals.select(
        "windows_processed",
        F.col("windows_processed").alias("drift_checks"),
        "nodes_checked",
        "drifted_nodes",
        F.col("windows_processed").alias("rca_results"),
        "root_causes",
        "alerts_emitted",
        "alerts_suppressed",
    )


def session_status(
    events: DataFrame, results: DataFrame, size: int, incidents: DataFrame | None = None,
    *, session_id: str | None = None, source: str | None = None,
) -> DataFrame:
    """Events received, windows evaluated, fill of the open window, latest window per model.

    ``incidents`` (see ``incident_summary``) adds the open one. ``model_version`` is that of the
    newest event where events have one.
    """
    newest = F.max_by("model_version", "ts") if {"model_version", "ts"} <= set(events.columns) else F.lit(None).cast("string")
    received = events.groupBy("model_id").agg(F.count("*").alias("events_received"), newest.alias("model_version"))
    latest = results.groupBy("model_id").agg(
        F.count("*").alias("windows_evaluated"),
        F.max("window_id").alias("latest_window"),
        F.max_by("status", "window_id").alias("latest_status"),
    )
    rows = received.join(latest, "model_id", "left")
    if incidents is None:
        rows = rows.withColumn("open_incident", F.lit(None).cast("string"))
    else:
        # One incident of a model is open at a time.
        live = incidents.filter(F.col("status") == "OPEN").select("model_id", F.col("incident_id").alias("open_incident"))
        rows = rows.join(live, "model_id", "left")
    return rows.select(
        "model_id",
        "model_version",
        F.lit(session_id).cast("string").alias("session_id"),
        F.lit(source).cast("string").alias("source"),
        "events_received",
        (F.col("events_received") % size).alias("current_window_count"),
        F.coalesce("windows_evaluated", F.lit(0)).alias("windows_evaluated"),
        "latest_window",
        "latest_status",
        "open_incident",
    )


def drift_trend(node_drift: DataFrame) -> DataFrame:
    """Per window the largest index of any feature and the number of drifted features."""
    feature = F.col("node") != OUTPUT_NODE
    return node_drift.groupBy(*WINDOW).agg(
        F.max(F.coalesce("psi", F.lit(0.0))).alias("max_psi"),
        F.count_if(feature & (F.col("verdict") == "DRIFT")).alias("drifted_count"),
    )


def kpi_summary(
    node_drift: DataFrame, ranked: DataFrame, alerts: DataFrame | None = None, models: DataFrame | None = None
) -> DataFrame:
    """Overall state per model by its newest window.

    Stable, Drift (cause known), Warning (no cause), or Unknown for those of ``models`` without a window.
    ``alerts`` (model_id, window_id) counts those of the newest window.
    """
    newest = node_drift.groupBy("model_id").agg(F.max("window_id").alias("window_id"))
    newest = broadcast_if_small(stored(newest, "newest"))
    drifted = node_drift.join(newest, list(WINDOW)).groupBy(*WINDOW).agg(
        F.count_if(F.col("verdict") == "DRIFT").alias("drifted_count")
    )
    causes = ranked.join(newest, list(WINDOW)).groupBy(*WINDOW).agg(
        # The first name among equal severities, as in root_severity.
        F.min_by("node", F.struct(-F.col("severity"), "node")).alias("root_cause")
    )
    rows = drifted.join(causes, list(WINDOW), "left")
    if alerts is not None:
        rows = rows.join(alerts.groupBy(*WINDOW).agg(F.count("*").alias("active_alerts")), list(WINDOW), "left")
    else:
        rows = rows.withColumn("active_alerts", F.lit(0).cast("bigint"))
    if models is not None:
        rows = models.select("model_id").distinct().join(rows, "model_id", "left")
    return rows.select(
        "model_id",
        "window_id",
        F.coalesce("drifted_count", F.lit(0)).alias("drifted_count"),
        "root_cause",
        F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"),
        F.when(F.col("window_id").isNull(), "Unknown")
        .when(F.col("drifted_count") == 0, "Stable")
        .when(F.col("root_cause").isNotNull(), "Drift")
        .otherwise("Warning")
        .alias("drift_status"),
    )
