"""Window results, history, alerts and incidents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators import report as R
from shoreline.operators import sequences as S
from shoreline.plans.materialize import shared_dir
from shoreline.plans.scan import dense_index
from shoreline.queries import inputs as I
from shoreline.streaming.live import LiveIncidents

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__.removesuffix("_query")] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


WINDOW = ["model_id", "window_id"]

_STATUS = """st AS (SELECT model_id, window_id,
    count(*) FILTER (WHERE node <> 'prediction' AND verdict = 'DRIFT') AS drifted_count,
    count(*) FILTER (WHERE node <> 'prediction' AND verdict = 'WARNING') AS warning_count,
    count(*) FILTER (WHERE verdict = 'INSUFFICIENT_DATA') AS n_insufficient,
    bool_or(verdict = 'DRIFT') AS any_drift FROM nd GROUP BY 1, 2),
stat AS (SELECT *, CASE WHEN drifted_count > 0 THEN 'DRIFT' WHEN warning_count > 0 THEN 'WARNING' ELSE 'STABLE' END AS status FROM st)"""


@query(I.with_(I.ND, _STATUS) + "SELECT * FROM stat")
def window_status(spark: SparkSession, sf: str) -> DataFrame:
    return S.window_status(I.node_drift(spark, sf))


@query(I.with_(I.ND) + """SELECT model_id, window_id, verdict, round(psi, 6) AS psi, current_n AS samples FROM nd WHERE node = 'prediction'""")
def output_drift(spark: SparkSession, sf: str) -> DataFrame:
    found = R.output_drift(I.node_drift(spark, sf))
    return found.select(*WINDOW, "verdict", r6("psi").alias("psi"), "samples")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return R.window_results(
        I.windowed(spark, sf).select(*WINDOW, "ts"),
        I.node_drift(spark, sf),
        I.declared_closure(spark),
        I.declared_levels(spark),
        session_id=F.lit("s1"),
        graph_nodes=I.FEATURES,
        graph_edges=[list(e) for e in I.EDGES],
    )


_RESULT_SQL = f"""{_STATUS},
wb AS (SELECT model_id, window_id, count(*) AS event_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_timestamp FROM win GROUP BY 1, 2)"""


@query(I.with_(I.RCA, _RESULT_SQL) + """SELECT window_id + 1 AS sequence, model_id, window_id, event_count, start_timestamp, status, drifted_count,
    (SELECT string_agg(node, ',' ORDER BY node) FROM dr d WHERE d.model_id = stat.model_id AND d.window_id = stat.window_id) AS drifted_features,
    (SELECT string_agg(node, ',' ORDER BY rank) FROM roots r WHERE r.model_id = stat.model_id AND r.window_id = stat.window_id) AS candidates,
    (SELECT node FROM roots r WHERE r.rank = 1 AND r.model_id = stat.model_id AND r.window_id = stat.window_id) AS primary_root_cause,
    (SELECT count(*) FROM roots r WHERE r.model_id = stat.model_id AND r.window_id = stat.window_id) AS alert_count,
    7 AS checked FROM stat JOIN wb USING (model_id, window_id)""")
def window_results(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return _results(spark, sf).select(
        "sequence", *WINDOW, "event_count",
        F.date_format("start_timestamp", "yyyy-MM-dd HH:mm:ss").alias("start_timestamp"),
        "status", "drifted_count",
        text("drifted_features").alias("drifted_features"),
        text("root_cause_candidates").alias("candidates"),
        "primary_root_cause",
        F.size(F.coalesce("alerts", F.array().cast(R._ALERTS))).cast("bigint").alias("alert_count"),
        F.size("per_feature").alias("checked"),
    )


def _alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    times = I.windowed(spark, sf).groupBy(*WINDOW).agg(
        F.floor(F.max("ts").cast("double")).cast("bigint").alias("ts")
    )
    return S.root_cause_alerts(I.roots(spark, sf), I.paths(spark, sf), times)


_ALERTS = """wt AS (SELECT model_id, window_id, CAST(floor(epoch(max(ts))) AS BIGINT) AS ts FROM win GROUP BY 1, 2),
al AS (SELECT 'inc-' || substr(sha1(node || ':' || model_id || ':' || window_id), 1, 12) AS incident_id, node AS root_cause,
    model_id, window_id, path, severity, ts FROM roots JOIN paths USING (model_id, window_id, node) JOIN wt USING (model_id, window_id))"""


@query(I.with_(I.RCA, _ALERTS) + """, cl AS (SELECT n.*, CASE WHEN n.verdict = 'DRIFT' AND node <> 'prediction' THEN CASE WHEN s.hit THEN 'SYMPTOM' ELSE 'ROOT_CAUSE' END
      WHEN n.verdict IN ('WARNING', 'INSUFFICIENT_DATA') THEN n.verdict ELSE 'STABLE' END AS class
    FROM nd n LEFT JOIN (SELECT *, true AS hit FROM sym) s USING (model_id, window_id, node)),
  nl AS (SELECT model_id, window_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'DRIFT') AS d,
      string_agg(node, ',' ORDER BY node) FILTER (WHERE verdict = 'DRIFT') AS drifted, string_agg(node, ', ' ORDER BY node) FILTER (WHERE class = 'SYMPTOM') AS symptoms,
      string_agg(node || '=' || verdict || '/' || class, ',' ORDER BY node) AS verdicts,
      string_agg('* ' || node || ': ' || class || ' (' || concat_ws(', ', 'distribution test ' || ks_verdict, 'stability index ' || psi_verdict) || ')', chr(10) ORDER BY node) AS lines FROM cl GROUP BY 1, 2),
  rl AS (SELECT model_id, window_id, string_agg(node, ',' ORDER BY rank) AS roots,
      string_agg(rank || '. ' || node || ' at ' || printf('%.3f', severity) || CASE WHEN path <> '' THEN ', then ' || replace(path, '>', ', ') ELSE '' END, chr(10) ORDER BY rank) AS lines
    FROM roots JOIN paths USING (model_id, window_id, node) GROUP BY 1, 2),
  ll AS (SELECT model_id, window_id, count(*) AS n, first(incident_id ORDER BY root_cause) AS incident_id, string_agg('* ' || root_cause || ' as ' || incident_id, chr(10) ORDER BY root_cause) AS lines FROM al GROUP BY 1, 2)
  SELECT 'rpt-' || substr(sha1(model_id || ':' || window_id || ':b1'), 1, 12) AS report_id, model_id, window_id, incident_id, strftime(to_timestamp(wt.ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ended_at,
    'b1' AS baseline_version, 'v1' AS dataset_version, CAST(NULL AS VARCHAR) AS code_commit, verdicts, drifted, symptoms, rl.roots IS NOT NULL AS has_root_cause, rl.roots AS root_causes,
    coalesce(ll.n, 0) AS alert_count, (SELECT string_agg(node, ',' ORDER BY level, node) FROM lev) AS graph_nodes, (SELECT string_agg(parent || '>' || child, ',' ORDER BY parent, child) FROM dedge) AS graph_edges,
    concat_ws(chr(10), '# ' || model_id || ', window ' || window_id, 'baseline b1, data v1', d || ' of ' || nl.n || ' nodes drift.', chr(10) || '## Nodes', nl.lines, chr(10) || '## Where it starts',
      coalesce(rl.lines, 'No feature starts a drift in this window.'), 'Carried on by: ' || symptoms, chr(10) || '## Alerts sent', coalesce(ll.lines, 'nothing')) AS markdown
  FROM nl JOIN wt USING (model_id, window_id) LEFT JOIN rl USING (model_id, window_id) LEFT JOIN ll USING (model_id, window_id)""")
def monitoring_report(spark: SparkSession, sf: str) -> DataFrame:
    ends = I.windowed(spark, sf).groupBy(*WINDOW).agg(F.max("ts").alias("ended_at"))
    found = R.monitoring_report(
        I.node_drift(spark, sf), I.declared_closure(spark), I.declared_levels(spark), _alert_rows(spark, sf),
        edges=I.declared_graph(spark).edges, windows=ends, baseline_version="b1", dataset_version="v1",
    )
    text = lambda c, by=",": F.nullif(F.array_join(c, by), F.lit(""))
    verdicts = F.transform(
        F.array_sort(F.map_entries("drift")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]["verdict"], F.lit("/"), F.element_at("classifications", e["key"])),
    )
    return found.select(
        "report_id", *WINDOW, "incident_id", F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"),
        "baseline_version", "dataset_version", "code_commit", text(verdicts).alias("verdicts"),
        text("drifted_nodes").alias("drifted"), text("symptoms", ", ").alias("symptoms"), "has_root_cause",
        text(F.transform("root_causes", lambda r: r["node"])).alias("root_causes"), "alert_count",
        text("graph_nodes").alias("graph_nodes"),
        text(F.transform("graph_edges", lambda e: F.array_join(e, ">"))).alias("graph_edges"), "markdown",
    )


@query(I.with_(I.ND, _RESULT_SQL) + """, active AS (SELECT DISTINCT event_type AS model_id FROM events UNION SELECT 'retired')
  SELECT model_id, l.window_id IS NOT NULL AS available, CASE WHEN l.window_id IS NULL THEN 'no monitoring report yet' END AS detail, l.window_id AS window_id, l.status AS status
  FROM active LEFT JOIN (SELECT model_id, max(window_id) AS window_id, arg_max(status, window_id) AS status FROM stat GROUP BY 1) l USING (model_id)""")
def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    ends = I.windowed(spark, sf).groupBy(*WINDOW).agg(F.max("ts").alias("ts"))
    reports = S.window_status(I.node_drift(spark, sf)).join(ends, WINDOW)
    active = I.table(spark, sf, "events").select(F.col("event_type").alias("model_id")).distinct()
    active = active.union(spark.sql("SELECT 'retired'"))
    found = R.latest_report(reports, active)
    return found.select("model_id", "available", "detail", "report.window_id", "report.status")


@query(I.with_(I.ND, _STATUS) + "SELECT window_id + 1 AS sequence, model_id, status FROM stat WHERE model_id = 'click' ORDER BY 1 DESC LIMIT 5")
def window_history(spark: SparkSession, sf: str) -> DataFrame:
    results = S.window_status(I.node_drift(spark, sf)).select(
        (F.col("window_id") + 1).alias("sequence"), "model_id", "status"
    )
    return R.window_history(results, 5, "click")


# Sequential rule written out: walk the alerts of a key in time order.
_COOLED = """ord AS (SELECT *, row_number() OVER (PARTITION BY root_cause, model_id ORDER BY ts, window_id) AS i FROM al),
cool AS (SELECT root_cause, model_id, i, ts AS last, true AS emitted FROM ord WHERE i = 1
  UNION ALL SELECT o.root_cause, o.model_id, o.i, CASE WHEN o.ts - c.last >= 300000 THEN o.ts ELSE c.last END, o.ts - c.last >= 300000
  FROM cool c JOIN ord o ON o.root_cause = c.root_cause AND o.model_id = c.model_id AND o.i = c.i + 1),
cooled AS (SELECT ord.*, cool.emitted FROM ord JOIN cool USING (root_cause, model_id, i))"""
COOLDOWN = 300_000


@query(I.with_(I.RCA, _ALERTS) + "SELECT incident_id, root_cause, model_id, window_id, path, round(severity, 6) AS severity, ts FROM al")
def root_cause_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _alert_rows(spark, sf).select(
        "incident_id", "root_cause", *WINDOW, F.array_join("symptom_path", ">").alias("path"),
        r6("severity").alias("severity"), "ts",
    )


@query(I.with_(I.RCA, _ALERTS, _COOLED) + "SELECT root_cause, model_id, window_id, ts, emitted FROM cooled")
def alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _alert_rows(spark, sf).select("root_cause", *WINDOW, "ts")
    return S.alert_cooldown(alerts, COOLDOWN)


@query(I.with_(I.RCA, _ALERTS, _COOLED) + "SELECT root_cause, model_id, window_id, ts FROM cooled WHERE NOT emitted")
def suppressed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _alert_rows(spark, sf).select("root_cause", *WINDOW, "ts")
    return S.suppressed_alerts(S.alert_cooldown(alerts, COOLDOWN))


# Incidents of the flags fl(model_id, window_id, drifted).
_LIFE = """sm AS (SELECT model_id, window_id, drifted, CASE WHEN drifted THEN 1 ELSE 0 END AS cd, CASE WHEN drifted THEN 0 ELSE 1 END AS cs,
    false AS op, 0 AS seq, CAST(NULL AS VARCHAR) AS transition FROM fl WHERE window_id = 0
  UNION ALL SELECT f.model_id, f.window_id, f.drifted, CASE WHEN f.drifted THEN s.cd + 1 ELSE 0 END, CASE WHEN f.drifted THEN 0 ELSE s.cs + 1 END,
    CASE WHEN NOT s.op AND f.drifted AND s.cd + 1 >= 2 THEN true WHEN s.op AND NOT f.drifted AND s.cs + 1 >= 3 THEN false ELSE s.op END,
    CASE WHEN NOT s.op AND f.drifted AND s.cd + 1 >= 2 THEN s.seq + 1 ELSE s.seq END,
    CASE WHEN NOT s.op AND f.drifted AND s.cd + 1 >= 2 THEN 'OPENED' WHEN s.op AND NOT f.drifted AND s.cs + 1 >= 3 THEN 'CLOSED' END
  FROM sm s JOIN fl f ON f.model_id = s.model_id AND f.window_id = s.window_id + 1)"""

# Flags that open and close incidents: hours of events of a user, drifted when the mean is high.
_FLAGS = f"""fl AS (SELECT CAST(user_id AS VARCHAR) AS model_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS window_id,
    value >= 40 AS drifted, CASE WHEN value >= 60 THEN event_type END AS root_cause FROM events),
{_LIFE}"""


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as a sequence of windows, flagged where the value is high."""
    events = I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("model_id"), "event_id", "value", "event_type"
    )
    ordered = dense_index(events, ["model_id"], ["event_id"], "window_id")
    return ordered.select(
        *WINDOW,
        (F.col("value") >= 40).alias("drifted"),
        F.when(F.col("value") >= 60, F.col("event_type")).alias("root_cause"),
    )


@query(I.with_(_FLAGS) + """SELECT model_id, window_id, drifted, CAST(seq AS BIGINT) AS incident_no, CASE WHEN op THEN 'OPEN' END AS incident_status, transition FROM sm""")
def incident_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return S.incident_lifecycle(_flags(spark, sf), chunk_size=16).select(
        *WINDOW, "drifted", "incident_no", "incident_status", "transition"
    )


_SUMMARY = """inc AS (SELECT s.model_id, s.seq AS incident_no, min(CASE WHEN transition = 'OPENED' THEN s.window_id END) AS opened_window,
    count(*) FILTER (WHERE op AND s.drifted) + 1 AS drifted_windows, max(CASE WHEN op AND s.drifted THEN s.window_id END) AS last_window,
    max(CASE WHEN transition = 'CLOSED' THEN s.window_id END) AS closed_window,
    arg_min(root_cause, s.window_id) FILTER (WHERE op AND s.drifted AND root_cause IS NOT NULL) AS root_cause
  FROM sm s JOIN fl f ON f.model_id = s.model_id AND f.window_id = s.window_id WHERE op OR transition = 'CLOSED' GROUP BY 1, 2)"""


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    states = S.incident_lifecycle(_flags(spark, sf)).withColumn(
        "symptom_path", F.array().cast("array<string>")
    )
    return S.incident_summary(states)


_INCIDENT_COLUMNS = ["model_id", "incident_id", "opened_window", "drifted_windows", "last_window",
                     "closed_window", "root_cause"]


@query(I.with_(_FLAGS, _SUMMARY) + """SELECT model_id, printf('live-inc-%04d', incident_no) AS incident_id, opened_window, drifted_windows,
  last_window, closed_window, root_cause, CASE WHEN closed_window IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status FROM inc""")
def incident_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _incidents(spark, sf).select(*_INCIDENT_COLUMNS, "status")


@query(I.with_(_FLAGS, _SUMMARY) + """SELECT model_id, printf('live-inc-%04d', incident_no) AS incident_id, opened_window, drifted_windows,
  last_window, root_cause FROM inc WHERE closed_window IS NULL""")
def incident_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    live, _ = S.incident_snapshot(_incidents(spark, sf))
    return live.select(*[c for c in _INCIDENT_COLUMNS if c != "closed_window"])


@query(I.with_(_FLAGS) + """SELECT model_id, window_id, drifted, CAST(seq AS BIGINT) AS incident_no, CASE WHEN op THEN 'OPEN' END AS incident_status, transition FROM sm""")
def incident_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{shared_dir(spark)}/incidents-{uuid.uuid4().hex}"
    flags = _flags(spark, sf).drop("root_cause")
    flags.write.parquet(f"{base}/in")
    source = spark.readStream.schema(flags.schema).parquet(f"{base}/in")
    LiveIncidents(f"{base}/out").start(source, f"{base}/progress", bounded=True).awaitTermination()
    return spark.read.parquet(f"{base}/out/states").drop("batch_id")


@query(I.with_(I.RCA, _ALERTS, _COOLED) + """SELECT w AS windows_processed, w AS drift_checks, n AS nodes_checked, d AS drifted_nodes, w AS rca_results, r AS root_causes,
  e AS alerts_emitted, s AS alerts_suppressed FROM (SELECT count(DISTINCT (model_id, window_id)) AS w, count(*) AS n, count(*) FILTER (WHERE verdict = 'DRIFT') AS d FROM nd),
  (SELECT count(*) AS r FROM roots), (SELECT count(*) FILTER (WHERE emitted) AS e, count(*) FILTER (WHERE NOT emitted) AS s FROM cooled)""")
def monitoring_counters(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _alert_rows(spark, sf).select("root_cause", *WINDOW, "ts")
    return R.monitoring_counters(
        I.node_drift(spark, sf), I.roots(spark, sf), S.alert_cooldown(alerts, COOLDOWN)
    )


@query(I.with_(I.ND, _STATUS, "fl AS (SELECT model_id, window_id, any_drift AS drifted FROM stat)", _LIFE) + """SELECT model_id, CAST(NULL AS VARCHAR) AS model_version, 's1' AS session_id, 'replay' AS source,
    n AS events_received, n % 100 AS current_window_count, w AS windows_evaluated, latest_window, latest_status, CASE WHEN op THEN printf('live-inc-%04d', seq) END AS open_incident
  FROM (SELECT model_id, count(*) AS n FROM cur GROUP BY 1) JOIN (SELECT model_id, count(*) AS w, max(window_id) AS latest_window,
    arg_max(status, window_id) AS latest_status FROM stat GROUP BY 1) USING (model_id) JOIN (SELECT model_id, window_id AS latest_window, op, seq FROM sm) USING (model_id, latest_window)""")
def session_status(spark: SparkSession, sf: str) -> DataFrame:
    status = S.window_status(I.node_drift(spark, sf))
    states = S.incident_lifecycle(status.select(*WINDOW, F.col("any_drift").alias("drifted"))).select(
        "*", F.lit(None).cast("string").alias("root_cause"), F.array().cast("array<string>").alias("symptom_path")
    )
    return R.session_status(
        I.current(spark, sf), status, I.SIZE, S.incident_summary(states), session_id="s1", source="replay"
    )


@query(I.with_(I.ND) + """SELECT model_id, window_id, round(max(coalesce(psi, 0)), 6) AS max_psi,
  count(*) FILTER (WHERE node <> 'prediction' AND verdict = 'DRIFT') AS drifted_count FROM nd GROUP BY 1, 2""")
def drift_trend(spark: SparkSession, sf: str) -> DataFrame:
    return R.drift_trend(I.node_drift(spark, sf)).withColumn("max_psi", r6("max_psi"))


@query(I.with_(I.RCA, _ALERTS) + """, newest AS (SELECT model_id, max(window_id) AS window_id FROM nd GROUP BY 1),
  models AS (SELECT DISTINCT event_type AS model_id FROM events UNION SELECT 'retired')
  SELECT model_id, window_id, coalesce(drifted_count, 0) AS drifted_count, root_cause, coalesce(active_alerts, 0) AS active_alerts,
    CASE WHEN window_id IS NULL THEN 'Unknown' WHEN drifted_count = 0 THEN 'Stable' WHEN root_cause IS NOT NULL THEN 'Drift' ELSE 'Warning' END AS drift_status
  FROM models LEFT JOIN (SELECT model_id, window_id, count(*) FILTER (WHERE verdict = 'DRIFT') AS drifted_count FROM nd JOIN newest USING (model_id, window_id) GROUP BY 1, 2) USING (model_id)
  LEFT JOIN (SELECT model_id, window_id, first(node ORDER BY severity DESC, node) AS root_cause FROM roots GROUP BY 1, 2) USING (model_id, window_id)
  LEFT JOIN (SELECT model_id, window_id, count(*) AS active_alerts FROM al GROUP BY 1, 2) USING (model_id, window_id)""")
def kpi_summary(spark: SparkSession, sf: str) -> DataFrame:
    models = I.table(spark, sf, "events").select(F.col("event_type").alias("model_id")).union(spark.sql("SELECT 'retired'"))
    return R.kpi_summary(I.node_drift(spark, sf), I.roots(spark, sf), _alert_rows(spark, sf), models)

