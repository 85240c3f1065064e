"""The given tables as prediction events, baselines, graphs and scores.

Every table is used whole. ``events`` is split in time: the first half is the reference, the
second half is monitored. The SQL fragments describe the same inputs for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.config import DriftConfig
from shoreline.operators import graph as G
from shoreline.operators import profile as P
from shoreline.operators.drift import detect_drift
from shoreline.operators.rca import rca_roots, root_severity, symptom_paths
from shoreline.operators.windows import count_windows
from shoreline.plans.materialize import stored

CUT = "2024-01-16 00:00:00"
SIZE = 100
CONFIG = DriftConfig(window_size=SIZE, window_min_samples=30)
SAMPLE_CAP = 5000  # of the reference sample, whose size is its feature
NUMERIC = ["value", "k", "hour", "load", "score"]
FEATURES = [*NUMERIC, "weekday"]
# Declared by the model's owner, as a graph file would.
EDGES = [("weekday", "hour"), ("hour", "load"), ("value", "load"), ("k", "score"), ("value", "score")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prediction_events(spark: SparkSession, sf: str) -> DataFrame:
    """events with a model, features, a score and a source."""
    return _with_features(table(spark, sf, "events"))


def _with_features(events: DataFrame) -> DataFrame:
    hour = F.hour("ts").cast("double")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        *[c for c in ("window_id",) if c in events.columns],
        F.col("event_type").alias("model_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        k.alias("k"),
        hour.alias("hour"),
        (F.col("value") * (1 + hour)).alias("load"),
        (F.col("value") * k / 100).alias("score"),
        F.date_format("ts", "EEEE").alias("weekday"),
        (F.col("value") >= 50).cast("bigint").alias("prediction"),
        (F.col("value") / (F.col("value") + 50)).alias("probability"),
        F.when(F.col("value") >= 50, "api").otherwise("replay").alias("source"),
    )


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return prediction_events(spark, sf).filter(F.col("ts") < F.lit(CUT).cast("timestamp"))


def current(spark: SparkSession, sf: str) -> DataFrame:
    return prediction_events(spark, sf).filter(F.col("ts") >= F.lit(CUT).cast("timestamp"))


def features_map(events: DataFrame) -> DataFrame:
    """The same events with their features as a map of number / text entries."""
    entry = lambda c: F.struct(
        F.lit(c).alias("key"),
        F.struct(
            (F.lit(None).cast("string") if c in NUMERIC else F.col(c)).alias("text"),
            (F.col(c) if c in NUMERIC else F.lit(None).cast("double")).alias("num"),
        ).alias("value"),
    )
    pairs = F.map_from_entries(F.array(*[entry(c) for c in FEATURES]))
    return events.withColumn(
        "features",
        F.transform_values(
            pairs, lambda _, v: F.struct(v["num"].alias("num"), v["text"].alias("text"))
        ),
    )


_STORED: dict = {}


def _once(spark: SparkSession, sf: str, name: str, make):
    """A table that a deployment keeps stored is built once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def baseline(spark: SparkSession, sf: str) -> P.Baseline:
    def make():
        ref = reference(spark, sf)
        outputs = ref.select(
            "model_id", "prediction", F.lit(None).cast("double").alias("output")
        )
        classes = P.output_baseline(outputs)
        return P.build_baseline(ref, FEATURES, F.col("event_id"), CONFIG, classes)

    return _once(spark, sf, "baseline", make)


def windowed(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        # Features are derived after the rows are laid out: the range bounds need none of them.
        events = table(spark, sf, "events").select("event_type", "event_id", "ts", "value", "props")
        late = events.filter(F.col("ts").cast("timestamp") >= F.lit(CUT).cast("timestamp"))
        placed = count_windows(late.withColumn("ts", F.col("ts").cast("timestamp")), SIZE, group=("event_type",))
        return stored(_with_features(placed), "windowed")

    return _once(spark, sf, "windowed", make)


def window_numbers(events: DataFrame) -> DataFrame:
    return P.collect_batch_features(events, ["model_id", "window_id"], NUMERIC)


def window_categories(events: DataFrame) -> DataFrame:
    """The text feature and the class labels of the output node."""
    ids = ["model_id", "window_id"]
    labels = events.select(*ids, "prediction", F.lit(None).cast("double").alias("output"))
    outputs = P.output_node_values(labels, ids, F.lit(True)).select(*ids, "node", "cat")
    return P.collect_batch_categories(events, ids, ["weekday"]).unionByName(outputs)


def run_detection(spark: SparkSession, sf: str, p_method: str = "asymptotic") -> DataFrame:
    events = windowed(spark, sf)
    windows = events.select("model_id", "window_id").distinct()
    return detect_drift(
        window_numbers(events), window_categories(events), windows,
        baseline(spark, sf), CONFIG, p_method=p_method,
    )


def node_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "node_drift", lambda: stored(run_detection(spark, sf), "node-drift")
    )


def declared_graph(spark: SparkSession) -> G.Graph:
    rows = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
    return G.graph_from_edges(spark.sql(f"SELECT * FROM VALUES {rows} AS e(parent, child)"))


def declared_closure(spark: SparkSession) -> DataFrame:
    return _once(
        spark, "", "declared_closure", lambda: G.transitive_closure(declared_graph(spark).edges)
    )


def declared_levels(spark: SparkSession) -> DataFrame:
    def make():
        g = declared_graph(spark)
        return stored(G.node_levels(g.nodes, g.edges), "levels")

    return _once(spark, "", "declared_levels", make)


def roots(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "roots",
        lambda: stored(
            root_severity(rca_roots(node_drift(spark, sf), declared_closure(spark))), "roots"
        ),
    )


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return _once(
        spark, sf, "paths",
        lambda: stored(
            symptom_paths(
                node_drift(spark, sf), roots(spark, sf), declared_closure(spark), declared_levels(spark)
            ),
            "paths",
        ),
    )


def data_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A dependency graph that grows with the tables: region > nation > customer / supplier >
    order, and the turns of each conversation."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def pairs(name: str, a: str, b: str, up: str, low: str) -> DataFrame:
        # Complete edges of two tables have different names: numbers are compared, within each table, before they become names.
        rows = table(spark, sf, name).select(up, low).distinct()
        return rows.select(node(a, up).alias("parent"), node(b, low).alias("child"))

    turn = lambda step: F.concat(
        F.lit("t"), F.col("conv_id").cast("string"), F.lit("."), (F.col("turn") + step).cast("string")
    )
    turns = table(spark, sf, "conversations").filter("turn > 0").select("conv_id", "turn").distinct()
    edges = (
        pairs("nation", "r", "n", "n_regionkey", "n_nationkey")
        .union(pairs("customer", "n", "c", "c_nationkey", "c_custkey"))
        .union(pairs("supplier", "n", "s", "s_nationkey", "s_suppkey"))
        .union(pairs("orders", "c", "o", "o_custkey", "o_orderkey"))
        .union(pairs("lineitem", "s", "o", "l_suppkey", "l_orderkey"))
        .union(turns.select(turn(-1).alias("parent"), turn(0).alias("child")))
    )
    missing = F.col("parent").isNull() | F.col("child").isNull()
    return edges.filter(~missing).union(edges.filter(missing).distinct())


def data_graph(spark: SparkSession, sf: str) -> G.Graph:
    def make():
        return G.graph_from_edges(data_edges(spark, sf), unique=True)

    return _once(spark, sf, "data_graph", make)


def feature_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "feature_edges", lambda: stored(data_edges(spark, sf), "edges"))


def data_levels(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        g = data_graph(spark, sf)
        return G.node_levels(g.nodes, g.edges, unique=True)

    return _once(spark, sf, "data_levels", make)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled scores with a group: labels and documents."""
    joined = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    )
    n = F.col("n_chars").cast("double")
    return joined.select(
        "doc_id", F.col("quality").alias("y"), (n / (n + 1000)).alias("p"), F.col("lang").alias("g")
    )


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of embeddings, ten class scores and the best class.

    A class scores the sum of every tenth component, so all components take part.
    """
    part = lambda c: F.filter("embedding", lambda _, i: i % 10 == c)
    total = lambda c: F.aggregate(part(c), F.lit(0.0), lambda a, x: a + x.cast("double"))
    ten = F.array(*[total(c) for c in range(10)])
    scored = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("y"), ten.alias("ten"))
    best = (F.array_position("ten", F.array_max("ten")) - 1).cast("bigint")
    return scored.select("vec_id", "y", best.alias("yhat"), "ten")


def attributions(spark: SparkSession, sf: str) -> DataFrame:
    from shoreline.operators.attribution import linear_attributions

    rows = current(spark, sf)
    return linear_attributions(rows, "event_id", COEFFICIENTS)


COEFFICIENTS = {"value": 0.02, "k": -0.01, "hour": 0.05, "load": 0.0005, "score": -0.004}

# ---- the same inputs in SQL -----------------------------------------------------------------

PE = """pe AS (
  SELECT *, value * (1 + hour) AS load, value * k / 100 AS score FROM (
    SELECT event_type AS model_id, event_id, ts, value,
      CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k,
      CAST(hour(ts) AS DOUBLE) AS hour, dayname(ts) AS weekday,
      CAST(CASE WHEN value >= 50 THEN 1 ELSE 0 END AS BIGINT) AS prediction,
      value / (value + 50) AS probability,
      CASE WHEN value >= 50 THEN 'api' ELSE 'replay' END AS source
    FROM events)),
ref AS (SELECT * FROM pe WHERE ts < TIMESTAMP '2024-01-16'),
cur AS (SELECT * FROM pe WHERE ts >= TIMESTAMP '2024-01-16'),
win AS (SELECT *, (row_number() OVER (PARTITION BY model_id ORDER BY ts, event_id) - 1) // 100
  AS window_id FROM cur)"""


def _long(source: str, ids: str) -> str:
    parts = [f"SELECT {ids}, '{c}' AS node, {c} AS num, CAST(NULL AS VARCHAR) AS cat FROM {source}"
             for c in NUMERIC]
    parts.append(
        f"SELECT {ids}, 'weekday' AS node, CAST(NULL AS DOUBLE) AS num, weekday AS cat FROM {source}"
    )
    return " UNION ALL ".join(parts)


POINTS = "[" + ", ".join(f"CAST({i * 0.1!r} AS DOUBLE)" for i in range(10)) + ", CAST(1 AS DOUBLE)]"

_AT = "p * (len(arr) - 1)"
_A = f"arr[CAST(floor({_AT}) AS BIGINT) + 1]"
_B = f"arr[least(CAST(floor({_AT}) AS BIGINT) + 2, len(arr))]"
# De-duplicated quantiles of a sorted list ``arr``.
QUANTILES = f"""list_sort(list_distinct(list_transform({POINTS}, lambda p: CASE
  WHEN {_AT} - floor({_AT}) < 0.5 THEN {_A} + ({_B} - {_A}) * ({_AT} - floor({_AT}))
  ELSE {_B} - ({_B} - {_A}) * (1 - ({_AT} - floor({_AT}))) END)))"""

BASE = f"""{PE},
ref_long AS ({_long('ref', 'model_id, event_id')}),
bval AS (SELECT model_id, node, num AS value FROM ref_long WHERE num IS NOT NULL),
bcat AS (SELECT model_id, node, cat AS category, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY model_id, node) AS prop
  FROM (SELECT model_id, node, cat FROM ref_long WHERE cat IS NOT NULL
    UNION ALL SELECT model_id, 'prediction', CAST(prediction AS VARCHAR) FROM ref)
  GROUP BY model_id, node, cat),
edges AS (SELECT model_id, node, baseline_n, raw, len(raw) - 1 AS n_bins, raw[2:len(raw) - 1] AS inn
  FROM (SELECT model_id, node, baseline_n, {QUANTILES} AS raw FROM (
    SELECT model_id, node, count(*) AS baseline_n, list_sort(list(value)) AS arr FROM bval
    GROUP BY model_id, node))),
bbin AS (SELECT g.model_id, g.node, g.bin, g.n_bins, g.baseline_n, g.low, g.high,
    coalesce(c.n, 0) / g.baseline_n AS baseline_prop
  FROM (SELECT model_id, node, n_bins, baseline_n, bin,
      CASE WHEN bin = 0 THEN -CAST('inf' AS DOUBLE) ELSE raw[bin + 1] END AS low,
      CASE WHEN bin = n_bins - 1 THEN CAST('inf' AS DOUBLE) ELSE raw[bin + 2] END AS high
    FROM (SELECT *, unnest(range(0, n_bins)) AS bin FROM edges)) g
  LEFT JOIN (SELECT b.model_id, b.node, len(list_filter(e.inn, lambda x: x <= b.value)) AS bin,
      count(*) AS n FROM bval b JOIN edges e USING (model_id, node) GROUP BY ALL) c
  USING (model_id, node, bin))"""

VALUES = f"""{BASE},
vals AS ({_long('win', 'model_id, window_id')}
  UNION ALL SELECT model_id, window_id, 'prediction', NULL, CAST(prediction AS VARCHAR) FROM win),
cnt AS (SELECT model_id, window_id, node, count(num) AS nn, count(cat) AS nc FROM vals GROUP BY ALL)"""

_EPS = "0.000001"


def term(c: str, b: str) -> str:
    c, b = f"greatest({c}, {_EPS})", f"greatest({b}, {_EPS})"
    return f"({c} - {b}) * ln({c} / {b})"


KS = f"""{VALUES},
pts AS (SELECT model_id, window_id, node, num AS value, 1 AS c, 0 AS b FROM vals WHERE num IS NOT NULL
  UNION ALL SELECT w.model_id, w.window_id, v.node, v.value, 0, 1
  FROM (SELECT DISTINCT model_id, window_id FROM win) w JOIN bval v USING (model_id)),
step AS (SELECT model_id, window_id, node, value, sum(c) AS c, sum(b) AS b FROM pts GROUP BY ALL),
ecdf AS (SELECT *, sum(c) OVER w AS cc, sum(b) OVER w AS cb, sum(c) OVER g AS current_n,
    sum(b) OVER g AS baseline_n FROM step
  WINDOW g AS (PARTITION BY model_id, window_id, node),
    w AS (PARTITION BY model_id, window_id, node ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT model_id, window_id, node, CAST(current_n AS BIGINT) AS current_n,
    CAST(baseline_n AS BIGINT) AS baseline_n,
    CASE WHEN least(current_n, baseline_n) >= 30 THEN max(abs(cc / current_n - cb / baseline_n)) END
      AS statistic
  FROM ecdf GROUP BY model_id, window_id, node, current_n, baseline_n)"""

ASYMPTOTIC = """CASE WHEN statistic IS NULL THEN NULL
  WHEN sqrt(current_n * baseline_n / (current_n + baseline_n)) * statistic < 0.1 THEN 1.0
  ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)
    * exp(-2.0 * j * j * (current_n * baseline_n / (current_n + baseline_n)) * statistic * statistic))), 0.0), 1.0) END"""

PSI_BINS = f"""{VALUES},
pbin AS (SELECT t.model_id, t.window_id, t.node, b.bin, b.low, b.high, b.baseline_prop, b.baseline_n,
    b.n_bins, t.nn AS current_n, coalesce(c.n, 0) / t.nn AS current_prop
  FROM (SELECT * FROM cnt WHERE nn > 0) t JOIN bbin b USING (model_id, node)
  LEFT JOIN (SELECT v.model_id, v.window_id, v.node, len(list_filter(e.inn, lambda x: x <= v.num)) AS bin,
      count(*) AS n FROM vals v JOIN edges e USING (model_id, node) WHERE v.num IS NOT NULL GROUP BY ALL) c
    USING (model_id, window_id, node, bin)),
psi_num AS (SELECT model_id, window_id, node, current_n, baseline_n, n_bins,
    CASE WHEN least(current_n, baseline_n) >= 30 THEN
      CASE WHEN n_bins > 1 THEN sum({term('current_prop', 'baseline_prop')}) ELSE 0 END END AS psi
  FROM pbin GROUP BY model_id, window_id, node, current_n, baseline_n, n_bins)"""

PSI_CAT = f"""cbin AS (
  SELECT t.model_id, t.window_id, t.node, b.category, b.prop AS baseline_prop, t.nc AS current_n
  FROM (SELECT * FROM cnt WHERE nc > 0) t JOIN bcat b USING (model_id, node)
  UNION ALL
  SELECT DISTINCT v.model_id, v.window_id, v.node, v.cat, 0.0, t.nc FROM vals v
  JOIN cnt t USING (model_id, window_id, node)
  LEFT JOIN bcat b ON b.model_id = v.model_id AND b.node = v.node AND b.category = v.cat
  WHERE v.cat IS NOT NULL AND b.category IS NULL),
cprop AS (SELECT c.*, coalesce(n, 0) / current_n AS current_prop FROM cbin c LEFT JOIN (
  SELECT model_id, window_id, node, cat AS category, count(*) AS n FROM vals WHERE cat IS NOT NULL
  GROUP BY ALL) k USING (model_id, window_id, node, category)),
psi_cat AS (SELECT p.model_id, p.window_id, p.node, p.current_n, b.baseline_n,
    CASE WHEN p.current_n >= 30 THEN sum({term('current_prop', 'baseline_prop')}) END AS psi
  FROM cprop p JOIN (SELECT model_id, node, CAST(sum(n) AS BIGINT) AS baseline_n FROM bcat GROUP BY ALL) b
  USING (model_id, node) GROUP BY p.model_id, p.window_id, p.node, p.current_n, b.baseline_n)"""

# Exact p-values: the chance that a random lattice path to (m, n) has left the band, step by step.
EXACT = """tr AS (SELECT DISTINCT least(current_n, baseline_n) AS m, greatest(current_n, baseline_n) AS n,
    CAST(round(statistic * lcm(current_n, baseline_n)) AS BIGINT) AS h FROM ks WHERE statistic IS NOT NULL),
lat AS (
  SELECT m, n, h, CAST(0 AS BIGINT) AS k, list_transform(range(0, m + 1), lambda i: CAST(CASE WHEN h <= 0 THEN 1 ELSE 0 END AS DOUBLE)) AS p FROM tr
  UNION ALL SELECT m, n, h, k + 1, list_transform(range(0, m + 1), lambda i: CASE
      WHEN i > k + 1 OR k + 1 - i > n THEN 0.0
      WHEN abs(i * (n // gcd(m, n)) - (k + 1 - i) * (m // gcd(m, n))) >= h THEN 1.0
      ELSE p[i + 1] * (k + 1 - i) / (k + 1) + CASE WHEN i > 0 THEN p[i] * i / (k + 1) ELSE 0.0 END END)
  FROM lat WHERE k < m + n),
ke AS (SELECT ks.*, p[m + 1] AS p_value FROM ks LEFT JOIN lat ON k = m + n AND m = least(current_n, baseline_n)
  AND n = greatest(current_n, baseline_n) AND h = CAST(round(statistic * lcm(current_n, baseline_n)) AS BIGINT))"""


def _drift_tail(source: str, p_value: str) -> str:
    return f"""measured AS (
  SELECT model_id, window_id, node, 'continuous' AS kind, current_n, baseline_n, statistic,
    {p_value} AS p_value, psi
  FROM {source} JOIN (SELECT model_id, window_id, node, psi FROM psi_num) USING (model_id, window_id, node)
  UNION ALL SELECT model_id, window_id, node, 'categorical', current_n, baseline_n, NULL, NULL, psi
  FROM psi_cat),
verdicts AS (SELECT *,
    CASE WHEN kind = 'continuous' THEN CASE WHEN p_value IS NULL THEN 'INSUFFICIENT_DATA'
      WHEN p_value < 0.05 THEN 'DRIFT' ELSE 'STABLE' END END AS ks_verdict,
    CASE WHEN psi IS NULL THEN 'INSUFFICIENT_DATA' WHEN psi >= 0.2 THEN 'DRIFT'
      WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS psi_verdict FROM measured),
nd AS (SELECT *, CASE
    WHEN coalesce(ks_verdict, 'INSUFFICIENT_DATA') = 'INSUFFICIENT_DATA'
      AND psi_verdict = 'INSUFFICIENT_DATA' THEN 'INSUFFICIENT_DATA'
    WHEN psi_verdict = 'DRIFT' THEN 'DRIFT'
    WHEN ks_verdict = 'DRIFT' AND psi_verdict = 'WARNING' THEN 'DRIFT'
    WHEN psi_verdict = 'WARNING' THEN 'WARNING'
    WHEN ks_verdict = 'DRIFT' THEN 'WARNING' ELSE 'STABLE' END AS verdict FROM verdicts)"""


def _after(block: str, prefix: str) -> str:
    """The part of a WITH list that follows a shared beginning."""
    return block[len(prefix) + 1 :].lstrip()


_MEASURES = f"{KS}, {_after(PSI_BINS, VALUES)}, {PSI_CAT}"
ND = f"{_MEASURES}, {_drift_tail('ks', ASYMPTOTIC)}"
ND_EXACT = f"{_MEASURES}, {EXACT}, {_drift_tail('ke', 'p_value')}"

_EDGE_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in EDGES)
RCA = f"""{ND},
dedge AS (SELECT * FROM (VALUES {_EDGE_ROWS}, ('load', 'prediction'), ('score', 'prediction'))
  AS e(parent, child)),
clo AS (SELECT parent AS ancestor, child AS descendant FROM dedge
  UNION SELECT c.ancestor, e.child FROM clo c JOIN dedge e ON e.parent = c.descendant),
lev AS (SELECT * FROM (VALUES ('weekday', 0), ('value', 0), ('k', 0), ('hour', 1), ('score', 1),
  ('load', 2), ('prediction', 3)) AS l(node, level)),
dr AS (SELECT * FROM nd WHERE verdict = 'DRIFT' AND node <> 'prediction'),
sym AS (SELECT DISTINCT d.model_id, d.window_id, d.node FROM dr d
  JOIN clo c ON c.descendant = d.node
  JOIN dr a ON a.model_id = d.model_id AND a.window_id = d.window_id AND a.node = c.ancestor),
roots AS (SELECT *, row_number() OVER (PARTITION BY model_id, window_id ORDER BY severity DESC, node)
    AS rank FROM (SELECT *, coalesce(psi, 1 - p_value, 0) AS severity FROM dr
      WHERE (model_id, window_id, node) NOT IN (SELECT (model_id, window_id, node) FROM sym))),
paths AS (SELECT r.model_id, r.window_id, r.node,
    coalesce(string_agg(d.node, '>' ORDER BY l.level, d.node), '') AS path
  FROM roots r LEFT JOIN clo c ON c.ancestor = r.node
  LEFT JOIN dr d ON d.model_id = r.model_id AND d.window_id = r.window_id AND d.node = c.descendant
  LEFT JOIN lev l ON l.node = d.node GROUP BY ALL)"""

GRAPH = """fe AS (
  SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION SELECT 's' || l_suppkey, 'o' || l_orderkey FROM lineitem
  UNION SELECT 't' || conv_id || '.' || (turn - 1), 't' || conv_id || '.' || turn
    FROM conversations WHERE turn > 0),
fn AS (SELECT parent AS node FROM fe UNION SELECT child FROM fe),
ge AS (SELECT * FROM fe UNION SELECT node, 'prediction' FROM fn
  WHERE node NOT IN (SELECT parent FROM fe)),
gn AS (SELECT node, CASE WHEN node IN (SELECT child FROM fe) THEN 'derived_feature'
    ELSE 'raw_input' END AS kind FROM fn UNION ALL SELECT 'prediction', 'model_output'),
gc AS (SELECT parent AS ancestor, child AS descendant FROM ge
  UNION SELECT c.ancestor, e.child FROM gc c JOIN ge e ON e.parent = c.descendant),
walk AS (SELECT node, 0 AS level FROM gn WHERE node NOT IN (SELECT child FROM ge)
  UNION SELECT e.child, w.level + 1 FROM walk w JOIN ge e ON e.parent = w.node),
glev AS (SELECT node, max(level) AS level FROM walk GROUP BY node),
gpos AS (SELECT node, level, row_number() OVER (ORDER BY level, node) - 1 AS position FROM glev)"""

SCORES = """sc AS (SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 1000) AS p,
  lang AS g FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"""

CLASSES = """cp AS (SELECT vec_id, CAST(label AS BIGINT) AS y, ten,
  CAST(list_position(ten, list_max(ten)) - 1 AS BIGINT) AS yhat FROM (SELECT *, list_transform(range(0, 10), lambda c: list_reduce(
    list_transform(range(c + 1, len(embedding) + 1, 10), lambda i: CAST(embedding[i] AS DOUBLE)), lambda a, x: a + x)) AS ten FROM embeddings))"""

_MEANS = ", ".join(f"avg({f}) AS m_{f}" for f in COEFFICIENTS)
ATTR = f"""{PE}, mm AS (SELECT {_MEANS} FROM cur),
att AS ({" UNION ALL ".join(
    f"SELECT event_id AS prediction_id, '{f}' AS feature, {f} AS value, CAST({c!r} AS DOUBLE) * ({f} - m_{f}) AS attribution FROM cur, mm"
    for f, c in COEFFICIENTS.items())})"""


def with_(*blocks: str) -> str:
    return "WITH RECURSIVE " + ", ".join(blocks) + " "
