"""Graphs and root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators import graph as G
from shoreline.operators import rca as R
from shoreline.queries import inputs as I

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__.removesuffix("_query")] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


@query(I.with_(I.GRAPH) + "SELECT parent AS a, child AS b, 'edge' AS what FROM ge UNION ALL SELECT node, kind, 'node' FROM gn")
def graph_from_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = G.graph_from_edges(I.feature_edges(spark, sf), unique=True)
    return g.edges.select(
        F.col("parent").alias("a"), F.col("child").alias("b"), F.lit("edge").alias("what")
    ).unionByName(
        g.nodes.select(F.col("node").alias("a"), F.col("kind").alias("b"), F.lit("node").alias("what"))
    )


@query("""WITH d AS (SELECT 'c' || c_custkey AS node, CASE WHEN c_acctbal < 0 THEN 'raw_input' END AS kind, ['n' || c_nationkey] AS parents FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 'raw_input', CAST([] AS VARCHAR[]) FROM nation),
  e AS (SELECT DISTINCT unnest(parents) AS parent, node AS child FROM d)
  SELECT parent AS a, child AS b, 'edge' AS what FROM e
  UNION ALL SELECT node, 'prediction', 'edge' FROM d WHERE node NOT IN (SELECT parent FROM e)
  UNION ALL SELECT node, coalesce(kind, 'derived_feature'), 'node' FROM d UNION ALL SELECT 'prediction', 'model_output', 'node'""")
def graph_from_nodes(spark: SparkSession, sf: str) -> DataFrame:
    c, n = I.table(spark, sf, "customer"), I.table(spark, sf, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    declared = c.select(
        name("c", "c_custkey").alias("node"),
        F.when(F.col("c_acctbal") < 0, "raw_input").alias("kind"),
        F.array(name("n", "c_nationkey")).alias("parents"),
    ).union(n.select(name("n", "n_nationkey"), F.lit("raw_input"), F.array().cast("array<string>")))
    g = G.graph_from_nodes(declared)
    return g.edges.select(
        F.col("parent").alias("a"), F.col("child").alias("b"), F.lit("edge").alias("what")
    ).unionByName(
        g.nodes.select(F.col("node").alias("a"), F.col("kind").alias("b"), F.lit("node").alias("what"))
    )


@query("SELECT DISTINCT p_brand || '/' || p_type AS parent, 'prediction' AS child FROM part")
def trivial_graph(spark: SparkSession, sf: str) -> DataFrame:
    names = I.table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("node"))
    return G.trivial_graph(names).edges


@query("""WITH RECURSIVE names AS (SELECT 'c' || c_custkey AS node, CASE WHEN c_acctbal > 9900 THEN 'unknown' ELSE 'raw_input' END AS kind FROM customer
    UNION ALL SELECT 'n' || n_nationkey, 'raw_input' FROM nation),
  e AS (SELECT DISTINCT * FROM (SELECT 'n' || (c_nationkey + CASE WHEN c_custkey % 500 = 7 THEN 100 ELSE 0 END) AS parent, 'c' || c_custkey AS child FROM customer WHERE c_acctbal < 9950
    UNION ALL SELECT CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 3 THEN 'c' || c_custkey END, 'n' || c_nationkey FROM customer WHERE c_acctbal < 0 AND c_nationkey = 3
    UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation WHERE n_regionkey = 4)),
  pr AS (SELECT * FROM e WHERE parent <> child),
  clo AS (SELECT parent AS a, child AS d FROM pr UNION SELECT c.a, p.child FROM clo c JOIN pr p ON p.parent = c.d)
  SELECT 'malformed_edge' AS rule, coalesce(parent, '?') || '->' || coalesce(child, '?') AS subject FROM e WHERE parent IS NULL OR child IS NULL
  UNION ALL SELECT 'self_edge', parent FROM e WHERE parent = child
  UNION ALL SELECT 'invalid_kind', node FROM names WHERE kind = 'unknown'
  UNION ALL SELECT 'undefined_parent', parent || '->' || child FROM pr WHERE parent NOT IN (SELECT node FROM names)
  UNION ALL SELECT 'orphan', node FROM names WHERE node NOT IN (SELECT parent FROM pr UNION SELECT child FROM pr)
  UNION ALL SELECT 'cycle', a FROM clo WHERE a = d
  UNION ALL SELECT 'unknown_feature', node FROM (SELECT parent AS node FROM pr UNION SELECT child FROM pr) WHERE node NOT IN (SELECT node FROM names)""")
def validate_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Customers below nations, with faults that follow from the data."""
    c, n = I.table(spark, sf, "customer"), I.table(spark, sf, "nation")
    name = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    cust, nat = F.col("c_custkey"), F.col("c_nationkey")
    lost = F.when(cust % 500 == 7, 100).otherwise(0)
    back = c.filter((F.col("c_acctbal") < 0) & (nat == 3))
    edges = (
        c.filter(F.col("c_acctbal") < 9950)
        .select(name("n", nat + lost).alias("parent"), name("c", cust).alias("child"))
        .union(
            back.select(
                F.when(F.col("c_mktsegment") == "MACHINERY", name("c", cust)), name("n", nat)
            )
        )
        .union(
            n.filter("n_regionkey = 4").select(
                name("n", F.col("n_nationkey")), name("n", F.col("n_nationkey"))
            )
        )
    )
    nodes = c.select(
        name("c", cust).alias("node"),
        F.when(F.col("c_acctbal") > 9900, "unknown").otherwise("raw_input").alias("kind"),
    ).union(n.select(name("n", F.col("n_nationkey")), F.lit("raw_input")))
    return G.validate_graph(nodes, edges, nodes)


@query(I.with_(I.GRAPH) + "SELECT descendant AS node, ancestor FROM gc")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return G.ancestors(G.transitive_closure(I.data_graph(spark, sf).edges, unique=True))


@query(I.with_(I.GRAPH) + "SELECT ancestor AS node, descendant FROM gc")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return G.descendants(G.transitive_closure(I.data_graph(spark, sf).edges, unique=True))


@query(I.with_(I.GRAPH) + "SELECT node, CAST(level AS BIGINT) AS level, position FROM gpos")
def topological_order(spark: SparkSession, sf: str) -> DataFrame:
    g = I.data_graph(spark, sf)
    order = G.topological_order(G.node_levels(g.nodes, g.edges, unique=True))
    return order.select("node", F.col("level").cast("bigint").alias("level"), "position")


@query(I.with_(I.GRAPH) + "SELECT child AS node, 'parent' AS relation, parent AS neighbor FROM ge UNION ALL SELECT parent, 'child', child FROM ge")
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_neighbors(I.data_graph(spark, sf).edges, unique=True)


@query(I.with_(I.GRAPH) + "SELECT node, kind, position FROM gn JOIN gpos USING (node) WHERE kind <> 'model_output'")
def feature_nodes(spark: SparkSession, sf: str) -> DataFrame:
    order = G.topological_order(I.data_levels(spark, sf))
    return G.feature_nodes(I.data_graph(spark, sf).nodes, order).select("node", "kind", "position")


@query(I.with_(I.GRAPH) + """SELECT parent, child, p.position AS parent_pos, c.position AS child_pos FROM ge
  JOIN gpos p ON p.node = parent JOIN gpos c ON c.node = child""")
def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    order = G.topological_order(I.data_levels(spark, sf))
    return G.edge_list(I.data_graph(spark, sf).edges, order, unique=True)


@query(I.with_(I.GRAPH) + """, up AS (SELECT node, 0 AS h FROM fn WHERE node NOT IN (SELECT parent FROM fe)
    UNION SELECT e.parent, u.h + 1 FROM up u JOIN fe e ON e.child = u.node),
  hh AS (SELECT node, max(h) AS h FROM up GROUP BY node),
  nx AS (SELECT e.parent, min(e.child) AS child FROM fe e JOIN hh p ON p.node = e.parent JOIN hh c ON c.node = e.child WHERE c.h = p.h - 1 GROUP BY 1),
  ch AS (SELECT 0 AS step, (SELECT node FROM hh ORDER BY h DESC, node LIMIT 1) AS node
    UNION ALL SELECT step + 1, child FROM ch JOIN nx ON nx.parent = ch.node)
  SELECT step, node FROM ch""")
def longest_chain(spark: SparkSession, sf: str) -> DataFrame:
    return G.longest_chain(I.data_graph(spark, sf).edges, unique=True)


def _both(spark: SparkSession, sf: str):
    return I.node_drift(spark, sf), I.declared_closure(spark)


@query(I.with_(I.RCA) + "SELECT model_id, window_id, node FROM roots")
def rca_roots(spark: SparkSession, sf: str) -> DataFrame:
    return R.rca_roots(*_both(spark, sf)).select("model_id", "window_id", "node")


@query(I.with_(I.RCA) + "SELECT model_id, window_id, node FROM sym")
def rca_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    return R.rca_symptoms(*_both(spark, sf)).select("model_id", "window_id", "node")


@query(I.with_(I.RCA) + "SELECT model_id, window_id, node, path FROM paths")
def symptom_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = R.symptom_paths(
        I.node_drift(spark, sf), I.roots(spark, sf), I.declared_closure(spark), I.declared_levels(spark)
    )
    return found.select("model_id", "window_id", "node", F.array_join("symptom_path", ">").alias("path"))


@query(I.with_(I.RCA) + "SELECT model_id, window_id, node, round(severity, 6) AS severity, CAST(rank AS BIGINT) AS rank FROM roots")
def root_severity(spark: SparkSession, sf: str) -> DataFrame:
    ranked = R.root_severity(R.rca_roots(*_both(spark, sf)))
    return ranked.select(
        "model_id", "window_id", "node", r6("severity").alias("severity"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@query(I.with_(I.RCA) + """SELECT nd.model_id, nd.window_id, nd.node, CASE WHEN r.node IS NOT NULL THEN 'ROOT_CAUSE' WHEN s.node IS NOT NULL THEN 'SYMPTOM'
    WHEN nd.verdict IN ('WARNING', 'INSUFFICIENT_DATA') THEN nd.verdict ELSE 'STABLE' END AS classification
  FROM nd LEFT JOIN roots r USING (model_id, window_id, node) LEFT JOIN sym s USING (model_id, window_id, node)""")
def classify_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return R.classify_nodes(*_both(spark, sf)).select(
        "model_id", "window_id", "node", "classification"
    )


@query(I.with_(I.RCA) + """SELECT p.model_id, p.window_id, p.node AS root, count(*) AS evidence_nodes, round(sum(nd.psi), 5) AS total_psi
  FROM (SELECT model_id, window_id, node, unnest(list_append(CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(path, '>') END, node)) AS member FROM paths) p
  JOIN nd ON nd.model_id = p.model_id AND nd.window_id = p.window_id AND nd.node = p.member GROUP BY ALL""")
def rca_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = R.rca_evidence(I.node_drift(spark, sf), I.paths(spark, sf))
    psi = F.aggregate(
        F.map_values("evidence"), F.lit(0.0), lambda a, r: a + F.coalesce(r["psi"], F.lit(0.0))
    )
    return found.select(
        "model_id", "window_id", "root", F.size("evidence").cast("bigint").alias("evidence_nodes"),
        F.round(psi, 5).alias("total_psi"),
    )


@query(I.with_(I.RCA) + """SELECT model_id, window_id, node AS root_cause, round(severity, 6) AS severity, path
  FROM roots JOIN paths USING (model_id, window_id, node) WHERE rank = 1""")
def primary_root(spark: SparkSession, sf: str) -> DataFrame:
    found = R.primary_root(I.roots(spark, sf), I.paths(spark, sf))
    return found.select(
        "model_id", "window_id", "root_cause", r6("severity").alias("severity"),
        F.array_join("symptom_path", ">").alias("path"),
    )


_KEYED = f"""{I.ND}, mm AS (SELECT DISTINCT model_id FROM pe),
  ke AS (SELECT model_id, CASE WHEN model_id < 'm' THEN a ELSE b END AS parent, CASE WHEN model_id < 'm' THEN b ELSE a END AS child
    FROM mm, (VALUES {", ".join(f"('{a}', '{b}')" for a, b in I.EDGES)}) AS e(a, b)),
  kc AS (SELECT model_id, parent AS ancestor, child AS descendant FROM ke
    UNION SELECT c.model_id, c.ancestor, e.child FROM kc c JOIN ke e ON e.model_id = c.model_id AND e.parent = c.descendant),
  kw AS (SELECT DISTINCT model_id, parent AS node, 0 AS level FROM ke WHERE (model_id, parent) NOT IN (SELECT (model_id, child) FROM ke)
    UNION SELECT e.model_id, e.child, w.level + 1 FROM kw w JOIN ke e ON e.model_id = w.model_id AND e.parent = w.node),
  kl AS (SELECT model_id, node, max(level) AS level FROM kw GROUP BY 1, 2),
  kd AS (SELECT * FROM nd WHERE verdict = 'DRIFT' AND node <> 'prediction'),
  ks2 AS (SELECT DISTINCT d.model_id, d.window_id, d.node FROM kd d JOIN kc c ON c.model_id = d.model_id AND c.descendant = d.node
    JOIN kd a ON a.model_id = d.model_id AND a.window_id = d.window_id AND a.node = c.ancestor),
  kr AS (SELECT *, row_number() OVER (PARTITION BY model_id, window_id ORDER BY coalesce(psi, 1 - p_value, 0) DESC, node) AS rank FROM kd
    WHERE (model_id, window_id, node) NOT IN (SELECT (model_id, window_id, node) FROM ks2))"""


@query(I.with_(_KEYED) + """SELECT r.model_id, r.window_id, r.node, r.rank, coalesce(string_agg(d.node, '>' ORDER BY l.level, d.node), '') AS path
  FROM kr r LEFT JOIN kc c ON c.model_id = r.model_id AND c.ancestor = r.node
  LEFT JOIN kd d ON d.model_id = r.model_id AND d.window_id = r.window_id AND d.node = c.descendant
  LEFT JOIN kl l ON l.model_id = d.model_id AND l.node = d.node GROUP BY ALL""")
def rca_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Models of equal feature names with graphs of their own: the edges point the other way in some."""
    models = I.table(spark, sf, "events").select(F.col("event_type").alias("model_id")).distinct()
    first = F.col("model_id") < "m"
    ways = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in I.EDGES])
    edges = models.select("model_id", F.explode(ways).alias("e")).select(
        "model_id",
        F.when(first, F.col("e.a")).otherwise(F.col("e.b")).alias("parent"),
        F.when(first, F.col("e.b")).otherwise(F.col("e.a")).alias("child"),
    )
    key = ["model_id"]
    graph = G.graph_from_edges(edges, key)
    closure = G.transitive_closure(graph.edges, key)
    drift = I.node_drift(spark, sf)
    ranked = R.root_severity(R.rca_roots(drift, closure))
    paths = R.symptom_paths(drift, ranked, closure, G.node_levels(graph.nodes, graph.edges, key))
    return ranked.join(paths, ["model_id", "window_id", "node"]).select(
        "model_id", "window_id", "node", "rank", F.array_join("symptom_path", ">").alias("path")
    )
