"""Sources, sinks, parsing and projections."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.labels import binary_probability, number_label
from shoreline.operators import graph as G
from shoreline.operators import profile as P
from shoreline.operators.drift import load_thresholds
from shoreline.operators.report import scope_to_model
from shoreline.plans.materialize import shared_dir
from shoreline.queries import inputs as I
from shoreline.sources import events as E
from shoreline.sources import history as H
from shoreline.sources import tables as T

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def r6(c):
    return F.round(c, 6)


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity
  FROM lineitem GROUP BY 1""")
def scan_reference(spark: SparkSession, sf: str) -> DataFrame:
    frame = T.scan_reference(spark, f"{sf}/lineitem.parquet")
    return frame.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity")
    )


def _event_json(spark: SparkSession, sf: str) -> DataFrame:
    events = I.features_map(I.prediction_events(spark, sf))
    envelope = events.select(
        F.col("event_id").cast("string").alias("event_id"), "model_id", "ts", "features",
        "prediction", "probability", "source",
    )
    return E.to_event_json(envelope)


@query(I.with_(I.PE) + """SELECT model_id, count(*) AS n, round(sum(value), 6) AS value,
  round(sum(probability), 6) AS probability, count(weekday) AS weekdays FROM pe GROUP BY 1""")
def replay_events(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "events")
    _event_json(spark, sf).write.text(path)
    return _event_totals(E.replay_events(spark, path))


def _event_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("model_id").agg(
        F.count("*").alias("n"),
        r6(F.sum("features.value.num")).alias("value"),
        r6(F.sum("probability")).alias("probability"),
        F.count("features.weekday.text").alias("weekdays"),
    )


@query(I.with_(I.PE) + """SELECT model_id, count(*) AS n, round(sum(value), 6) AS value,
  round(sum(probability), 6) AS probability, count(weekday) AS weekdays FROM pe GROUP BY 1""")
def tail_events(spark: SparkSession, sf: str) -> DataFrame:
    path, out = scratch(spark, "log"), scratch(spark, "tail")
    _event_json(spark, sf).write.text(path)
    stream = E.tail_events(spark, path)
    job = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-progress")
        .trigger(availableNow=True)
        .start(out)
    )
    job.awaitTermination()
    return _event_totals(spark.read.schema(stream.schema).parquet(out))


@query("SELECT count(*) AS lines, count(DISTINCT event_id) AS ids FROM events")
def emit_events(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "emitted")
    events = I.features_map(I.prediction_events(spark, sf)).select("event_id", "ts", "features")
    E.emit_events(events, path)
    return spark.read.text(path).agg(
        F.count("*").alias("lines"),
        F.countDistinct(F.get_json_object("value", "$.event_id")).alias("ids"),
    )


@query("""SELECT DISTINCT 'n' || c_nationkey AS parent, 'g' || c_nationkey || '-' || c_mktsegment AS child
  FROM customer UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION SELECT 'g' || c_nationkey || '-' || c_mktsegment, 'prediction' FROM customer
  UNION SELECT 'n' || n_nationkey, 'prediction' FROM nation
    WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def load_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Writes a graph file whose nodes are regions, nations and market segments, and reads it."""
    nation, customer = I.table(spark, sf, "nation"), I.table(spark, sf, "customer")
    name = lambda *cs: F.concat(*[F.lit(c) if len(c) == 1 else F.col(c).cast("string") for c in cs])
    edges = (
        nation.select(F.array(name("r", "n_regionkey"), name("n", "n_nationkey")).alias("e"))
        .union(
            customer.select(
                F.array(name("n", "c_nationkey"), name("g", "c_nationkey", "-", "c_mktsegment"))
            )
        )
        .distinct()
    )
    path = scratch(spark, "graph")
    # A graph file is one document: nations times market segments, whatever the table size.
    edges.agg(F.to_json(F.struct(F.collect_list("e").alias("edges"))).alias("value")).coalesce(
        1
    ).write.text(path)
    return G.load_graph(spark, path).edges


@query(I.with_(I.BASE) + """SELECT model_id, node, 'continuous' AS kind, count(*) AS n, count(*) AS baseline_n
  FROM ref_long WHERE num IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT model_id, node, 'categorical', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM bcat GROUP BY 1, 2""")
def store_baseline(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "baselines")
    T.store_baseline(I.baseline(spark, sf), path, "v1")
    return T.load_baseline(spark, path, "v1").nodes.select(
        "model_id", "node", "kind", "n", "baseline_n"
    )


@query(I.with_(I.PE) + """, n AS (SELECT model_id, unnest(['value','k','hour','load','score','weekday','prediction']) AS node
    FROM (SELECT DISTINCT model_id FROM ref)),
  o AS (SELECT 'value' AS node, round(avg(probability) / 100, 6) AS ks_pvalue, CAST(NULL AS DOUBLE) AS psi_drift FROM ref
    UNION ALL SELECT 'weekday', NULL, round(avg(probability), 6) FROM ref)
  SELECT model_id, node, coalesce(o.ks_pvalue, 0.05) AS ks_pvalue, CAST(0.1 AS DOUBLE) AS psi_warning,
    coalesce(o.psi_drift, 0.2) AS psi_drift FROM n LEFT JOIN o USING (node)""")
def load_thresholds_query(spark: SparkSession, sf: str) -> DataFrame:
    ref = I.reference(spark, sf)
    mean = F.avg("probability")
    none = F.lit(None).cast("double")
    overrides = ref.agg(r6(mean / 100).alias("a"), r6(mean).alias("b")).select(
        F.explode(
            F.array(
                F.struct(F.lit("value").alias("node"), F.col("a").alias("ks_pvalue"),
                         none.alias("psi_warning"), none.alias("psi_drift")),
                F.struct(F.lit("weekday").alias("node"), none.alias("ks_pvalue"),
                         none.alias("psi_warning"), F.col("b").alias("psi_drift")),
            )
        ).alias("o")
    ).select("o.*")
    return load_thresholds(I.baseline(spark, sf).nodes, overrides).drop("kind", "baseline_n")


QUERIES["load_thresholds"] = QUERIES.pop("load_thresholds_query")


@query(I.with_(I.PE) + """SELECT model_id, count(*) AS records, max(window_id) AS latest_window,
  CAST(sum(n) AS BIGINT) AS events FROM (SELECT model_id, window_id, count(*) AS n FROM win GROUP BY ALL) GROUP BY 1""")
def append_window_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, the second written twice as after a restart."""
    records = I.windowed(spark, sf).groupBy("model_id", "window_id").agg(
        F.count("*").alias("event_count")
    )
    path = scratch(spark, "history")
    for batch, part in ((0, "window_id < 5"), (1, "window_id >= 5"), (1, "window_id >= 5")):
        H.append_window_history(records.filter(part), path, batch)
    return H.read_history(spark, path).groupBy("model_id").agg(
        F.count("*").alias("records"),
        F.max("window_id").alias("latest_window"),
        F.sum("event_count").alias("events"),
    )


@query(I.with_(I.PE) + """SELECT model_id, valid, count(*) AS n FROM (
    SELECT CASE WHEN value < 5 THEN NULL ELSE model_id END AS model_id,
      value >= 5 AND k <> 7 AS valid FROM pe) GROUP BY ALL""")
def validate_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a truncated text (small values) or a list as feature value (k = 7)."""
    events = I.prediction_events(spark, sf)
    body = F.to_json(F.struct("event_id", "model_id", F.struct("value", "k", "weekday").alias("features")))
    broken = F.when(F.col("value") < 5, F.left(body, F.lit(12))).when(
        F.col("k") == 7, F.regexp_replace(body, r'"k":7\.0', '"k":[7]')
    )
    texts = events.select(F.coalesce(broken, body).alias("value"))
    return E.parse_events(texts).groupBy("model_id", "valid").agg(F.count("*").alias("n"))


@query(I.with_(I.BASE) + "SELECT model_id, event_id, node, num, cat FROM ref_long")
def unpivot_features(spark: SparkSession, sf: str) -> DataFrame:
    events = I.features_map(I.reference(spark, sf))
    nodes = I.baseline(spark, sf).nodes
    return P.unpivot_features(events, nodes, ["model_id", "event_id"]).drop("kind")


@query("""SELECT l_returnflag, node, count(value) AS n, round(sum(value), 4) AS total FROM (
  SELECT l_returnflag, 'l_quantity' AS node, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2""")
def collect_batch_features(spark: SparkSession, sf: str) -> DataFrame:
    frame = I.table(spark, sf, "lineitem")
    long = P.collect_batch_features(frame, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    return long.groupBy("l_returnflag", "node").agg(
        F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR)
  ELSE CAST(x AS VARCHAR) END AS label FROM (SELECT floor(value * 2) / 2 AS x FROM events
  UNION ALL SELECT value FROM events)) GROUP BY 1""")
def output_label(spark: SparkSession, sf: str) -> DataFrame:
    events = I.table(spark, sf, "events")
    halves = events.select((F.floor(F.col("value") * 2) / 2).alias("x")).union(events.select("value"))
    return halves.groupBy(number_label(F.col("x")).alias("label")).agg(F.count("*").alias("n"))


@query(I.with_(I.PE) + """SELECT event_id, 'prediction' AS node, CASE WHEN k < 50 THEN NULL ELSE value END AS num,
  CASE WHEN k < 50 THEN coalesce(CASE WHEN hour < 12 THEN CAST(prediction AS VARCHAR) END, CAST(CAST(hour AS BIGINT) AS VARCHAR)) END AS cat FROM pe""")
def output_node_values(spark: SparkSession, sf: str) -> DataFrame:
    """Models of both kinds: labels where k < 50 (from the output after noon), numbers elsewhere."""
    classifier = F.col("k") < 50
    events = I.prediction_events(spark, sf).withColumn(
        "output", F.when(classifier, F.col("hour")).otherwise(F.col("value"))
    ).withColumn("prediction", F.when(classifier & (F.col("hour") < 12), F.col("prediction")))
    return P.output_node_values(events, ["event_id"], classifier).drop("kind")


@query(I.with_(I.PE) + """SELECT sha1('m1:' || event_id) AS event_id, 'm1' AS model_id, 'v3' AS model_version,
  prediction, round(probability, 6) AS probability, CAST(prediction AS DOUBLE) AS output, 'batch' AS source FROM pe""")
def standardize_predictions(spark: SparkSession, sf: str) -> DataFrame:
    scored = I.features_map(I.prediction_events(spark, sf)).withColumn("output", F.col("prediction"))
    events = E.standardize_predictions(
        scored.withColumnRenamed("event_id", "row_key"), "m1", "v3", source="batch"
    )
    return events.select(
        "event_id", "model_id", "model_version", "prediction",
        r6("probability").alias("probability"), "output", "source",
    )


@query(I.with_(I.PE) + """SELECT event_id, CASE WHEN k >= 30 THEN prediction ELSE CAST(CASE WHEN value * hour >= 500 THEN 1 ELSE 0 END AS BIGINT) END AS prediction,
  round(CASE WHEN k >= 30 THEN probability ELSE (value * hour) / (value * hour + 500) END, 6) AS probability FROM pe""")
def score_missing_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Events with k < 30 arrive without a result and are scored by a vectorised model."""
    @F.pandas_udf("struct<prediction: bigint, probability: double, output: double>")
    def model(value: pd.Series, hour: pd.Series) -> pd.DataFrame:
        raw = value * hour
        label = (raw >= 500).astype("int64")
        return pd.DataFrame(
            {"prediction": label, "probability": raw / (raw + 500), "output": label.astype("float64")}
        )

    given = F.col("k") >= 30
    events = I.features_map(I.prediction_events(spark, sf))
    events = events.withColumn("output", F.when(given, F.col("prediction").cast("double")))
    events = events.withColumn("prediction", F.when(given, F.col("prediction"))).withColumn(
        "probability", F.when(given, F.col("probability"))
    )
    done = E.score_missing_outputs(events, model("features.value.num", "features.hour.num"))
    return done.select("event_id", "prediction", r6("probability").alias("probability"))


@query("""SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN 1 - s ELSE list_max([s, s * s, 1 - s - s * s]) END, 6) AS probability
  FROM (SELECT vec_id, label, CAST(abs(embedding[1]) AS DOUBLE) / 2 AS s FROM embeddings)""")
def binary_probability_query(spark: SparkSession, sf: str) -> DataFrame:
    s = F.abs(F.col("embedding")[0]).cast("double") / 2
    rows = I.table(spark, sf, "embeddings").withColumn("s", s)
    two = F.array("s", 1 - F.col("s"))
    three = F.array(F.col("s"), F.col("s") * F.col("s"), 1 - F.col("s") - F.col("s") * F.col("s"))
    proba = F.when(F.col("label") % 2 == 0, two).otherwise(three)
    return rows.select("vec_id", r6(binary_probability(proba)).alias("probability"))


QUERIES["binary_probability"] = QUERIES.pop("binary_probability_query")


@query(I.with_(I.PE) + """SELECT event_id, concat_ws(',', CASE WHEN k < 20 THEN 'k' END, CASE WHEN hour < 6 THEN 'hour' END) AS missing
  FROM pe WHERE k < 20 OR hour < 6""")
def missing_required_features(spark: SparkSession, sf: str) -> DataFrame:
    events = I.features_map(I.prediction_events(spark, sf))
    partial = events.withColumn(
        "features",
        F.map_filter(
            "features",
            lambda key, _: ~((key == "k") & (F.col("k") < 20)) & ~((key == "hour") & (F.col("hour") < 6)),
        ),
    )
    found = E.missing_required_features(partial, ["value", "k", "hour"])
    return found.select("event_id", F.array_join("missing", ",").alias("missing"))


@query("""SELECT o_totalprice, o_orderstatus, c_acctbal FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey)
  WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND c_acctbal IS NOT NULL ORDER BY o_orderkey LIMIT 1""")
def representative_row(spark: SparkSession, sf: str) -> DataFrame:
    keep = lambda c, cond: F.when(cond, F.col(c)).alias(c)
    frame = I.table(spark, sf, "orders").join(
        I.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        "o_orderkey",
        keep("o_totalprice", F.col("o_totalprice") > 200000),
        keep("o_orderstatus", F.col("o_orderstatus") != "O"),
        keep("c_acctbal", F.col("c_acctbal") > 0),
    )
    return P.representative_row(frame, ["o_totalprice", "o_orderstatus", "c_acctbal"], ["o_orderkey"])


@query("SELECT event_id, event_type AS model_id FROM events WHERE event_type = 'click' AND user_id >= 5")
def scope_to_model_query(spark: SparkSession, sf: str) -> DataFrame:
    """Records of low user numbers carry no model and never match."""
    events = I.table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") >= 5, F.col("event_type")).alias("model_id")
    )
    return scope_to_model(events, "click")


QUERIES["scope_to_model"] = QUERIES.pop("scope_to_model_query")
