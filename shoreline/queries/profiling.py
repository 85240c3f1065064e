"""Profiles, baselines and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators import profile as P
from shoreline.operators import windows as W
from shoreline.plans.materialize import shared_dir
from shoreline.queries import inputs as I
from shoreline.streaming.live import LiveWindows

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


@query("""SELECT CAST(0 AS INT) AS pos, 'l_quantity' AS node, 'continuous' AS kind, count(l_quantity) AS n, count(*) AS n_rows FROM lineitem
  UNION ALL SELECT 1, 'l_discount', 'continuous', count(CASE WHEN l_discount > 0 THEN 1 END), count(*) FROM lineitem
  UNION ALL SELECT 2, 'l_returnflag', 'categorical', count(CASE WHEN l_returnflag <> 'N' THEN 1 END), count(*) FROM lineitem""")
def reference_profile(spark: SparkSession, sf: str) -> DataFrame:
    frame = I.table(spark, sf, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("l_returnflag"),
    )
    return P.reference_profile(frame, frame.columns)


def _lineitem_text(spark: SparkSession, sf: str) -> DataFrame:
    frame = I.table(spark, sf, "lineitem")
    return P.collect_batch_categories(frame, [], ["l_returnflag", "l_linestatus"])


@query("""SELECT node, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY node), 6) AS prop FROM (
  SELECT 'l_returnflag' AS node, l_returnflag AS category FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem) GROUP BY 1, 2""")
def category_proportions(spark: SparkSession, sf: str) -> DataFrame:
    shares = P.category_proportions(_lineitem_text(spark, sf), [])
    return shares.select("node", "category", "n", r6("prop").alias("prop"))


@query("""SELECT node, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5(CAST(event_id AS VARCHAR)), CAST(event_id AS VARCHAR)) AS rn
  FROM (SELECT event_id, 'value' AS node, value FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events)) WHERE rn <= 5000""")
def reference_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.with_row_hash(I.table(spark, sf, "events"), F.col("event_id"))
    numeric = P.collect_batch_features(rows, ["row_hash", "row_key"], ["value", "user_id"])
    return P.reference_sample(numeric, [], I.SAMPLE_CAP)


@query(I.with_(I.BASE) + """SELECT model_id, node, count(*) AS n, round(sum(num), 4) AS total FROM ref_long
  WHERE node IN ('value', 'k', 'hour', 'load', 'score', 'weekday') GROUP BY ALL""")
def graph_baseline(spark: SparkSession, sf: str) -> DataFrame:
    graph = I.declared_graph(spark)
    names = graph.nodes.filter(F.col("kind") != "model_output")
    frame = I.reference(spark, sf)
    long = P.unpivot_columns(frame, ["model_id"], [*I.FEATURES, "probability"])
    return P.graph_baseline(long, names).groupBy("model_id", "node").agg(
        F.count("*").alias("n"), F.round(F.sum("num"), 4).alias("total")
    )


@query(I.with_(I.PE) + """SELECT model_id, 'prediction' AS node, CAST(prediction AS VARCHAR) AS category, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (PARTITION BY model_id), 6) AS prop
  FROM pe GROUP BY model_id, prediction""")
def output_baseline(spark: SparkSession, sf: str) -> DataFrame:
    outputs = I.prediction_events(spark, sf).select(
        "model_id", "prediction", F.lit(None).cast("double").alias("output")
    )
    shares = P.output_baseline(outputs)
    return shares.withColumn("prop", r6("prop"))


@query(I.with_(I.BASE) + """SELECT model_id, node, baseline_n, CAST(n_bins AS BIGINT) AS n_bins,
    array_to_string(list_transform(inn, lambda x: printf('%.6f', x)), ',') AS inner_edges FROM edges""")
def quantile_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = P.quantile_edges(I.baseline(spark, sf).values)
    inner = F.filter("edges", lambda e: F.abs(e) < float("inf"))
    text = F.array_join(F.transform(inner, lambda e: F.format_string("%.6f", e)), ",")
    return edges.select(
        "model_id", "node", "baseline_n", F.col("n_bins").cast("bigint").alias("n_bins"),
        text.alias("inner_edges"),
    )


QUERIES["quantile_edges_whole"] = QUERIES["quantile_edges"]


@query("""SELECT 'l_quantity' AS node, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem
  UNION ALL SELECT 'l_tax', round(stddev_pop(l_tax), 6) FROM lineitem
  UNION ALL SELECT 'one', 1.0""")
def feature_spread(spark: SparkSession, sf: str) -> DataFrame:
    frame = I.table(spark, sf, "lineitem").select("l_quantity", "l_tax", F.lit(1).alias("one"))
    long = P.unpivot_columns(frame, [], frame.columns)
    return P.feature_spread(long, []).select("node", r6("spread").alias("spread"))


@query(I.with_(I.PE) + "SELECT model_id, event_id, window_id FROM win")
def count_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = I.current(spark, sf).select("model_id", "event_id", "ts")
    return W.count_windows(events, I.SIZE).drop("ts")


@query(I.with_(I.PE) + "SELECT model_id, event_id, window_id FROM win")
def count_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows from a stream of files, unfilled windows closed at the end."""
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    events = I.current(spark, sf).select("model_id", "event_id", "ts")
    events.write.parquet(f"{base}/in")
    found = f"{base}/out"

    def evaluate(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{found}/batch_id={batch_id}")

    live = LiveWindows(f"{base}/state", evaluate, size=I.SIZE)
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    live.start(stream, f"{base}/progress", bounded=True).awaitTermination()
    live.flush(spark)
    return spark.read.parquet(found).select("model_id", "event_id", "window_id")


@query(I.with_(I.PE) + """SELECT model_id, window_id, count(*) AS event_count, count(*) >= 30 AS sufficient, round(avg(value), 6) AS mean_value,
  round(avg(k), 6) AS mean_k, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM win GROUP BY 1, 2""")
def window_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = W.window_summary(I.windowed(spark, sf), ["value", "k"], I.CONFIG)
    return summary.select(
        "model_id", "window_id", "event_count", "sufficient", r6("mean_value").alias("mean_value"),
        r6("mean_k").alias("mean_k"), F.array_join("sources", ",").alias("sources"),
    )


@query(I.with_(I.PE) + """SELECT model_id, window_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start_ts,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS end_ts, count(*) AS event_count FROM win GROUP BY 1, 2""")
def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    bounds = W.window_bounds(I.windowed(spark, sf))
    return bounds.select("model_id", "window_id", text("start_ts"), text("end_ts"), "event_count")


@query(I.with_(I.PE) + """SELECT model_id, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS event_count,
  round(avg(value), 6) AS mean_value FROM pe GROUP BY 1, 2""")
def time_windows(spark: SparkSession, sf: str) -> DataFrame:
    timed = W.time_windows(I.prediction_events(spark, sf), "6 hours")
    return timed.groupBy(
        "model_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start")
    ).agg(F.count("*").alias("event_count"), r6(F.avg("value")).alias("mean_value"))
