"""Model quality, data quality, sensitivity and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.labels import prediction_label as label_of
from shoreline.operators import attribution as A
from shoreline.operators import evaluation as V
from shoreline.operators import profile as P
from shoreline.operators import quality as Q
from shoreline.operators import sensitivity as N
from shoreline.queries import inputs as I

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__.removesuffix("_query")] = (fn, sql)
        return fn

    return add


def r6(c):
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


@query(I.with_(I.SCORES) + """SELECT n, round((n - fp - fn) / n, 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) AS n,
  count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM sc)""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = V.binary_metrics(I.scores(spark, sf))
    return rounded(found, "accuracy", "precision", "recall", "f1")


@query(I.with_(I.SCORES) + """SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc
  FROM (SELECT p FROM sc WHERE y = 1) a, (SELECT p FROM sc WHERE y <> 1) b""")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.roc_auc(I.scores(spark, sf)), "roc_auc")


@query(I.with_(I.SCORES) + """SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM (
  SELECT pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY p)
  WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.average_precision(I.scores(spark, sf)), "average_precision")


@query(I.with_(I.CLASSES) + """, c AS (SELECT y AS c FROM cp UNION SELECT yhat FROM cp)
  SELECT a.c AS y, b.c AS yhat, coalesce(n, 0) AS n FROM c a, c b LEFT JOIN (SELECT y, yhat, count(*) AS n FROM cp GROUP BY 1, 2) m ON m.y = a.c AND m.yhat = b.c""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return V.confusion_matrix(I.class_predictions(spark, sf))


@query(I.with_(I.CLASSES) + """, c AS (SELECT y AS c FROM cp UNION SELECT yhat FROM cp),
  m AS (SELECT c, (SELECT count(*) FROM cp WHERE y = c AND yhat = c) AS tp, (SELECT count(*) FROM cp WHERE y = c) AS s, (SELECT count(*) FROM cp WHERE yhat = c) AS q FROM c)
  SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(avg(CASE WHEN q = 0 THEN 0 ELSE tp / q END), 6) AS precision_macro,
    round(avg(CASE WHEN s = 0 THEN 0 ELSE tp / s END), 6) AS recall_macro, round(avg(2 * tp / (s + q)), 6) AS f1_macro, round(sum(2 * tp / (s + q) * s) / sum(s), 6) AS f1_weighted FROM m""")
def multiclass_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = V.multiclass_metrics(I.class_predictions(spark, sf))
    return rounded(found, *found.columns)


def _class_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.class_predictions(spark, sf).select(
        F.col("y").alias("label"), F.posexplode("ten").alias("class", "s")
    )
    return rows.select(
        "class", (F.col("label") == F.col("class")).cast("int").alias("y"),
        F.col("s").cast("double").alias("p"),
    )


@query(I.with_(I.CLASSES) + """, k AS (SELECT unnest(range(0, 10)) AS c), x AS (SELECT c, CASE WHEN y = c THEN 1 ELSE 0 END AS y, CAST(ten[c + 1] AS DOUBLE) AS p FROM cp, k)
  SELECT round(avg(auc), 6) AS roc_auc_ovr FROM (SELECT a.c, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*) AS auc
    FROM (SELECT * FROM x WHERE y = 1) a JOIN (SELECT * FROM x WHERE y = 0) b ON a.c = b.c GROUP BY a.c)""")
def roc_auc_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.roc_auc_ovr(_class_scores(spark, sf)), "roc_auc_ovr")


@query("""SELECT l_returnflag, round(1 - sum((y - h) * (y - h)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - h)), 4) AS mae, round(sqrt(avg((y - h) * (y - h))), 4) AS rmse
  FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500 AS h FROM lineitem) GROUP BY 1""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat")
    )
    found = V.regression_metrics(rows, ["l_returnflag"])
    return found.select(
        "l_returnflag", r6("r2").alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse")
    )


_RATES = """fr AS (SELECT g, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) AS selection_rate,
  coalesce(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE y = 1), 0) AS tpr,
  coalesce(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE y = 0), 0) AS fpr FROM sc GROUP BY g)"""


@query(I.with_(I.SCORES, _RATES) + "SELECT g, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM fr")
def fairness_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.fairness_rates(I.scores(spark, sf)), "selection_rate", "tpr", "fpr")


@query(I.with_(I.SCORES, _RATES) + """SELECT round(max(selection_rate) - min(selection_rate), 6) AS selection_rate_gap,
  round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap FROM fr""")
def fairness_gaps(spark: SparkSession, sf: str) -> DataFrame:
    found = V.fairness_gaps(V.fairness_rates(I.scores(spark, sf)))
    return rounded(found, *found.columns)


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as JSON records; some carry personal fields at different depths."""
    mail = F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), "Email").otherwise("role")
    deep = F.when(F.col("turn") == 3, "ssn").otherwise("turn")
    inner = F.array(F.create_map(deep, F.col("turn").cast("string")))
    return I.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.to_json(
            F.struct(
                "conv_id", "text", F.create_map(mail, F.col("role")).alias("who"), inner.alias("more")
            )
        ).alias("body"),
    )


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'email' END, CASE WHEN turn = 3 THEN 'ssn' END) AS violations FROM conversations""")
def pii_key_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.pii_key_scan(_payloads(spark, sf), "body")
    return found.select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("""SELECT array_to_string(list_sort(list(DISTINCT v) FILTER (WHERE v IS NOT NULL)), ',') AS violations, count(v) = 0 AS passed FROM (
  SELECT CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'email' END AS v FROM conversations UNION ALL SELECT CASE WHEN turn = 3 THEN 'ssn' END FROM conversations)""")
def pii_records_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = Q.pii_records_summary(Q.pii_key_scan(_payloads(spark, sf), "body"))
    return found.select(F.array_join("violations", ",").alias("violations"), "passed")


@query("""SELECT count(*) AS n_rows, sha256(count(*) || """ + " || ".join(f"':' || CAST(sum(CAST(CAST('0x' || substr(h, {at}, {n}) AS BIGINT) AS HUGEINT)) AS VARCHAR)"
  for at, n in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))) + """) AS dataset_version FROM (SELECT sha256(string_agg(coalesce('=' || len(v) || ':' || v, '-'), '' ORDER BY i)) AS h
  FROM (SELECT o_orderkey, unnest(range(0, 4)) AS i, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(o_totalprice AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d')]) AS v FROM orders)
  GROUP BY o_orderkey)""")
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return Q.dataset_fingerprint(orders, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"])


@query("""SELECT 'reference' AS part, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS row_count, 6 AS column_count, true AS columns_match, 'pass' AS status, '' AS reason
  UNION ALL SELECT 'current', (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16'), 6, true, 'pass', ''""")
def dataset_contract(spark: SparkSession, sf: str) -> DataFrame:
    events = I.table(spark, sf, "events")
    cut = F.to_timestamp_ntz(F.lit(I.CUT))
    parts = {"reference": events.filter(F.col("ts") < cut), "current": events.filter(F.col("ts") >= cut)}
    return Q.dataset_contract(parts, ["reference", "current"])


@query("""SELECT doc_id, 'n_chars' AS metric, CAST(n_chars AS DOUBLE) AS value FROM documents
  UNION ALL SELECT doc_id, 'share', round(n_chars / (n_chars + 1000), 6) FROM documents""")
def scalar_metrics(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    body = F.to_json(
        F.struct(
            "n_chars", r6(n / (n + 1000)).alias("share"), "lang", (n > 500).alias("long"),
            F.array(n, n).alias("matrix"), F.struct(n.alias("inner")).alias("nested"),
        )
    )
    docs = I.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return Q.scalar_metrics(docs, "body", ["doc_id"])


_DRAW = """SELECT d.draw, e.event_id FROM (SELECT i AS draw, CAST('0x' || substr(md5('7:' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM events) AS j FROM range(0, (SELECT count(*) FROM events)) r(i)) d
  JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS j FROM events) e USING (j)"""


@query(_DRAW)
def resample_reference(spark: SparkSession, sf: str) -> DataFrame:
    events = I.table(spark, sf, "events").select("event_id")
    return N.resample_reference(events, ["event_id"], events.count())


_SHIFT = I.with_(I.BASE) + """, spread AS (SELECT model_id, node, coalesce(nullif(stddev_pop(num), 0), 1) AS sd FROM ref_long WHERE num IS NOT NULL GROUP BY 1, 2),
  lv AS (SELECT r.model_id, r.node, i.w AS window_id, r.num + CASE WHEN r.node IN ('value', 'k') THEN i.x * 1.5 * sd ELSE 0 END AS num
    FROM ref_long r JOIN spread USING (model_id, node), (VALUES (0, 0.0), (1, 0.5), (2, 1.0)) AS i(w, x) WHERE r.num IS NOT NULL),
  tot AS (SELECT model_id, node, window_id, count(*) AS n FROM lv GROUP BY ALL),
  cb AS (SELECT l.model_id, l.node, l.window_id, len(list_filter(e.inn, lambda x: x <= l.num)) AS bin, count(*) AS n FROM lv l JOIN edges e USING (model_id, node) GROUP BY ALL)
  SELECT t.model_id, CAST(t.window_id AS BIGINT) AS window_id, CAST(CASE t.window_id WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS intensity, t.node,
    round(sum(""" + I.term("coalesce(c.n, 0) / t.n", "b.baseline_prop") + """), 6) AS psi
  FROM tot t JOIN bbin b USING (model_id, node) LEFT JOIN cb c USING (model_id, node, window_id, bin) GROUP BY t.model_id, t.window_id, t.node"""


@query(_SHIFT)
def shift_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Reference rows shifted by 0, 0.5 and 1 on two features."""
    values = P.unpivot_columns(I.reference(spark, sf), ["model_id", "event_id"], I.FEATURES)
    found = N.shift_sensitivity(
        values.select("model_id", "node", "num", "cat"), I.baseline(spark, sf),
        [0.0, 0.5, 1.0], ["value", "k"], I.CONFIG, p_method="asymptotic",
    )
    numeric = found.filter(F.col("kind") == "continuous")
    return numeric.select("model_id", "window_id", "intensity", "node", r6("psi").alias("psi"))


QUERIES["shift_sensitivity_whole"] = QUERIES["shift_sensitivity"]


@query(I.with_(I.PE) + """, h AS (SELECT *, (CAST('0x' || substr(md5('value:' || event_id || ':u'), 1, 15) AS BIGINT) + 1) / 1152921504606846977.0 AS u,
    CAST('0x' || substr(md5('value:' || event_id || ':v'), 1, 15) AS BIGINT) / 1152921504606846976.0 AS v FROM pe),
  s AS (SELECT model_id, stddev_pop(value) AS sd FROM pe GROUP BY 1)
  SELECT event_id, round(value + 3 * sd + sqrt(-2 * ln(u)) * cos(2 * pi() * v) * 0.05 * sd, 5) AS num FROM h JOIN s USING (model_id)""")
def scale_shift(spark: SparkSession, sf: str) -> DataFrame:
    values = P.unpivot_columns(I.prediction_events(spark, sf), ["model_id", "event_id"], ["value"])
    moved = N.scale_shift(values, 3.0, ["value"], F.col("event_id"))
    return moved.select("event_id", F.round("num", 5).alias("num"))


@query(I.with_(I.ATTR) + "SELECT feature, round(avg(abs(attribution)), 6) AS importance, round(avg(value), 6) AS mean_value FROM att GROUP BY 1")
def attribution_importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.attribution_importance(I.attributions(spark, sf)), "importance", "mean_value")


_TOPK = """tk AS (SELECT *, max(CASE WHEN rank > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY prediction_id) = 1 AS others FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_id, direction ORDER BY abs(attribution) DESC, feature) AS rank FROM (
    SELECT *, CASE WHEN attribution > 0 THEN 'toward_prediction' ELSE 'away_from_prediction' END AS direction,
      max(abs(attribution)) OVER (PARTITION BY prediction_id) AS mx FROM att) WHERE abs(attribution) > mx * 0.05)),
top AS (SELECT prediction_id, feature, upper(substr(feature, 1, 1)) || substr(feature, 2) AS label, direction, rank,
  CASE WHEN abs(attribution) >= mx * 0.66 THEN 'strong' WHEN abs(attribution) >= mx * 0.33 THEN 'moderate' ELSE 'small' END AS strength,
  attribution, others FROM tk WHERE rank <= 3)"""


@query(I.with_(I.ATTR, _TOPK) + "SELECT prediction_id, feature, label, direction, rank, strength, round(attribution, 6) AS attribution, others FROM top")
def attribution_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = rounded(A.attribution_topk(I.attributions(spark, sf)), "attribution")
    return found.withColumn("rank", F.col("rank").cast("bigint"))


_JOINED = """CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2]
  ELSE array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"""


@query(I.with_(I.ATTR, _TOPK) + f""", sd AS (SELECT event_id AS prediction_id, 'Class ' || prediction AS pl,
    coalesce(u, []) AS u, coalesce(d, []) AS d, coalesce(others, false) AS others FROM cur LEFT JOIN (SELECT prediction_id, list(label ORDER BY rank) FILTER (WHERE direction = 'toward_prediction') AS u,
    list(label ORDER BY rank) FILTER (WHERE direction <> 'toward_prediction') AS d, bool_or(others) AS others FROM top GROUP BY 1) t ON t.prediction_id = event_id)
  SELECT prediction_id, 'Outcome: ' || pl || '. ' || CASE WHEN len(u) > 0 THEN 'Leading factors: ' || {_JOINED.format(x='u')} || ', which spoke for ' || pl || '.'
    WHEN len(d) > 0 THEN 'Leading factors: ' || {_JOINED.format(x='d')} || ', which spoke against it.'
    ELSE 'Every feature stays below the reporting limit.' END ||
    CASE WHEN len(u) > 0 AND len(d) > 0 THEN ' ' || {_JOINED.format(x='d')} || ' spoke against it.' ELSE '' END AS summary,
    CASE WHEN others THEN 'Further features matter less.' END AS other_note FROM sd""")
def attribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    labels = I.current(spark, sf).select(
        F.col("event_id").alias("prediction_id"),
        F.concat(F.lit("Class "), F.col("prediction").cast("string")).alias("prediction_label"),
        F.lit("classification").alias("task"),
    )
    return A.attribution_summary(A.attribution_topk(I.attributions(spark, sf)), labels)


@query(I.with_(I.PE) + """SELECT event_id, CASE WHEN hour < 8 THEN printf('%.2f', value) WHEN k < 10 THEN 'prediction' WHEN hour < 16 THEN 'Class ' || prediction
  ELSE CASE WHEN prediction = 1 THEN 'high' ELSE 'low' END END AS label FROM pe""")
def prediction_label(spark: SparkSession, sf: str) -> DataFrame:
    events = I.prediction_events(spark, sf)
    hour = F.col("hour")
    task = F.when(hour < 8, "regression").otherwise("classification")
    known = F.when(F.col("k") >= 10, F.col("prediction"))
    name = F.when(hour < 16, known.cast("string")).otherwise(
        F.when(known == 1, "high").when(known == 0, "low")
    )
    return events.select("event_id", label_of(task, name, known, F.col("value")).alias("label"))
