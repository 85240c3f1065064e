"""Two-sample statistics and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.pvalues import with_ks_pvalue
from shoreline.functions.verdicts import combine_verdict as combine
from shoreline.functions.verdicts import psi_verdict as band
from shoreline.operators import drift as D
from shoreline.operators import profile as P
from shoreline.queries import inputs as I

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__.removesuffix("_query")] = (fn, sql)
        return fn

    return add


def also(name: str, of: str) -> None:
    """An earlier name of a query that covers all reference rows."""
    QUERIES[name] = QUERIES[of]


def r6(c):
    return F.round(c, 6)


KEY = ["model_id", "window_id", "node"]


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return D.baseline_cells(I.window_numbers(I.windowed(spark, sf)), I.baseline(spark, sf))


def _statistic(spark: SparkSession, sf: str) -> DataFrame:
    return D.ks_statistic(_cells(spark, sf), I.baseline(spark, sf).nodes)


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    return D.category_counts(I.window_categories(I.windowed(spark, sf)))


@query(I.with_(I.KS) + "SELECT model_id, window_id, node, current_n, baseline_n, round(statistic, 6) AS statistic FROM ks")
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return _statistic(spark, sf).select(*KEY, "current_n", "baseline_n", r6("statistic").alias("statistic"))


also("ks_statistic_whole", "ks_statistic")


@query(I.with_(I.KS, I.EXACT) + "SELECT model_id, window_id, node, current_n, baseline_n, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value FROM ke")
def ks_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    """Exact p-values."""
    found = with_ks_pvalue(_statistic(spark, sf), "current_n", "baseline_n", "statistic", "exact")
    return found.withColumn("statistic", r6("statistic")).withColumn("p_value", r6("p_value"))


@query(I.with_(I.KS) + f"SELECT model_id, window_id, node, round({I.ASYMPTOTIC}, 6) AS p_value FROM ks")
def ks_pvalue_asymptotic(spark: SparkSession, sf: str) -> DataFrame:
    found = with_ks_pvalue(_statistic(spark, sf), "current_n", "baseline_n", "statistic", "asymptotic")
    return found.select(*KEY, r6("p_value").alias("p_value"))


@query(I.with_(I.KS, I.EXACT) + """SELECT model_id, window_id, node, current_n, baseline_n, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, CAST(0.05 AS DOUBLE) AS threshold,
  CASE WHEN p_value IS NULL THEN 'INSUFFICIENT_DATA' WHEN p_value < 0.05 THEN 'DRIFT' ELSE 'STABLE' END AS verdict FROM ke""")
def ks_test(spark: SparkSession, sf: str) -> DataFrame:
    found = D.ks_test(_statistic(spark, sf), I.CONFIG, p_method="exact")
    return found.withColumn("statistic", r6("statistic")).withColumn("p_value", r6("p_value"))


@query(I.with_(I.PSI_BINS) + f"""SELECT model_id, window_id, node, CAST(bin AS BIGINT) AS bin,
  '[' || printf('%.4g', low) || ', ' || printf('%.4g', high) || ')' AS label,
  round(baseline_prop, 6) AS baseline_prop, round(current_prop, 6) AS current_prop,
  round({I.term('current_prop', 'baseline_prop')}, 6) AS contribution
  FROM pbin WHERE least(current_n, baseline_n) >= 30""")
def psi_bins_continuous(spark: SparkSession, sf: str) -> DataFrame:
    bins = D.psi_bins_continuous(_cells(spark, sf), I.baseline(spark, sf).nodes, I.CONFIG)
    return bins.select(
        *KEY, F.col("bin").cast("bigint").alias("bin"), "label",
        *[r6(c).alias(c) for c in ("baseline_prop", "current_prop", "contribution")],
    )


@query(I.with_(I.PSI_BINS) + """SELECT model_id, window_id, node, current_n, baseline_n, CAST(n_bins AS BIGINT) AS n_bins, round(psi, 6) AS psi,
  CASE WHEN psi IS NULL THEN 'INSUFFICIENT_DATA' WHEN psi >= 0.2 THEN 'DRIFT' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS verdict FROM psi_num""")
def psi_continuous(spark: SparkSession, sf: str) -> DataFrame:
    found = D.psi_continuous(_cells(spark, sf), I.baseline(spark, sf).nodes, I.CONFIG)
    return found.withColumn("psi", r6("psi")).withColumn("n_bins", F.col("n_bins").cast("bigint"))


also("psi_continuous_whole", "psi_continuous")


@query(I.with_(I.VALUES, I.PSI_CAT) + """SELECT model_id, window_id, node, current_n, baseline_n, round(psi, 6) AS psi FROM psi_cat""")
def psi_categorical(spark: SparkSession, sf: str) -> DataFrame:
    base = I.baseline(spark, sf)
    found = D.psi_categorical(_categories(spark, sf), base.categories, I.CONFIG)
    return found.withColumn("psi", r6("psi"))


@query(I.with_(I.VALUES, I.PSI_CAT) + f"""SELECT model_id, window_id, node, category AS label, round(baseline_prop, 6) AS baseline_prop,
  round(current_prop, 6) AS current_prop, round({I.term('current_prop', 'baseline_prop')}, 6) AS contribution FROM cprop""")
def psi_bins_categorical(spark: SparkSession, sf: str) -> DataFrame:
    base = I.baseline(spark, sf)
    bins = D.psi_bins_categorical(_categories(spark, sf), base.categories)
    return bins.select(
        *KEY, "label", *[r6(c).alias(c) for c in ("baseline_prop", "current_prop", "contribution")]
    )


@query(I.with_(I.PE) + """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN psi IS NULL THEN 'INSUFFICIENT_DATA' WHEN psi >= 0.2 THEN 'DRIFT'
  WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS verdict FROM (SELECT CASE WHEN k >= 5 THEN value / 500 END AS psi FROM pe)) GROUP BY 1""")
def psi_verdict(spark: SparkSession, sf: str) -> DataFrame:
    events = I.prediction_events(spark, sf)
    psi = F.when(F.col("k") >= 5, F.col("value") / 500)
    return events.groupBy(band(psi, 0.1, 0.2).alias("verdict")).agg(F.count("*").alias("n"))


@query(I.with_(I.PE) + """SELECT ks, psi, CASE WHEN coalesce(ks, 'INSUFFICIENT_DATA') = 'INSUFFICIENT_DATA' AND coalesce(psi, 'INSUFFICIENT_DATA') = 'INSUFFICIENT_DATA' THEN 'INSUFFICIENT_DATA'
    WHEN psi = 'DRIFT' THEN 'DRIFT' WHEN ks = 'DRIFT' AND psi = 'WARNING' THEN 'DRIFT' WHEN psi = 'WARNING' THEN 'WARNING'
    WHEN ks = 'DRIFT' THEN 'WARNING' ELSE 'STABLE' END AS verdict, count(*) AS n
  FROM (SELECT CASE WHEN hour < 6 THEN 'DRIFT' WHEN hour < 12 THEN 'STABLE' WHEN hour < 18 THEN 'INSUFFICIENT_DATA' END AS ks,
    CASE WHEN k < 20 THEN 'DRIFT' WHEN k < 40 THEN 'WARNING' WHEN k < 60 THEN 'STABLE' WHEN k < 80 THEN 'INSUFFICIENT_DATA' END AS psi FROM pe)
  GROUP BY 1, 2, 3""")
def combine_verdict_query(spark: SparkSession, sf: str) -> DataFrame:
    hour, k = F.col("hour"), F.col("k")
    ks = F.when(hour < 6, "DRIFT").when(hour < 12, "STABLE").when(hour < 18, "INSUFFICIENT_DATA")
    psi = (
        F.when(k < 20, "DRIFT").when(k < 40, "WARNING").when(k < 60, "STABLE")
        .when(k < 80, "INSUFFICIENT_DATA")
    )
    pairs = I.prediction_events(spark, sf).select(ks.alias("ks"), psi.alias("psi"))
    return pairs.groupBy("ks", "psi", combine("ks", "psi").alias("verdict")).agg(
        F.count("*").alias("n")
    )


_ND_COLUMNS = """model_id, window_id, node, kind, current_n, baseline_n, round(statistic, 6) AS statistic,
  round(p_value, 6) AS p_value, round(psi, 6) AS psi, ks_verdict, psi_verdict, verdict"""


def _rounded(found: DataFrame) -> DataFrame:
    for c in ("statistic", "p_value", "psi"):
        found = found.withColumn(c, r6(c))
    return found


@query(I.with_(I.ND) + f"SELECT {_ND_COLUMNS} FROM nd")
def detect_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(I.run_detection(spark, sf))


also("detect_drift_whole", "detect_drift")


@query(I.with_(I.ND_EXACT) + f"SELECT {_ND_COLUMNS} FROM nd")
def detect_drift_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same with exact p-values at any size."""
    return _rounded(I.run_detection(spark, sf, "exact"))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
_LI_CUT = "1998-06-01"


def _union(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT rk, '{c}' AS node, {f'CAST(NULL AS DOUBLE) AS num, {c} AS cat' if c == 'l_returnflag' else f'{c} AS num, CAST(NULL AS VARCHAR) AS cat'} FROM {source}"
        for c in _LI
    )


_FRAME_SQL = f"""li AS (SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate,
    CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_extendedprice AS rk FROM lineitem),
lref AS ({_union("(SELECT * FROM li WHERE l_shipdate < TIMESTAMP '1998-06-01')")}),
lcur AS ({_union("(SELECT * FROM li WHERE l_shipdate >= TIMESTAMP '1998-06-01')")}),
bval AS (SELECT node, num AS value FROM lref WHERE num IS NOT NULL),
edges AS (SELECT node, baseline_n, {I.QUANTILES} AS raw FROM (SELECT node, count(*) AS baseline_n, list_sort(list(value)) AS arr FROM bval GROUP BY node)),
bins AS (SELECT node, baseline_n, raw[2:len(raw) - 1] AS inn, len(raw) - 1 AS n_bins FROM edges),
grid AS (SELECT *, unnest(range(0, n_bins)) AS bin FROM bins),
bp AS (SELECT node, len(list_filter(inn, lambda x: x <= value)) AS bin, count(*) AS n FROM bval JOIN bins USING (node) GROUP BY ALL),
cpn AS (SELECT node, len(list_filter(inn, lambda x: x <= num)) AS bin, count(*) AS n FROM lcur JOIN bins USING (node) WHERE num IS NOT NULL GROUP BY ALL),
tot AS (SELECT node, count(num) AS nn, count(cat) AS nc FROM lcur GROUP BY node),
pn AS (SELECT g.node, sum({I.term('coalesce(c.n, 0) / t.nn', 'coalesce(b.n, 0) / g.baseline_n')}) AS psi
  FROM grid g JOIN tot t USING (node) LEFT JOIN bp b USING (node, bin) LEFT JOIN cpn c USING (node, bin) GROUP BY g.node),
pc AS (SELECT node, sum({I.term('coalesce(c.p, 0)', 'coalesce(b.p, 0)')}) AS psi FROM
  (SELECT node, cat, count(*) / (SELECT nc FROM tot WHERE node = 'l_returnflag') AS p FROM lcur WHERE cat IS NOT NULL GROUP BY ALL) c
  FULL JOIN (SELECT node, cat, count(*) / (SELECT count(*) FROM lref WHERE cat IS NOT NULL) AS p FROM lref WHERE cat IS NOT NULL GROUP BY ALL) b
  USING (node, cat) GROUP BY node),
st AS (SELECT node, value, sum(c) AS c, sum(b) AS b FROM (SELECT node, num AS value, 1 AS c, 0 AS b FROM lcur WHERE num IS NOT NULL
  UNION ALL SELECT node, value, 0, 1 FROM bval) GROUP BY ALL),
ec AS (SELECT node, sum(c) OVER w AS cc, sum(b) OVER w AS cb, sum(c) OVER g AS tc, sum(b) OVER g AS tb FROM st
  WINDOW g AS (PARTITION BY node), w AS (PARTITION BY node ORDER BY value ROWS UNBOUNDED PRECEDING)),
kk AS (SELECT node, max(abs(cc / tc - cb / tb)) AS statistic, max(tc) AS current_n, max(tb) AS baseline_n FROM ec GROUP BY node)"""


@query(I.with_(_FRAME_SQL) + """SELECT node, CAST(current_n AS BIGINT) AS current_n, CAST(baseline_n AS BIGINT) AS baseline_n, round(statistic, 6) AS statistic, round(psi, 6) AS psi
    FROM kk JOIN pn USING (node)
  UNION ALL SELECT node, (SELECT nc FROM tot WHERE node = 'l_returnflag'), (SELECT count(*) FROM lref WHERE cat IS NOT NULL), NULL, round(psi, 6) FROM pc""")
def drift_from_frame(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem shipped from June 1998 on, as one batch, against what was shipped before."""
    key = F.concat_ws(
        "/", *[F.col(c).cast("string") for c in
               ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    )
    lines = I.table(spark, sf, "lineitem").withColumn("model_id", F.lit("m")).withColumn("rk", key)
    cut = F.to_timestamp_ntz(F.lit(f"{_LI_CUT} 00:00:00"))
    base = P.build_baseline(lines.filter(F.col("l_shipdate") < cut), _LI, F.col("rk"), I.CONFIG)
    batch = lines.filter(F.col("l_shipdate") >= cut)
    found = D.drift_from_frame(batch, _LI, base, I.CONFIG, p_method="asymptotic")
    return found.select(
        "node", "current_n", "baseline_n", r6("statistic").alias("statistic"), r6("psi").alias("psi")
    )


also("drift_from_frame_whole", "drift_from_frame")


@query(I.with_(I.ND) + """SELECT model_id, window_id, string_agg(node, ',' ORDER BY pos) AS nodes FROM nd
  JOIN (VALUES ('value', 0), ('k', 1), ('hour', 2), ('load', 3), ('score', 4), ('weekday', 5), ('prediction', 6)) AS p(node, pos) USING (node)
  WHERE verdict = 'DRIFT' GROUP BY 1, 2""")
def drifted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    names = ", ".join(f"('{n}', {i})" for i, n in enumerate([*I.FEATURES, "prediction"]))
    positions = spark.sql(f"SELECT * FROM VALUES {names} AS p(node, pos)")
    found = D.drifted_nodes(I.node_drift(spark, sf), positions)
    return found.select("model_id", "window_id", F.array_join("drifted_nodes", ",").alias("nodes"))


@query(I.with_(I.ND) + f"SELECT {_ND_COLUMNS.replace('node,', chr(39) + 'prediction' + chr(39) + ' AS node,', 1)} FROM nd WHERE node = 'score'")
def output_drift_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """The score as the output of a regressor: one continuous output node beside the features."""
    as_output = lambda df, ids: P.output_node_values(
        df.select(*ids, "prediction", F.col("score").alias("output")), ids, F.lit(False)
    )
    ref = I.reference(spark, sf).select("model_id", "event_id", "value", "prediction", F.col("score").alias("output"))
    base = P.build_baseline(ref, ["value"], F.col("event_id"), I.CONFIG, output_values=P.output_baseline_values(ref))
    events, ids = I.windowed(spark, sf), ["model_id", "window_id"]
    numbers = P.collect_batch_features(events, ids, ["value"]).unionByName(
        as_output(events, ids).select(*ids, "node", F.col("num").alias("value"))
    )
    none = P.collect_batch_categories(events, ids, [])
    found = D.detect_drift(numbers, none, events.select(*ids).distinct(), base, I.CONFIG, p_method="asymptotic")
    return _rounded(found.filter(F.col("node") == "prediction"))
