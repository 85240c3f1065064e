import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoreline.functions.labels import number_label
from shoreline.operators import attribution as A
from shoreline.operators import evaluation as V
from shoreline.operators import quality as Q


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"a": 1, "Email": "x"}, ["email"]),
        ({"a": {"b": [{"ssn": 1}, {"c": {"Phone": 2}}]}}, ["phone", "ssn"]),
        ({"a": "email", "b": ["ssn", "\"name\": 1", "x\\"]}, []),
        ({"t": "say \"name\":", "u": ",", "v": ":"}, []),
        ({}, []),
    ],
)
def test_field_names_at_any_depth(spark, payload, want):
    df = spark.createDataFrame([(json.dumps(payload),)], "body string")
    assert Q.pii_key_scan(df, "body").first().violations == want


def test_escaped_and_long_texts(spark):
    body = '{"\\u0073sn" : 1, "long": "' + 'x\\"y' * 50_000 + '"}'
    df = spark.createDataFrame([(body,)], "body string")
    assert Q.pii_key_scan(df, "body").first().violations == ["ssn"]


def test_schema_keys(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('Email', 'x', 'm', map('k', named_struct('SSN', 1)))) AS a")
    assert {"email", "ssn"} <= set(Q.schema_keys(df.schema))


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(500).select("id", (F.col("id") / 7).alias("x"), F.col("id").cast("string").alias("s"))
    one = Q.dataset_fingerprint(df, df.columns).first()
    two = Q.dataset_fingerprint(df.repartition(9).orderBy(F.desc("id")), df.columns).first()
    other = Q.dataset_fingerprint(df.withColumn("s", F.when(F.col("id") == 3, "!").otherwise(F.col("s"))), df.columns).first()
    assert one == two and one != other


def test_contract(spark):
    a, b = spark.range(3), spark.range(2).withColumn("y", F.lit(1))
    assert {r.status for r in Q.dataset_contract({"r": a, "s": a}, ["r", "s"]).collect()} == {"pass"}
    assert {r.status for r in Q.dataset_contract({"r": a, "s": b}, ["r", "s"]).collect()} == {"fail"}
    missing = Q.dataset_contract({"r": a}, ["r", "s"]).first()
    assert missing.status == "fail" and "s" in missing.reason


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert V.roc_auc(df).first().roc_auc == pytest.approx(auc)
    area, tp, fp = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        hits = ((p == s) & (y == 1)).sum()
        tp, fp = tp + hits, fp + ((p == s) & (y == 0)).sum()
        area += hits / len(pos) * tp / (tp + fp)
    assert V.average_precision(df).first().average_precision == pytest.approx(area)


def test_degenerate_metrics(spark):
    none = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    m = V.binary_metrics(none).first()
    assert (m.accuracy, m.precision, m.recall, m.f1) == (1.0, 0.0, 0.0, 0.0)
    assert V.roc_auc(none).first().roc_auc is None
    one = V.fairness_gaps(V.fairness_rates(none.withColumn("g", F.lit("a")))).first()
    assert tuple(one) == (0.0, 0.0, 0.0)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, yhat double")
    assert V.regression_metrics(flat).first().r2 == 1.0


def test_number_labels(spark):
    values = [0.0, 1.0, 2.5, -3.0, 1e20, 12345678.5, 0.00025, 1e-7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(number_label(F.col("x"))).collect()]
    assert got[:7] == ["0", "1", "2.5", "-3", "100000000000000000000", "12345678.5", "0.00025"]


def test_attribution_text(spark):
    rows = [(1, "big_one", 1.0, 1.0), (1, "two", 1.0, 0.5), (1, "tiny", 1.0, 0.01), (1, "down", 1.0, -0.4),
            (2, "flat", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "prediction_id bigint, feature string, value double, attribution double")
    labels = spark.createDataFrame(
        [(1, "Class 1", "classification"), (2, "7.00", "regression")],
        "prediction_id bigint, prediction_label string, task string",
    )
    top = A.attribution_topk(df)
    assert {(r.feature, r.strength) for r in top.collect()} == {("big_one", "strong"), ("two", "moderate"), ("down", "moderate")}
    text = {r.prediction_id: r for r in A.attribution_summary(top, labels).collect()}
    assert text[1].summary == (
        "Outcome: Class 1. Leading factors: Big one and Two, which spoke for Class 1. Down spoke against it."
    )
    assert text[2].summary == "Value: 7.00. Every feature stays below the reporting limit."
    assert text[1].other_note is None


def test_fingerprint_sees_every_digit(spark):
    version = lambda values, kind="double": Q.dataset_fingerprint(
        spark.createDataFrame([(v,) for v in values], f"x {kind}"), ["x"]
    ).first().dataset_version
    assert version([1e-7, 2e-7]) != version([3e-7, 4e-7])
    assert version([1e33]) != version([1e33 * (1 + 1e-15)])
    assert version([None], "string") != version(["<null>"], "string") != version(["-"], "string")
    pair = spark.createDataFrame([("a=1:b", "c"), ("a", "1:bc")], "x string, y string")
    assert Q.dataset_fingerprint(pair.limit(1), pair.columns).first() != Q.dataset_fingerprint(pair.offset(1), pair.columns).first()


def test_rows_without_label_or_score_are_left_out(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 0.9, "a"), (None, 0.2, "a"), (0, 0.1, "a")], "y int, p double, g string")
    found = V.binary_metrics(df).first()
    assert (found.n, found.accuracy, found.recall) == (2, 1.0, 1.0)
    assert V.roc_auc(df).first().roc_auc == 1.0 and V.average_precision(df).first().average_precision == 1.0
    assert V.fairness_rates(df).first().selection_rate == 0.5
