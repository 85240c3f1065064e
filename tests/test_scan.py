import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shoreline.plans.scan import CHUNK, dense_index, range_chunks, running


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = np.random.default_rng(3)
    n = 4000
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    return spark.createDataFrame(
        pd.DataFrame({"k": keys, "t": rng.integers(0, 500, n), "i": np.arange(n), "x": rng.integers(-5, 6, n)})
    ).repartition(7)


def test_dense_index_equals_row_number(skewed):
    got = dense_index(skewed, ["k"], ["t", "i"], "n")
    want = skewed.withColumn(
        "n", (F.row_number().over(Window.partitionBy("k").orderBy("t", "i")) - 1).cast("bigint")
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_dense_index_without_group(skewed):
    got = dense_index(skewed, [], ["t", "i"], "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (0, 3999, 4000)


def test_hot_key_is_spread_over_chunks(spark):
    wide = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = range_chunks(wide.repartition(8), ["k"], ["i"])
        sizes = [r["count"] for r in chunks.groupBy(CHUNK).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 100_000


def test_running_equals_windows(skewed):
    chunked = skewed.withColumn("c", F.expr("t div 50"))
    got = running(
        chunked, ["k"], "c", ["t", "i"],
        sums={"s": F.col("x")},
        maxima={"m": F.when(F.col("x") > 3, F.col("i"))},
        maxima_before={"b": F.when(F.col("x") > 3, F.col("i"))},
    )
    w = Window.partitionBy("k").orderBy("t", "i")
    peak = F.when(F.col("x") > 3, F.col("i"))
    want = chunked.select(
        "*",
        F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max(peak).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"),
        F.max(peak).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
