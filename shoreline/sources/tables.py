"""Bounded tables and stored baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shoreline.operators.profile import Baseline


def scan_reference(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """Reference rows from a file; no columns or no rows is an error.

    CSV without a schema is inferred, which costs one more pass over the file.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    frame = reader.load(path)
    if not frame.columns or frame.isEmpty():
        raise ValueError(f"the reference data is empty: {path}")
    return frame


def store_baseline(baseline: Baseline, path: str, model_version: str) -> None:
    """Write the baseline tables of one model version, replacing that version only."""
    for name in ("nodes", "values", "categories"):
        table = getattr(baseline, name)
        table.write.mode("overwrite").parquet(f"{path}/{name}/model_version={model_version}")


def load_baseline(spark: SparkSession, path: str, model_version: str | None = None) -> Baseline:
    """Read stored baselines; a version reads only its own files. Versions are texts: "007" stays so."""

    def read(name: str) -> DataFrame:
        found = spark.read.parquet(f"{path}/{name}").schema
        typed = [StructField(f.name, StringType()) if f.name == "model_version" else f for f in found]
        table = spark.read.schema(StructType(typed)).parquet(f"{path}/{name}")
        if model_version is not None:
            table = table.filter(F.col("model_version") == model_version)
        return table

    return Baseline(read("nodes"), read("values"), read("categories"))
