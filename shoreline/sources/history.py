"""Stored window results: an appended history and current tables.

Every micro-batch writes its own folder, so a repeated batch replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_window_history(results: DataFrame, path: str, batch_id: int) -> None:
    """Add the window records of one batch to the history."""
    write_batch(results, f"{path}/windows", batch_id)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All window records; readers filter on model_id."""
    return spark.read.parquet(f"{path}/windows")


def write_batch(table: DataFrame, path: str, batch_id: int) -> None:
    table.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches under ``path``."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    done = []
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("batch_id=") and fs.exists(
            jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        ):
            done.append(int(name.split("=", 1)[1]))
    return sorted(done)


def read_before(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """The newest table written before ``batch_id`` (or the newest at all)."""
    batches = [b for b in written_batches(spark, path) if batch_id is None or b < batch_id]
    return spark.read.parquet(f"{path}/batch_id={batches[-1]}") if batches else None


def current_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Current status or incidents: the newest batch's table."""
    return read_before(spark, f"{path}/{name}")


def latest_window(history: DataFrame) -> DataFrame:
    """Newest record per model."""
    fields = F.struct(*[c for c in history.columns if c != "model_id"])
    return history.groupBy("model_id").agg(F.max_by(fields, "window_id").alias("r")).select(
        "model_id", "r.*"
    )
