"""Stored intermediate tables.

Two-pass operators (rank, then offset) and iterative ones need an intermediate result that
does not change when a task is re-run on another executor. It is written to the shared
folder the session names in ``spark.checkpoint.dir``; nothing is kept on one machine only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shoreline-"))
        current = context.getCheckpointDir()
    return current


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back; later reads prune columns and know the size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the small tables of an iterative loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
