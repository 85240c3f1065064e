"""Reading the given tables and naming helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of about ``BATCH_BYTES``, unless the session names a size.

    A batch is held by the executor and by the worker; 10,000 long texts at once would be 64 MB in each.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def fold(ident: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (null)."""
    return F.crc32(ident.cast("string").cast("binary")) % folds


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by place, so that no name clashes with a result's, and the new names."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
