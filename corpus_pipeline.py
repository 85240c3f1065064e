"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token records.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a
DataFrame; all but the last return the columns of ``docs``. Null ids, null and empty texts, repeated rows and
extra columns follow the rules of the stage's operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shoreline.llm import decontamination, language_id, minhash, mixing
from shoreline.llm.queries import token_table
from shoreline.llm.tables import plain, table
from shoreline.plans.materialize import shared_dir

LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays unsure (below ``LEAST_SCORE``)."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    named, names = plain(docs)
    found = language_id.predict(named, model, names["text"], keep=tuple(names.values()))
    kept = found.where((found["lang_pred"] != language_id.UNDETERMINED) & (found["score"] >= LEAST_SCORE))
    return kept.select(*[kept[n].alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights of the sources ask for."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all documents as token records; one row per record, read back."""
    return token_table(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token records", write_tokens),
]

#: Neither language ID, the candidates of near-dedup nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
