"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm import decontamination, divergence, embedding_dedup, katz, language_id, line_dedup, minhash, mixing, packing, spelling, token_records, toxicity, url_filter
from shoreline.llm.tables import fold, table
from shoreline.plans.materialize import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(~toxicity.held_out()), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def token_table(docs: DataFrame) -> DataFrame:
    """Write all of ``docs`` as token records and read them back: one row per document."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    index = token_records.write_records(docs, folder, TOKENIZER)
    records = token_records.starts(token_records.read_records(index, folder, ids=False), index)
    return records.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(True))
    model = katz.fit(docs.where(~held_out))
    scored = katz.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.predict(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), BYTE_TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


REGISTERED = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_token_records": (op2_token_records, None),
    "op3_katz": (op3_katz, None),
    "op4_url_filter": (op4_url_filter, url_filter.ORACLE),
    "op5_mixing": (op5_mixing, mixing.ORACLE),
    "op6_decontamination": (op6_decontamination, decontamination.ORACLE),
    "op7_line_dedup": (op7_line_dedup, line_dedup.ORACLE),
    "op8_minhash": (op8_minhash, None),
    "op9_embedding_dedup": (op9_embedding_dedup, embedding_dedup.ORACLE),
    "op10_language_id": (op10_language_id, None),
    "op11_spelling": (op11_spelling, spelling.ORACLE),
    "op12_packing": (op12_packing, None),
    "op13_divergence": (op13_divergence, divergence.ORACLE),
}
