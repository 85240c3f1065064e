"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / size times. Expected copies are prefix-summed
within the source, one random offset per source is added, and a document is emitted once per
integer boundary its stretch crosses. Documents are walked in order of their size, so copies
spread evenly over short and long ones and the words taken stay near the target.

The prefix sum uses ``dense_index``: a source with a third of all rows is cut into ranges like
any other. The table of sources is one row per source.

Null text has size 0; null sources form one source, last in order; sources without words have
target 0 and give nothing. Repeated rows are separate documents. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.tables import plain
from shoreline.plans.scan import dense_index

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def _unit(text: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from ``text``."""
    digits = F.substring(F.md5(F.concat(text, F.lit(f"#{seed}")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**32)


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``_source, source_size, target``: shares of all words by weight, at most ``most`` times the size.

    The excess of a capped source goes to the others by weight until none is above its cap: the
    common level is found by walking the sources in order of cap / weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    capped = sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    shared = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levelled = capped.withColumn("_own", left / shared)
    open_here = F.when(F.col("_own") <= F.col("_cap") / F.col("_weight"), F.col("_own"))
    level = levelled.withColumn("_level", F.max(open_here).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_weight"))
    return level.select("_source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: tuple[float, ...] = WEIGHTS,
    most: float = MOST_COPIES,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``key, size, source_size, target, copies`` and the columns ``keep``."""
    sized = docs.select(
        docs[key].alias("_key"),
        docs[source].alias("_source"),
        word_count(docs[text]).alias("size"),
        F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")).alias("_shuffled"),
        F.xxhash64(docs[text]).alias("_tie"),  # rows that repeat an id, or have none
        *[docs[k].alias(f"_keep_{k}") for k in keep],
    )
    placed = dense_index(sized.withColumn("_group", F.coalesce("_source", F.lit(""))).withColumn("_null", F.col("_source").isNull()), ["_null", "_group"], ["size", "_shuffled", "_tie"], "_place")
    targets = source_targets(placed.select("_source", "size"), weights=weights, most=most)
    # One row per source; Catalyst and AQE choose the join.
    joined = placed.join(targets.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _unit(F.coalesce("_source", F.lit("")), seed)
    copies = F.floor(start + rate * (F.col("_place") + 1)) - F.floor(start + rate * F.col("_place"))
    return joined.select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        copies.cast("bigint").alias("copies"),
        *[F.col(f"_keep_{k}").alias(k) for k in keep],
    )


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was taken."""
    named, names = plain(docs)
    kept = tuple(n for c, n in names.items() if c != key)
    counted = mix_sources(named, names[key], names[text], names[source], keep=kept, **options)
    repeated = counted.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    source_size * 3.0::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own
  FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN own <= cap / weight THEN own END) OVER (), 0) * weight) AS target
  FROM l),
p AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, h) - 1 AS place FROM d),
j AS (
  SELECT p.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(p.source, '') || '#7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(u + rate * (place + 1)) - floor(u + rate * place)))::BIGINT AS taken
FROM j
"""
