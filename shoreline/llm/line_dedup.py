r"""Line deduplication over levelled sorted runs.

``LineRuns`` holds the keys of all lines seen so far as sorted runs. A new batch is anti-joined
with the runs by sort-merge joins; keys the runs don't hold are new, and are added as a run of
level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so a
key is rewritten once per level and only (fanout - 1) x levels runs are ever joined.

A line's key is the line stripped of ``[\x20\x09-\x0D]`` at both ends with A-Z lower-cased; keys
below ``least`` code points are never dropped. Keys are stored as their 16-byte md5. A key stays
in the smallest document of the first batch that holds it, with all its lines there, and loses its
lines everywhere else. ``dedup_lines`` cuts a whole table into batches by ascending id, so there
the smallest id of all holds the key.

Null and empty text are one empty line. Null ids count as one document after all others; rows
that repeat an id are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.tables import ascii_lower
from shoreline.plans.materialize import shared_dir, stored

BLANKS = " \t\n\x0b\x0c\r"
_LAST = 2**63 - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, least: int) -> Column:
    """md5 of the normalised line, null for short ones."""
    cleaned = F.btrim(ascii_lower(line), F.lit(BLANKS))
    return F.when(F.length(cleaned) >= least, F.unhex(F.md5(cleaned.cast("binary"))))


class LineRuns:
    """Keys of the lines of all batches so far: ``_key`` sorted, in runs by level."""

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None):
        self.spark = spark
        self.fanout = fanout
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, keys: DataFrame) -> str:
        self._made += 1
        path = f"{self.folder}/run-{self._made:06d}"
        keys.sortWithinPartitions("_key").write.parquet(path)
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema("_key binary").parquet(path)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (column ``_key``) that no run holds; full levels are merged first."""
        self._compact()
        for level in self.levels:
            for path in level:
                keys = keys.join(self.read(path).hint("merge"), "_key", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add new keys as a run."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(keys.select("_key")))

    def _compact(self) -> None:
        """Merge full levels upwards. Done before runs are read, so no merged run is left unread."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = self.read(self.levels[level][0])
            for path in self.levels[level][1:]:
                merged = merged.unionByName(self.read(path))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged.repartition("_key")))
            self.levels[level] = []
            level += 1


def losing_keys(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """``_key, _doc``: which key each document of a batch loses; the batch's new keys join the runs.

    ``lines`` has one row per document and key. A key is settled by its smallest document, which
    is found by a map-side combined aggregation, so a line in every document is no hot key there;
    the join back is a plain equi-join that adaptive execution splits.
    """
    holders = stored(lines.groupBy("_key").agg(F.min("_doc").alias("_holder"), F.max("_doc").alias("_other")), "line-holders")
    new = stored(runs.unseen(holders), "line-new")
    runs.add(new)
    seen = holders.join(new.select("_key"), "_key", "left_anti").select("_key", F.lit(None).cast("bigint").alias("_holder"))
    shared = new.where("_holder <> _other").select("_key", "_holder").unionByName(seen)
    return lines.join(stored(shared, "line-shared"), "_key").where("_holder IS NULL OR _holder <> _doc").select("_key", "_doc")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = 10, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """``docs``' key with ``n_lines, n_dropped`` and the text that stays (``kept``)."""
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, fanout)
    named = docs.select(docs[key].alias("_id"), F.coalesce(docs[key].cast("bigint"), F.lit(_LAST)).alias("_doc"), docs[text].alias("_text"))
    keyed = F.array_distinct(F.filter(F.transform(split_lines(F.col("_text")), lambda line: line_key(line, least)), lambda k: k.isNotNull()))
    at = [i / batches for i in range(1, batches)]
    cuts = named.agg(F.percentile_approx("_doc", at, 1000).alias("c")).first()["c"] or [] if at else []
    batch = sum([F.when(F.col("_doc") > c, 1).otherwise(0) for c in cuts], F.lit(0))
    lines = stored(named.select("_doc", F.explode(keyed).alias("_key")).withColumn("_batch", batch), "line-keys")
    lost = [losing_keys(lines.where(F.col("_batch") == b).select("_key", "_doc"), runs) for b in range(len(cuts) + 1)]
    every = lost[0]
    for more in lost[1:]:
        every = every.unionByName(more)
    # Bounded by the lines of a document.
    drops = every.groupBy("_doc").agg(F.collect_set("_key").alias("_lost"))
    joined = named.join(drops, "_doc", "left").withColumn("_lines", split_lines(F.col("_text")))
    kept = F.filter("_lines", lambda line: ~F.coalesce(F.array_contains("_lost", line_key(line, least)), F.lit(False)))
    done = joined.withColumn("_kept", F.when(F.col("_lost").isNull(), F.col("_lines")).otherwise(kept))
    return done.select(
        F.col("_id").alias(key),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(list_zip(x, range(len(x)))) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT doc_id, z[1] AS line, z[2] AS n,
    translate(trim(z[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
