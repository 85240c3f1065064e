"""Source divergence audit: how far the sources of a language differ in the words they use.

One CountVectorizer with the least document frequency as ``minDF`` and the largest integer as ``vocabSize``
serves all languages at once: every term carries its document's language, so each language has its own
vocabulary and its own document frequencies, as with one vectorizer a language but in one pass. Its sparse
document vectors are summed by (language, source), index by index with map-side sums, so a hot
source is no hot key and no dense vector of the vocabulary is held. Those sums give exact shares
``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` in decimal and integer arithmetic.

Pairs of sources are compared in blocks of the vocabulary: a block receives the non-zero shares only and
the share of absent terms per source, adds up ``abs(p - q)`` for its terms and returns one partial sum per pair.
Like the vectorizer itself, the vocabulary (terms with ``min_df`` documents at least) is held by the driver and
every executor; nothing else is.

Null text, language and source count as empty strings; a group without terms takes part with the
shares of absent terms. Texts of a language without kept terms differ by 0. Repeated rows count as often as they
occur. Equal values rank by item in UTF-8 order. An empty table gives no rows. Other columns are
ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.tables import bounded_batches
from shoreline.llm.text import slices
from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

MIN_DF = 30
TOP = 50
HELD = 1 << 20  # sums that a task holds before it passes them on
BLOCK_CELLS = 1 << 20  # terms x sources of a block at most
_ALL = 2**31 - 1
_GAP = "\x00"  # never part of a term
_TERM = np.zeros(256, dtype=bool)  # bytes of terms: letters and all signs beyond ASCII
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; null without kept terms."""
    above = F.lit(10**9).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)")
    below = (total + 5 * kept).cast("decimal(20,0)")
    whole = F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)")))
    return (whole + 1).cast("bigint")


def _keyed_terms(column: pa.Array, langs: list[bytes]) -> pa.Array:
    """The terms of every text, each after its language and a gap; the empty term ends every list.

    Works on the bytes of many texts at once: term bytes and language bytes are scattered into one
    buffer, in which the offsets of the terms follow from their lengths.
    """
    sizes, lengths, buffers = [], [], []
    for low, high, data, offsets in slices(column):
        inside = _TERM[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        begins = inside & ~before
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(high - low), np.diff(first))
        places = np.flatnonzero(inside)
        term = np.cumsum(begins[places]) - 1
        own = np.bincount(term, minlength=len(starts))
        heads = [lang + _GAP.encode() for lang in langs[low:high]]
        ahead = np.fromiter(map(len, heads), np.int64, len(heads))[doc]
        total = own + ahead
        at = np.cumsum(total) - total
        out = np.zeros(int(total.sum()), dtype=np.uint8)
        out[(at + ahead - starts)[term] + places] = _LOWER[data[places]]
        signs = np.frombuffer(b"".join(heads), np.uint8)
        begin = np.cumsum([0, *map(len, heads)])[:-1][doc]
        for k in range(max(map(len, heads), default=0)):
            has = ahead > k
            out[at[has] + k] = signs[begin[has] + k]
        sizes.append(np.diff(first) + 1)
        lengths.append(np.insert(total, first[1:], 0))
        buffers.append(out)
    count = lambda parts, kind: np.concatenate([np.zeros(1, kind), np.cumsum(np.concatenate([*parts, np.zeros(0, np.int64)]))]).astype(kind)
    ends = count(lengths, np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(buffers))])
    return pa.ListArray.from_arrays(pa.array(count(sizes, np.int32)), values.cast(pa.string()))


def term_bags(docs: DataFrame) -> DataFrame:
    """``lang, source, _terms`` of every document."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [lang.encode() for lang in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _keyed_terms(batch.column(2), langs)], names=["lang", "source", "_terms"])

    return docs.select("lang", "source", "text").mapInArrow(cut, "lang string, source string, _terms array<string>")


def group_sums(vectors: DataFrame, size: int) -> DataFrame:
    """``lang, source, index, count``: sums of the sparse vectors of a group, partly added up in every task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def held() -> pa.RecordBatch:
            names, group = list(groups), keys // size
            columns = [pa.array([g[i] for g in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(keys % size, pa.int32()), pa.array(sums)], names=["lang", "source", "index", "count"])

        for batch in batches:
            named = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            own = np.fromiter((groups.setdefault(g, len(groups)) for g in named), np.int64, batch.num_rows)
            index, value = batch.column(2), batch.column(3)
            lengths = index.value_lengths().to_numpy()
            new = np.repeat(own, lengths) * size + index.flatten().to_numpy()
            every, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, value.flatten().to_numpy()]), minlength=len(every)).astype(np.int64)
            keys = every
            if len(keys) > HELD:
                yield held()
                groups, keys, sums = {}, keys[:0], sums[:0]
        yield held()

    parts = F.unwrap_udt("_vector")
    rows = vectors.select("lang", "source", parts["indices"].alias("i"), parts["values"].alias("n"))
    summed = rows.mapInArrow(add, "lang string, source string, index int, count bigint")
    return summed.groupBy("lang", "source", "index").agg(F.sum("count").alias("count"))


def term_counts(docs: DataFrame, *, min_df: int = MIN_DF) -> tuple[DataFrame, DataFrame]:
    """``lang, source, index, count`` of every kept term that occurs in a group, and ``index, lang, term``."""
    spark, bags = docs.sparkSession, term_bags(docs)
    if docs.count() < min_df:
        return spark.createDataFrame([], "lang string, source string, index int, count bigint"), spark.createDataFrame([], "index int, lang string, term string")
    # The empty term is in every document, so the vocabulary is never empty; it is left out again below.
    model = CountVectorizer(inputCol="_terms", outputCol="_vector", minDF=float(min_df), vocabSize=_ALL).fit(bags)
    names = pd.DataFrame({"_word": model.vocabulary})
    names["index"] = np.arange(len(names), dtype=np.int32)
    at = F.length("_word") - F.locate(_GAP, F.reverse("_word")) + 1  # the last gap
    vocabulary = spark.createDataFrame(names, "_word string, index int").where("_word <> ''")
    vocabulary = stored(vocabulary.select("index", F.substr("_word", F.lit(1), at - 1).alias("lang"), F.substr("_word", at + 1).alias("term")), "vocabulary")
    empty = int(names.index[names["_word"] == ""][0])
    summed = group_sums(model.transform(bags), len(names))
    return stored(summed.where(F.col("index") != empty), "cells"), vocabulary


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of absolute differences over the terms of a block, for every pair of sources."""
    lang, block = key
    heads = rows[rows["index"].isna()].sort_values("source")
    held = rows[rows["index"].notna()]
    sources, n = heads["source"].to_numpy(), len(heads)
    found = {"lang": [], "a": [], "b": [], "value": []}
    if len(held) or block == 0:
        terms, column = np.unique(held["index"].to_numpy(dtype=np.int64), return_inverse=True)
        shares = np.repeat(heads["p"].fillna(0).to_numpy(dtype=np.int64)[:, None], len(terms), axis=1)
        row = pd.Index(sources).get_indexer(held["source"])
        shares[row, column] = held["p"].to_numpy(dtype=np.int64)
        for i in range(n - 1):
            found["a"] += [sources[i]] * (n - 1 - i)
            found["b"] += sources[i + 1 :].tolist()
            found["value"] += np.abs(shares[i + 1 :] - shares[i]).sum(axis=1).tolist()
        found["lang"] = [lang] * len(found["a"])
    return pd.DataFrame(found, dtype=object).astype({"value": "int64"})


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source by distance, and the ``top`` typical terms."""
    filled = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    cells, vocabulary = term_counts(filled, min_df=min_df)
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("_kept"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("_total"))
    groups = filled.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = stored(groups.select("lang", "source", F.coalesce("_kept", F.lit(0)).alias("_kept"), F.coalesce("_total", F.lit(0)).alias("_total")), "groups")
    shares = cells.join(broadcast_if_small(groups), ["lang", "source"]).select("lang", "source", "index", _share(F.col("count"), F.col("_total"), F.col("_kept")).alias("p"), "count")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    # Pairs: blocks of terms, each with a row per source for the terms it lacks.
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = max(1, -(-vocabulary.count() * widest // BLOCK_CELLS))
    absent = groups.select("lang", "source", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(None).cast("int").alias("index"), _share(F.lit(0), F.col("_total"), F.col("_kept")).alias("p"))
    present = shares.select("lang", "source", F.pmod("index", F.lit(blocks)).alias("_block"), "index", "p")
    partial = absent.unionByName(present).groupBy("lang", "_block").applyInPandas(_compare, "lang string, a string, b string, value bigint")
    distances = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = distances.select("lang", both.alias("_way"), "value").select("lang", "_way.source", F.lit("pair").alias("part"), "_way.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    # Terms: shares above those of the whole language.
    overall = shares.groupBy("lang", "index").agg(F.sum("count").alias("_n"))
    langs = groups.groupBy("lang").agg(F.sum("_total").alias("_total"), F.max("_kept").alias("_kept"))
    overall = overall.join(broadcast_if_small(stored(langs, "langs")), "lang").select("index", _share(F.col("_n"), F.col("_total"), F.col("_kept")).alias("q"))
    typical = shares.join(overall, "index").where("p > q").join(vocabulary.select("index", "term"), "index")
    terms = typical.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(s), 0) AS s
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS s FROM c GROUP BY ALL) USING (lang, source)
  GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (s + 5 * v))::BIGINT AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(n) + 5) // (any_value(s) + 5 * any_value(v)))::BIGINT AS q
  FROM c JOIN (SELECT lang, sum(s)::BIGINT AS s, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(f), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS one, y.source AS two, sum(abs(x.p - y.p))::BIGINT AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.one = a.source AND s.two = b.source
  GROUP BY ALL),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
