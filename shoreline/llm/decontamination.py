r"""Benchmark decontamination.

Texts are lower-cased (A-Z) and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Every window
of ``n`` consecutive item words (all words of a shorter item) is hashed; the hashes of the
benchmark form a hash set inside the plan, sent to every task, which probes it with the hash of
every window of its documents. Windows whose hash is in the set are compared with the
benchmark's windows word by word.

The set is used only up to ``SET_LIMIT`` windows, which are counted first; a larger benchmark is
joined by hash instead. Null text has no words; items without words are no windows; empty tables
give empty results or no hits. Repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.tables import ascii_lower
from shoreline.plans.materialize import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_CASE_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
SET_LIMIT = 50_000
_HITS = "array<struct<at:int,n:int,window:string>>"


def word_list(text: Column) -> Column:
    found = F.regexp_extract_all(ascii_lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = 10) -> DataFrame:
    """``_item, _n, _window, _hash``: every window of every item, each once."""
    words = benchmark.select(benchmark[item].cast("string").alias("_item"), word_list(benchmark[text]).alias("_words"))
    length = F.least(F.size("_words"), F.lit(n))
    return (
        words.where(F.size("_words") > 0)
        .select("_item", length.alias("_n"), "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - length + 1)).alias("_at"))
        .select("_item", "_n", F.slice("_words", F.col("_at"), F.col("_n")).alias("_list"))
        .select("_item", "_n", F.concat_ws(" ", "_list").alias("_window"), F.xxhash64("_list").alias("_hash"))
        .distinct()
    )


def _evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` that is computed once per row: the optimizer doesn't copy it into its uses.

    A copy within a lambda would cut the whole text into words again for every window.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _starts(n: int) -> str:
    return f"CASE WHEN size(_words) >= {n} THEN sequence(1, size(_words) - {n - 1}) ELSE CAST(array() AS array<int>) END"


def _cut(i: str, n: int | str) -> str:
    return f"named_struct('at', {i}, 'n', {n}, 'window', concat_ws(' ', slice(_words, {i}, {n})))"


def _hits_by_set(words: DataFrame, windows: list) -> DataFrame:
    parts = []
    for n in sorted({w["_n"] for w in windows}):
        hashes = ", ".join(sorted(f"{w['_hash']}L" for w in windows if w["_n"] == n))
        # Words hold no quotes, backslashes or spaces.
        texts = ", ".join(sorted(f"'{w['_window']}'" for w in windows if w["_n"] == n))
        probed = f"filter({_starts(n)}, i -> xxhash64(slice(_words, i, {n})) IN ({hashes}))"
        parts.append(f"filter(transform({probed}, i -> {_cut('i', n)}), h -> h.window IN ({texts}))")
    return _evaluated(words, "_hits", F.expr(f"concat({', '.join(parts)})" if parts else f"CAST(array() AS {_HITS})"))


def _hits_by_join(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    rows = stored(words.withColumn("_row", F.monotonically_increasing_id()), "window-words")
    every = None
    for n in lengths:
        cut = rows.select("_row", F.lit(n).alias("_n"), F.explode(F.expr(f"transform({_starts(n)}, i -> struct(i AS at, xxhash64(slice(_words, i, {n})) AS hash))")).alias("w"))
        every = cut if every is None else every.unionByName(cut)
    near = every.select("_row", "_n", "w.at", F.col("w.hash").alias("_hash")).join(windows.select("_n", "_hash").distinct(), ["_n", "_hash"], "left_semi")
    cut = near.join(rows.select("_row", "_words"), "_row").select("_row", F.expr(_cut("at", "_n")).alias("hit"))
    same = cut.join(windows.select(F.col("_window").alias("_text")).distinct(), F.col("hit.window") == F.col("_text"), "left_semi")
    found = same.groupBy("_row").agg(F.collect_list("hit").cast(_HITS).alias("_hits"))
    return rows.join(found, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS))).drop("_row")


def with_hits(docs: DataFrame, windows: DataFrame, text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` with ``_words`` and ``_hits`` (place from 1, length, words of each verified window)."""
    words = _evaluated(docs, "_words", word_list(docs[text]))
    known = windows.select("_n", "_hash", "_window").distinct()
    if known.count() <= set_limit:
        return _hits_by_set(words, known.collect())
    lengths = sorted(r["_n"] for r in known.select("_n").distinct().collect())  # at most n of them
    return _hits_by_join(words, known, lengths)


def _hit_places() -> Column:
    return F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", *, n: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """Per document: ``key, n_words, n_hit, items`` (sorted ids as strings of the items found)."""
    windows = stored(benchmark_windows(benchmark, n=n), "windows")
    hit = with_hits(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), windows, "_text", set_limit)
    # Stored, so that the texts are scanned once; one short row per document.
    judged = stored(
        hit.select(
            F.monotonically_increasing_id().alias("_row"),
            "_key",
            F.size("_words").cast("bigint").alias("n_words"),
            F.size(_hit_places()).cast("bigint").alias("n_hit"),
            F.array_distinct(F.col("_hits.window")).alias("_windows"),
        ),
        "window-hits",
    )
    found = (
        judged.where("n_hit > 0")
        .select("_row", F.explode("_windows").alias("_window"))
        .join(windows.select("_window", "_item"), "_window")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set("_item")).alias("items"))
    )
    return judged.join(found, "_row", "left").select(
        F.col("_key").alias(key), "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, remove: str = "documents", n: int = 10, set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` without contaminated rows, or (``remove="spans"``) without the hit words."""
    windows = stored(benchmark_windows(benchmark, n=n), "windows")
    hit = with_hits(docs, windows, text, set_limit)
    if remove == "documents":
        return hit.where(F.size("_hits") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({ANY_CASE_GAP}{ANY_CASE_WORD})"), F.lit(1))
    tail = F.regexp_extract(F.col(text), f"({ANY_CASE_GAP})$", 1)
    places = hit.withColumn("_places", _hit_places()).withColumn("_pieces", pieces)
    kept = F.filter("_pieces", lambda p, i: ~F.array_contains("_places", i + 1))
    cleaned = F.when(F.size("_hits") == 0, F.col(text)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return places.withColumn(text, cleaned).select(*docs.columns)


ORACLE = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
