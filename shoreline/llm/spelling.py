"""Spelling variant grouping over a variable-length gram index.

Words are runs of letters, some with a planted slip: where the checksum of document and run says so, one
code point is deleted. Two words are near if one inserted, deleted or replaced code point turns one into the other.

The index: a word between two end marks has a gram at every place, the shortest of two to five signs that is
not frequent among the words, or the longest there is. The dictionary of frequent grams is pruned by a
frequency that grows with the vocabulary, so it has ``GRAMS`` entries at most and can be broadcast. A gram is known
by its own signs alone, so an edit affects only the grams across its place: their largest number over all
places is the word's bound, five at most, and all other grams, at least one, are found in every near word.
In one global order of grams (rare ones first), near words therefore share a gram among the first
``bound + 1`` of each, and only those lists are merged. A pair is taken from the first list that both words share.

Inside a list, words are compared by the hashes of all their forms with one code point left out, and hits
are verified on the code points: the work is linear in the list, whatever its length, but for the near
pairs themselves, and no other pairs are formed. Every list is held by one task; frequent grams are in the lists of
the words only that have no rarer ones.

Null texts have no words; a null id counts as an empty one. Repeated rows count as often as they occur. Ties of the form go
to the smallest word in code-point order. An empty table gives no rows. Other columns are ignored, so their
names can't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.tables import ascii_lower
from shoreline.llm.text import mix
from shoreline.plans.materialize import stored

BETWEEN = "[^A-Za-z\u00C0-\u00FF]+"  # runs are made of all other signs
SLIP = 97
SHORTEST, LEAST = 5, 3
QMIN, QMAX = 2, 5
GRAMS = 100_000
FREQUENT = 500
FIRST, LAST = "\x01", "\x02"  # end marks
_SIGNS = np.random.default_rng(20240911).integers(1, 2**64, 1 << 16, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 & ~0x7 | 0x3


def slipped(ident: Column, run: Column, every: int = SLIP) -> Column:
    """``run`` without one code point where ``every`` divides the checksum of ``ident:run``."""
    checksum = F.crc32(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = F.pmod(checksum, F.length(run)).cast("int")
    return F.when(checksum % every == 0, F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))).otherwise(run)


def counted_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = SLIP) -> DataFrame:
    """``word, n`` of all words of ``shortest`` code points and ``least`` occurrences."""
    # Split, as extracting copies the text for every match.
    runs = docs.select(docs[key].alias("_id"), F.explode(F.split(ascii_lower(docs[text]), BETWEEN)).alias("_run"))
    words = runs.where(F.length("_run") >= shortest).select(slipped(F.col("_id"), F.col("_run"), every).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequent_grams(words: DataFrame, *, limit: int = GRAMS, least: int = FREQUENT) -> dict[str, int]:
    """Grams of two to five signs that occur more often than a frequency above which at most ``limit`` exist."""
    marked = F.concat(F.lit(FIRST), F.col("word"), F.lit(LAST))
    sizes = words.agg(F.sum(sum(F.greatest(F.length("word") + 3 - q, F.lit(0)) for q in range(QMIN, QMAX + 1))).alias("n")).first()
    threshold = max(least, -(-(sizes["n"] or 0) // limit))
    places = [F.transform(F.sequence(F.lit(1), F.greatest(F.length("_m") + 1 - q, F.lit(1))), lambda p, q=q: F.substr("_m", p, F.lit(q))) for q in range(QMIN, QMAX + 1)]
    grams = words.select(marked.alias("_m")).select(F.explode(F.concat(*places)).alias("gram"))
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > threshold).collect()}


@functools.lru_cache(maxsize=200_000)
def _list_of(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little", signed=True)


def decompose(word: str, frequent: dict[str, int]) -> list[str]:
    """The gram at every place of the marked word."""
    marked = f"{FIRST}{word}{LAST}"
    end, grams = len(marked), []
    for p in range(end - 1):
        q = p + QMIN
        while q < end and q - p < QMAX and marked[p:q] in frequent:
            q += 1
        grams.append(marked[p:q])
    return grams


def affected(grams: list[str]) -> int:
    """How many grams an edit can affect: the most that lie across one place between the end marks."""
    steps = [0] * (len(grams) + 3)
    for p, gram in enumerate(grams):
        steps[p] += 1
        steps[p + len(gram)] -= 1
    most = across = 0
    for i in range(len(grams)):
        across += steps[i]
        if i and across > most:
            most = across
    return most


def lists(word: str, frequent: dict[str, int]) -> list[int]:
    """The lists that ``word`` is merged in: those of its first ``bound + 1`` grams in the global order."""
    grams = decompose(word, frequent)
    order = sorted((frequent.get(g, 0), _list_of(g)) for g in grams)
    return list(dict.fromkeys(number for _, number in order[: affected(grams) + 1]))


def _hashes(words: list[str]) -> tuple[np.ndarray, ...]:
    """Hash of every word, and word, place and hash of every form with one code point left out.

    The last array tells where the code point is the first of a run of equal ones.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    longest = int(sizes.max()) if len(words) else 0
    powers = np.ones(longest + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    values = _SIGNS[codes & 0xFFFF] + (codes >> 16).astype(np.uint64) * np.uint64(_BASE)
    here, back = np.zeros(len(codes) + 1, np.uint64), np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values * powers[place], out=here[1:])
    np.cumsum(values * np.where(place > 0, powers[place - 1], np.uint64(0)), out=back[1:])
    at = np.arange(len(codes))
    left_out = here[at] - here[starts[owner]] + back[ends[owner]] - back[at + 1]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    return here[ends] - here[starts], owner, place, left_out, first


def near_pairs(words: list[str], number: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of near words with equal ``number`` (their list), each once. Words of a list differ."""
    if not words:
        return []
    whole, owner, place, left_out, first = _hashes(words)
    salt = mix(number.astype(np.uint64))
    length = np.bincount(owner, minlength=len(words)).astype(np.uint64)
    found = []
    # Replaced: the same place left out of words of one length.
    spot = place.astype(np.uint64) << np.uint64(32) | length[owner]
    same = mix(left_out + salt[owner]) ^ mix(spot + np.uint64(1))
    order = np.argsort(same, kind="stable")
    bounds = np.flatnonzero(np.diff(same[order], prepend=~same[order[:1]], append=~same[order[-1:]]))
    sizes = np.diff(bounds)
    for low, size in zip(bounds[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        group = order[low : low + size].tolist()
        for i, x in enumerate(group):
            a, at = words[owner[x]], int(place[x])
            for y in group[:i]:
                b = words[owner[y]]
                if number[owner[x]] == number[owner[y]] and len(a) == len(b) and a[:at] == b[:at] and a[at + 1 :] == b[at + 1 :]:
                    found.append((int(owner[y]), int(owner[x])))
    # Left out: the longer word without the code point is the shorter one.
    shorter = mix(whole + salt)
    order = np.argsort(shorter, kind="stable")
    chosen = np.flatnonzero(first)
    wanted = mix(left_out[chosen] + salt[owner[chosen]])
    low = np.searchsorted(shorter[order], wanted, "left")
    high = np.searchsorted(shorter[order], wanted, "right")
    for x, a, b in zip(chosen[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
        longer, at = words[owner[x]], int(place[x])
        for k in order[a:b].tolist():
            if number[k] == number[owner[x]] and words[k] == longer[:at] + longer[at + 1 :]:
                found.append((k, int(owner[x])))
    return found


def near_words(words: DataFrame, *, limit: int = GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """``a, a_n, b, b_n``: every pair of near words of ``words`` (``word, n``) once."""
    grams = words.sparkSession.sparkContext.broadcast(frequent_grams(words, limit=limit, least=frequent))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, before = [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                own = lists(word, grams.value)
                at += [i] * len(own)
                number += own
                before += [own[:k] for k in range(len(own))]
            rows = pa.array(at, pa.int64())
            columns = [pa.array(number, pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(before, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_list", "word", "n", "_before"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of a list that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(0).to_numpy()
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield _merged([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif held and held[0].column(0)[0].as_py() != number[0]:
                yield _merged(held)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield _merged(held)

    indexed = words.select("word", "n").mapInArrow(place, "_list bigint, word string, n bigint, _before array<bigint>")
    merged = indexed.repartition("_list").sortWithinPartitions("_list")
    return merged.mapInArrow(merge, "a string, a_n bigint, b string, b_n bigint")


def _merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    number = rows["_list"].to_numpy()
    words = rows["word"].to_pylist()
    before = rows["_before"].to_pylist()
    a, b = [], []
    for i, j in near_pairs(words, number):
        if not before[i] or not before[j] or set(before[i]).isdisjoint(before[j]):
            a.append(i)
            b.append(j)
    columns = [rows[c].take(pa.array(at, pa.int64())).combine_chunks() for at in (a, b) for c in ("word", "n")]
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in columns]
    columns = [pa.array([], c.type) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=["a", "a_n", "b", "b_n"])


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, every: int = SLIP, limit: int = GRAMS, frequent: int = FREQUENT) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word."""
    if shortest < QMAX:
        raise ValueError(f"words need {QMAX} code points, so that an edit leaves a gram")
    words = stored(counted_words(docs, key=key, text=text, shortest=shortest, least=least, every=every), "words")
    pairs = near_words(words, limit=limit, frequent=frequent)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m"))))
    near = pairs.select(ways.alias("_way")).select("_way.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"))
    fits = -F.col("_best.m") >= 2 * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("_best.near")).alias("form"), F.when(fits, -F.col("_best.m")).alias("form_n")
    )
    judged = stored(judged, "forms")
    return judged.join(roots(judged.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: from every word along ``form`` to the last, by pointer doubling.

    A form occurs at least twice as often as its word, so the paths are short and have no cycle.
    """
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = ahead.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = stored(ahead.join(onward, ahead["root"] == onward["_at"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        ahead = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return ahead


ORACLE = r"""
WITH RECURSIVE table_ AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, n, list_transform(range(0, length(hex(doc_id || ':' || run)) // 2),
    lambda i: strpos('123456789ABCDEF', hex(doc_id || ':' || run)[2 * i + 1]) * 16 + strpos('123456789ABCDEF', hex(doc_id || ':' || run)[2 * i + 2])) AS b
  FROM runs),
sums AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h
  FROM bytes, table_),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM d x JOIN w y ON x.s = y.word
  UNION SELECT y.word, x.word, x.n FROM d x JOIN w y ON x.s = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, struct_pack(a := -m, b := encode(other))) AS other FROM near GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at WHERE e.form IS NULL
"""
