"""Near-duplicate documents by DartMinHash.

A document is the multiset of its shingles of five words (letters, digits and other non-ASCII signs,
A-Z lower-cased; a shorter text with words is one shingle), weighted by their counts. Similarity is
the weighted Jaccard similarity. Every shingle has its own random sequence of darts over (weight, rank);
a document throws those that land within the shingle's weight and below a rank bound, which it sets by
its total weight so that about k ln k + 2k darts land. A dart's hash names one of k coordinates, and each
coordinate keeps its earliest dart: two documents agree in a coordinate with the probability of their
similarity. Documents that agree in a whole band of coordinates are candidates, and candidates are
verified by the exact similarity.

Documents with equal multisets form one class, and only the smallest id of a class goes on. Buckets with
the same members are kept once. All members of a bucket are compared, in blocks, by matrix products over
the shingles that occur in the block, which give every intersection exactly; only links that connect
what was apart in the block are returned, fewer than there are members. A large bucket becomes many block
pairs in many tasks.

Texts without words are like no other document. Null ids are left out of the comparison: each row stays its
own. Rows that repeat an id are one document if their texts are alike, else linked through the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.components import components
from shoreline.llm.tables import bounded_batches
from shoreline.llm.text import mix, slices, words
from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

SHINGLE = 5
BANDS, ROWS = 21, 6
THRESHOLD = 0.8
BLOCK = 256  # members compared at once
_COLUMNS = 16384  # shingles in a matrix at once
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted by document and hash."""
    found = words(data, offsets, _GAP)
    h, first = found.hashes, found.first
    n = len(h) - SHINGLE + 1
    doc, grams = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(SHINGLE):
            grams = grams * _STEP + h[i : i + n]
        whole = found.doc[:n] == found.doc[SHINGLE - 1 :]
        doc, grams = found.doc[:n][whole], mix(grams[whole])
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        own = []
        for d in short:
            total = np.array([lengths[d]], dtype=np.uint64)
            for x in h[first[d] : first[d + 1]]:
                total = mix(total * _STEP + x)
            own.append(total[0])
        doc, grams = np.append(doc, short), np.append(grams, np.array(own, dtype=np.uint64))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return doc[at], grams[at], np.diff(np.append(at, len(doc)))


def strips(doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements cut into strips of weight 1 at most: document, strip hash, weight of the strip."""
    many = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return doc[at], mix(element[at] + number.astype(np.uint64) * _STEP), np.minimum(weight[at] - number, 1.0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, documents: int, k: int) -> np.ndarray:
    """k 64-bit values for each of ``documents`` weighted sets; 0 throughout for empty ones."""
    out = np.zeros((documents, k), dtype=np.uint64)
    total = np.bincount(doc, weight, minlength=documents)
    darts = k * np.log(k) + 2 * k
    doc, strip, room = strips(doc, element, weight)
    todo = total > 0
    while todo.any():
        bound = np.zeros(documents)
        bound[todo] = darts / total[todo]
        active = np.flatnonzero(todo[doc])
        rank = np.zeros(len(active))
        keys, ranks, names = [], [], []
        number = np.zeros(1, dtype=np.uint64)
        while len(active):
            number += _STEP
            dart = mix(strip[active] ^ number)
            rank = rank - np.log(_uniform(dart))
            inside = rank < bound[doc[active]]
            active, rank, dart = active[inside], rank[inside], dart[inside]
            second = mix(dart + _STEP)
            lands = np.flatnonzero(_uniform(second) < room[active])
            name = mix(second[lands] + _STEP)
            keys.append(doc[active[lands]] * k + (name % np.uint64(k)).astype(np.int64))
            ranks.append(rank[lands])
            names.append(name)
        key, when, name = np.concatenate(keys), np.concatenate(ranks), np.concatenate(names)
        order = np.lexsort((when, key))
        key, name = key[order], name[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = key[1:] != key[:-1]
        filled = np.bincount(key[first] // k, minlength=documents) == k
        use = first & filled[key // k]
        out.reshape(-1)[key[use]] = name[use]
        todo &= ~filled
        darts *= 2
    return out


def _documents(column: pa.Array, bands: int, rows: int) -> Iterator[tuple[bytes | None, list[int] | None]]:
    """For every text: digest of its multiset and hashes of its bands; None without words."""
    for a, b, data, offsets in slices(column):
        doc, element, count = shingles(data, offsets)
        signature = dart_signatures(doc, element, count.astype(np.float64), b - a, bands * rows)
        banded = np.zeros((b - a, bands), dtype=np.uint64)
        for i in range(rows):
            banded = mix(banded * _STEP + signature.reshape(b - a, bands, rows)[:, :, i])
        both = np.column_stack([element, count.astype(np.uint64)])
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        for d in range(b - a):
            if cut[d] == cut[d + 1]:
                yield None, None
            else:
                yield hashlib.md5(both[cut[d] : cut[d + 1]].tobytes()).digest(), banded[d].view(np.int64).tolist()


def _elements(column: pa.Array) -> Iterator[bytes]:
    """Sorted hashes of the unit strips of every text: equal counts share as many strips."""
    for a, b, data, offsets in slices(column):
        doc, element, count = shingles(data, offsets)
        doc, strip, _ = strips(doc, element, count.astype(np.float64))
        cut = np.searchsorted(doc, np.arange(b - a + 1))
        for d in range(b - a):
            yield np.sort(strip[cut[d] : cut[d + 1]]).tobytes()


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Index pairs of sets with |A and B| / |A or B| >= threshold, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    names, column = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, len(names), _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        held = np.zeros((len(sets), min(_COLUMNS, len(names) - low)), dtype=np.float32)
        held[row[a:b], column[a:b] - low] = 1
        shared += held @ held.T
    union = sizes[:, None] + sizes[None, :] - shared.astype(np.float64)
    alike = shared.astype(np.float64) >= threshold * union - 1e-9
    return np.argwhere(np.triu(alike, 1))


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A subset of ``pairs`` that connects the same members, n - 1 pairs at most."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            top[y] = x
            kept.append((a, b))
    return kept


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``key, class_id`` (smallest id of its group), ``kept``, ``copies``.

    ``kept`` marks one row of every group. ``copies`` counts the rows with the same multiset.
    """
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, banded = zip(*_documents(batch.column(1), bands, rows)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["_id", "_same", "_bands"])

    read = docs.select(docs[key].cast("bigint").alias("_id"), docs[text].alias("_text"))
    signed = stored(read.mapInArrow(sign, "_id bigint, _same binary, _bands array<bigint>").withColumn("_row", F.monotonically_increasing_id()), "signed")
    known = signed.where("_id IS NOT NULL AND _same IS NOT NULL")
    classes = stored(known.groupBy("_same").agg(F.min("_id").alias("_first"), F.count("*").alias("copies"), F.min_by("_bands", "_id").alias("_bands")), "classes")

    # Candidate groups: members of a bucket, each different set of members once.
    banded = classes.select("_first", F.posexplode("_bands").alias("_band", "_hash"))
    named = banded.select("_first", F.xxhash64("_band", "_hash").alias("_bucket"))
    buckets = named.groupBy("_bucket").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("_first") % (1 << 40)).alias("_set"), F.min("_first").alias("_low"), F.max("_first").alias("_high"))
    chosen = buckets.where("_low < _high").groupBy("_n", "_set", "_low", "_high").agg(F.min("_bucket").alias("_bucket"))
    members = stored(named.join(stored(chosen.select("_bucket", "_n"), "buckets"), "_bucket").distinct(), "members")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_elements(batch.column(1))), pa.binary())], names=["_first", "_elements"])

    wanted = stored(members.select(F.col("_first").alias("_id")).distinct(), "wanted")
    texts = read.join(broadcast_if_small(wanted), "_id", "left_semi")
    elements = stored(texts.select("_id", "_text").mapInArrow(expand, "_first bigint, _elements binary"), "elements")
    links = _verify(members, elements, threshold)
    repeats = known.groupBy("_id").agg(F.min("_same").alias("_s1"), F.max("_same").alias("_s2")).where("_s1 <> _s2")
    through_id = known.join(repeats.select("_id"), "_id").join(classes.select("_same", "_first"), "_same").select(F.col("_id").alias("a"), F.col("_first").alias("b")).where("a <> b")
    grouped = components(stored(links.unionByName(through_id), "verified"))
    labelled = classes.join(grouped, classes["_first"] == grouped["node"], "left")
    # Stored, as the joins below are on keys that many rows may share.
    final = stored(labelled.select("_same", "copies", F.coalesce("label", "_first").alias("class_id")), "class-labels")
    placed = stored(signed.drop("_bands").join(final, "_same", "left").withColumn("class_id", F.coalesce("class_id", "_id")), "placed")
    heads = placed.where("_same IS NOT NULL AND _id = class_id").groupBy(F.col("class_id").alias("_class")).agg(F.min("_row").alias("_head"))
    heads = stored(heads, "heads")
    joined = placed.join(heads, placed["class_id"] == heads["_class"], "left")
    alone = F.col("_id").isNull() | F.col("_same").isNull()
    return joined.select(F.col("_id").alias(key), "class_id", (alone | (F.col("_row") == F.col("_head"))).alias("kept"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def _verify(members: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` that connect the members of a bucket as all its pairs above the threshold do.

    A bucket above ``BLOCK`` members is cut into blocks, and every pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("_first", F.lit("block")), blocks).cast("int")
    cut = members.withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = cut.select("_bucket", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"), "_first")

    def compare(group):
        sets = [np.frombuffer(x, np.uint64) for x in group["_elements"]]
        ids = group["_first"].to_numpy()
        found = spanning(similar_pairs(sets, threshold), len(sets)) if len(sets) > 1 else []
        return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [ids[y] for _, y in found]}, dtype="int64")

    return placed.join(elements, "_first").groupBy("_bucket", "_i", "_j").applyInPandas(compare, "a bigint, b bigint")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of every group, and all rows without an id.

    Rows that repeat an id are one document, so one of them stays at most.
    """
    judged = near_duplicates(docs, key, text, **options).where(F.col(key).isNotNull())
    by_id = stored(judged.groupBy(F.col(key).alias("_id")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")), "judged")
    gone, repeated = stored(by_id.where("NOT _kept").select("_id"), "gone"), by_id.where("_kept AND _rows > 1").select("_id")
    left = docs.join(broadcast_if_small(gone), docs[key].cast("bigint") == F.col("_id"), "left_anti")
    if not repeated.count():
        return left
    again = broadcast_if_small(stored(repeated, "repeated"))
    single = left.join(again, left[key].cast("bigint") == F.col("_id"), "left_anti")
    return single.unionByName(left.join(again, left[key].cast("bigint") == F.col("_id"), "left_semi").dropDuplicates([key]))
