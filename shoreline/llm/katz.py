"""Katz backoff language model over word bigrams.

    P(w | h) = d(c(h w)) c(h w) / c(h)   where h w was seen
             = a(h) P(w)                 elsewhere, and P(w) itself backs off to one unknown word
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over seen w)

d is the Good-Turing discount of counts up to ``CUT``, for bigrams and for words; a(h) makes every
distribution sum to 1 exactly. Texts are A-Z lower-cased words between white space and one end token; the
first word's context is a start mark. All unseen words count as one unknown word.

Words are 64-bit hashes. Words at or above a count that at most ``FREQUENT`` words reach are numbered by
rank; this table has a proven bound and is sent to all tasks. Tasks count the bigrams of their texts and
send sorted blocks, one per bucket of contexts, so a word pair is a few bytes and equal pairs of a task are
one entry. Contexts that hold a notable share of all words are spread over all buckets by the pair; their
sums are added up over the buckets. The probabilities of rarer words are joined by word. Scoring
sends blocks of pairs with the documents they occur in to the same buckets, adds up by document there, and
joins unseen pairs of rarer words by word again. The bigram table and the backoff weights are stored,
one row per bucket, in the shared folder.

Null and empty texts are the end token only. Null ids are never learned from. Repeated rows are learned from
and scored one by one. Without training text every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.text import mix, slices, words
from shoreline.plans.materialize import stored

CUT = 5
FREQUENT = 1 << 20
FLUSH = 1_000_000  # tokens a task holds before it sends a block
_NO_ID = -(1 << 63)
_RARE = np.uint64(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
END = mix(np.array([1], dtype=np.uint64))[0]
START = np.uint64(2**63 - 1)  # as a context only


def discounts(have: np.ndarray) -> np.ndarray:
    """Good-Turing discounts of counts 0..CUT from ``have[r]`` = how many were seen r times, r to CUT + 1.

    Where the counts of counts give no discount between 0 and 1, half a count is taken off instead.
    """
    r = np.arange(CUT + 1, dtype=float)
    half = np.concatenate([[1.0], (r[1:] - 0.5) / r[1:]])
    if (have[1:] <= 0).any():
        return half
    lost = (CUT + 1) * have[CUT + 1] / have[1]
    found = np.ones(CUT + 1)
    found[1:] = ((r[1:] + 1) * have[2 : CUT + 2] / have[1 : CUT + 1] / r[1:] - lost) / (1 - lost) if lost != 1 else 0
    return found if ((found[1:] > 0) & (found[1:] < 1)).all() else half


@dataclass
class WordModel:
    """What every task knows: the frequent words, and the discounts of single words."""

    names: np.ndarray  # hashes in ascending order
    ranks: np.ndarray  # of these
    counts: np.ndarray  # by rank, descending
    tokens: int
    vocabulary: int
    documents: int
    discount: np.ndarray
    scale: float  # 1, or less where discounts leave nothing for the unknown word
    unknown: float
    hot: int  # so many ranks are spread over buckets as contexts
    buckets: int

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of frequent words, marked hash of the others."""
        if not len(self.names):
            return hashes | _RARE
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, self.ranks[at].astype(np.uint64), hashes | _RARE)

    def word(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words seen ``counts`` times."""
        low = np.minimum(counts, CUT).astype(np.int64)
        off = np.where(counts <= CUT, self.discount[low], 1.0)
        seen = off * counts * (self.scale / max(self.tokens, 1))
        return np.where(counts > 0, seen, self.unknown)

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        return (contexts < np.uint64(self.hot)) | (contexts == START)

    def bucket(self, contexts: np.ndarray, followers: np.ndarray) -> np.ndarray:
        pair = np.where(self.is_hot(contexts), mix(followers + _STEP), np.uint64(0))
        return (mix(contexts ^ pair) % np.uint64(self.buckets)).astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes with an end per document, document numbers)."""
    for a, b, data, offsets in slices(column):
        found = words(data, offsets)
        ends = found.first[1:]
        yield a, b, np.insert(found.hashes, ends, END), np.insert(found.doc, ends, np.arange(b - a))


def _count(hashes: list[np.ndarray]) -> pa.RecordBatch:
    names, n = np.unique(np.concatenate(hashes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["word", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for _, _, hashes, _ in _tokens(batch.column(0)):
            held.append(hashes)
            n += len(hashes)
            if n >= FLUSH:
                yield _count(held)
                held, n = [], 0
    if held:
        yield _count(held)


def _planes(values: np.ndarray) -> bytes:
    """Bytes by significance: high bytes of small numbers follow each other and compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _packed(contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """Pairs in order of (context, follower), each context once."""
    first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(contexts)))
    return {
        "contexts": _planes(contexts[first]), "runs": _planes(runs.astype(np.uint32)),
        "followers": _planes(followers), "counts": _planes(counts.astype(np.uint32)),
    }


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, run lengths, followers, counts)."""
    return _values(row.contexts, np.uint64), _values(row.runs, np.uint32), _values(row.followers, np.uint64), _values(row.counts, np.uint32)


_PACK = "contexts binary, runs binary, followers binary, counts binary"


def _pairs(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Contexts of all tokens: the word before, or the start mark."""
    before = np.concatenate([[START], codes[:-1]])
    before[np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))] = START
    return before


def _sorted_pairs(model: WordModel, contexts: np.ndarray, followers: np.ndarray):
    """Order by (bucket, context, follower), starts of equal pairs, and their buckets."""
    bucket = model.bucket(contexts, followers)
    order = np.lexsort((followers, contexts, bucket))
    b, h, w = bucket[order], contexts[order], followers[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (b[1:] != b[:-1])])
    at = np.flatnonzero(new)
    return order, at, b[at], h[at], w[at]


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: WordModel = shared.value
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            contexts, followers = (np.concatenate(x) for x in zip(*held))
            order, at, bucket, h, w = _sorted_pairs(model, contexts, followers)
            times = np.diff(np.append(at, len(order)))
            rows = []
            for k in np.unique(bucket):
                low, high = np.searchsorted(bucket, [k, k + 1])
                rows.append({"bucket": int(k), **_packed(h[low:high], w[low:high], times[low:high])})
            return pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("contexts", "runs", "followers", "counts")]]))

        for batch in batches:
            for _, _, hashes, doc in _tokens(batch.column(0)):
                codes = model.codes(hashes)
                held.append((_pairs(codes, doc), codes))
                n += len(codes)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return count


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """All blocks of a bucket as one, with its counts of counts."""
    parts = [_unpacked(r) for r in group.itertuples()]
    h = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    w, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
    total = np.add.reduceat(n.astype(np.int64), at)
    have = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[: CUT + 2]
    return pd.DataFrame([{"bucket": group["bucket"].iloc[0], **_packed(h[at], w[at], total), "have": have.tolist()}])


@dataclass
class KatzModel:
    words: WordModel
    counted: DataFrame  # word, n: all training words
    rare: DataFrame  # word with the mark bit, n: words below the frequent ones
    bigrams: DataFrame  # one row per bucket
    weights: DataFrame  # one row per bucket: backoff weights in the order of its contexts
    discount: np.ndarray
    hot: dict[int, tuple[float, float]]  # spread contexts: backoff weight, scale of seen pairs


def _seen(words_: WordModel, discount: np.ndarray, h: np.ndarray, runs: np.ndarray, n: np.ndarray):
    """Totals of the contexts and P(w | h) of all pairs, before any scaling."""
    first = np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64)
    total = np.add.reduceat(n.astype(np.int64), first).astype(float)
    hot = words_.is_hot(h)
    ranked = hot & (h != START)
    total[ranked] = words_.counts[h[ranked].astype(np.int64)]
    total[h == START] = words_.documents
    off = np.where(n <= CUT, discount[np.minimum(n, CUT)], 1.0)
    return first, total, hot, off * n / np.repeat(total, runs)


def _backoff(left: np.ndarray, room: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and scale of seen pairs; a context without any discount keeps one count for the rest."""
    none = left < 1e-12
    scale = np.where(none, total / (total + 1), 1.0)
    return np.where(none, 1 / (total + 1), left) / np.maximum(room, 1e-15), scale


def _word_column(known: WordModel):
    """``WordModel.word`` of the column ``n``."""
    off = F.element_at(F.array(*[F.lit(float(d)) for d in known.discount]), F.least(F.col("n"), F.lit(CUT)).cast("int") + 1)
    return F.when(F.col("n") <= CUT, off).otherwise(F.lit(1.0)) * F.col("n") * F.lit(known.scale / max(known.tokens, 1))


def fit(docs: DataFrame, text: str = "text", *, frequent: int = FREQUENT) -> KatzModel:
    """Count ``docs`` and store the model's tables."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    train = docs.select(docs[text].alias("_text"))
    counted = stored(train.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    levels = counted.groupBy("n").agg(F.count("*").alias("types")).toPandas().sort_values("n", ascending=False)  # one row per different count
    levels["upto"] = levels["types"].cumsum()
    tokens, vocabulary = int((levels["n"] * levels["types"]).sum()), int(levels["types"].sum())
    reached = levels[levels["upto"] <= frequent]
    least = int(reached["n"].min()) if len(reached) else 1 << 62
    listed = counted.where(F.col("n") >= least).toArrow()  # at most ``frequent`` rows
    hashes, n = listed["word"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    by_name = np.argsort(hashes)
    have = np.zeros(CUT + 2)
    for c, types in zip(levels["n"], levels["types"]):
        if c <= CUT + 1:
            have[int(c)] = types
    discount = discounts(have)
    kept = float(sum(types * c * (discount[int(c)] if c <= CUT else 1.0) for c, types in zip(levels["n"], levels["types"]))) / max(tokens, 1)
    scale = 1.0 if kept < 1 - 1e-12 else tokens / (tokens + 1)
    documents = train.count()
    words_ = WordModel(hashes[by_name], by_name, n, tokens, vocabulary, documents, discount, scale, 1 - kept * scale, int((n > tokens / (8 * buckets)).sum()), buckets)
    shared = spark.sparkContext.broadcast(words_)

    blocks = train.mapInArrow(_counter(shared), f"bucket int, {_PACK}")
    bigrams = stored(blocks.groupBy("bucket").applyInPandas(_merge, f"bucket int, {_PACK}, have array<bigint>"), "bigrams")
    seen = bigrams.agg(*[F.sum(F.col("have")[r]).alias(f"n{r}") for r in range(CUT + 2)]).first()
    pair_discount = discounts(np.array([float(x or 0) for x in seen]))

    def rarer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                h, runs, w, _ = _unpacked(row)
                at = np.flatnonzero(w >= _RARE)
                place = np.repeat(np.arange(len(h), dtype=np.int32), runs)[at]
                for a in range(0, len(at), 500_000):
                    yield pd.DataFrame({"word": w[at[a : a + 500_000]].view(np.int64), "bucket": np.int32(row.bucket), "place": place[a : a + 500_000]})

    # Hashes of rarer words carry the mark bit; frequent words with or without it never meet them here.
    marked = counted.where(F.col("n") < least).select((F.col("word").bitwiseOR(F.lit(-(1 << 63)))).alias("word"), "n")
    marked = stored(marked.groupBy("word").agg(F.sum("n").alias("n")), "rare-words")
    rare = bigrams.select("bucket", "contexts", "runs", "followers", "counts").mapInPandas(rarer, "word bigint, bucket int, place int")
    sums = rare.join(marked, "word").groupBy("bucket", "place").agg(F.sum(_word_column(words_)).alias("s"))

    def weigh(key, model: pd.DataFrame, rare_sums: pd.DataFrame) -> pd.DataFrame:
        known: WordModel = shared.value
        out = []
        for row in model.itertuples():
            h, runs, w, n = _unpacked(row)
            first, total, hot, p2 = _seen(known, pair_discount, h, runs, n)
            p1 = np.zeros(len(w))
            common = np.flatnonzero(w < _RARE)
            p1[common] = known.word(known.counts[w[common].astype(np.int64)])
            s2, s1 = np.add.reduceat(p2, first), np.add.reduceat(p1, first)
            s1 += np.bincount(rare_sums["place"].to_numpy(dtype=np.int64), rare_sums["s"].to_numpy(), minlength=len(h))
            weight, scales = _backoff(1 - s2, 1 - s1, total)
            out.append({"bucket": key[0], "context": -1, "total": 0.0, "s2": 0.0, "s1": 0.0, "weights": _planes(weight), "scales": _planes(scales)})
            for i in np.flatnonzero(hot):
                out.append({"bucket": key[0], "context": int(h[i]), "total": total[i], "s2": s2[i], "s1": s1[i], "weights": None, "scales": None})
        return pd.DataFrame(out, columns=["bucket", "context", "total", "s2", "s1", "weights", "scales"])

    schema = "bucket int, context bigint, total double, s2 double, s1 double, weights binary, scales binary"
    weighed = stored(bigrams.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInPandas(weigh, schema), "backoff")
    # Contexts above a fixed share of all words: fewer than 8 per bucket.
    spread = weighed.where("context >= 0").groupBy("context").agg(F.max("total").alias("total"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")).collect()
    hot = {}
    for r in spread:
        weight, scaled = _backoff(np.array([1 - r["s2"]]), np.array([1 - r["s1"]]), np.array([r["total"]]))
        hot[r["context"]] = (float(weight[0]), float(scaled[0]))
    return KatzModel(words_, counted, marked, bigrams, weighed.where("context < 0").select("bucket", "weights", "scales"), pair_discount, hot)


def _asker(shared):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: WordModel = shared.value
        held, n, ids, made = [], 0, [], 0
        part = TaskContext.get().partitionId()
        kinds = [("bucket", pa.int32()), *[(c, pa.binary()) for c in ("contexts", "runs", "followers", "counts", "docs", "ids")], ("base", pa.int64())]

        def flush() -> pa.RecordBatch:
            contexts, followers, doc = (np.concatenate(x) for x in zip(*held))
            names = np.concatenate(ids)
            order, at, bucket, h, w = _sorted_pairs(known, contexts, followers)
            bounds = np.append(at, len(order))
            rows = []
            for k in np.unique(bucket):
                low, high = np.searchsorted(bucket, [k, k + 1])
                docs = doc[order[bounds[low] : bounds[high]]].astype(np.uint32)
                rows.append({
                    "bucket": int(k), **_packed(h[low:high], w[low:high], np.diff(bounds[low : high + 1])),
                    "docs": _planes(docs), "ids": _planes(names[np.unique(docs)]), "base": (part << 33) + made,
                })
            return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

        held_docs = 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, hashes, doc in _tokens(batch.column(1)):
                codes = known.codes(hashes)
                held.append((_pairs(codes, doc), codes, doc + held_docs))
                ids.append(keys[a:b])
                held_docs += b - a
                n += len(codes)
                if n >= FLUSH:
                    yield flush()
                    made += held_docs
                    held, n, ids, held_docs = [], 0, [], 0
        if held:
            yield flush()

    return ask


_SUMS = (("docs", np.uint32), ("ids", np.int64), ("n", np.uint32), ("known", np.uint32), ("base", np.float64), ("score", np.float64))
_ANSWER = "block bigint, row bigint, id bigint, word bigint, " + ", ".join(f"{c} binary" for c, _ in _SUMS)


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of the documents of a block over all buckets."""
    parts = {c: np.concatenate([_values(x, kind) for x in group[c]]) for c, kind in _SUMS}
    docs, first, place = np.unique(parts["docs"], return_index=True, return_inverse=True)
    out = {"row": group["block"].iloc[0] + docs.astype(np.int64), "id": parts["ids"][first]}
    for c in ("n", "known", "base", "score"):
        out[c] = np.bincount(place, parts[c])
    return pd.DataFrame(out).astype({"n": "int64", "known": "int64"})


def _answerer(shared, discount: np.ndarray, hot: dict[int, tuple[float, float]]):
    def load(known: WordModel, row):
        """Pairs by hash with their log10 probabilities, and the contexts with weights and totals."""
        contexts, runs, w, n = _unpacked(row)
        _, total, is_hot, p = _seen(known, discount, contexts, runs, n)
        weight, scales = _values(row.weights, np.float64).copy(), _values(row.scales, np.float64).copy()
        for i in np.flatnonzero(is_hot):
            weight[i], scales[i] = hot[int(contexts[i])]
        h = np.repeat(contexts, runs)
        keys, value = mix(h * _STEP + mix(w)), np.log10(p * np.repeat(scales, runs))
        order = np.argsort(keys)
        return keys[order], h[order], w[order], value[order], contexts, weight, total

    def answer(key, tables: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        known: WordModel = shared.value
        none, zero = np.array([2**63 - 2], dtype=np.uint64), np.zeros(1)  # a context that never occurs
        loaded = [load(known, row) for row in tables.itertuples()]
        keys, mh, mw, value, contexts, weight, total = loaded[0] if loaded else (none, none, none, zero, none, zero, zero)
        out = []
        for row in asked.itertuples():
            ch, runs, w, times = _unpacked(row)
            h = np.repeat(ch, runs)
            wanted = mix(h * _STEP + mix(w))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            seen = (keys[at] == wanted) & (mh[at] == h) & (mw[at] == w)
            place = np.minimum(np.searchsorted(contexts, ch), len(contexts) - 1)
            there = contexts[place] == ch
            back, count = np.where(there, weight[place], 1.0), np.where(there, total[place], 0.0)
            for i in np.flatnonzero(known.is_hot(ch) & ~there):  # a spread context without seen pairs in this bucket
                back[i] = hot.get(int(ch[i]), (1.0, 1.0))[0]
                count[i] = known.documents if ch[i] == START else known.counts[int(ch[i])]
            common = w < _RARE
            p = np.ones(len(w))
            p[common] = known.word(known.counts[w[common].astype(np.int64)])
            log = np.log10(np.repeat(back, runs) * p)
            log[seen] = value[at[seen]]
            # The context of a pair is the word before: its base score and whether it is known.
            seen_before = np.where(h != START, np.repeat(count, runs), 0.0)
            each = np.repeat(np.arange(len(w)), times)
            docs = _values(row.docs, np.uint32).astype(np.int64)
            where, doc = np.unique(docs, return_inverse=True)
            ids = _values(row.ids, np.int64)
            sums = [np.bincount(doc, x[each], minlength=len(where)) for x in (log, np.log10(seen_before + 1), (seen_before > 0).astype(float))]
            arrays = (where, ids, np.bincount(doc, minlength=len(where)), sums[2], sums[1], sums[0])
            out.append((row.base, None, None, None, *(_planes(x.astype(kind)) for x, (_, kind) in zip(arrays, _SUMS))))
            open_ = np.flatnonzero((~seen & ~common)[each])
            rows = zip((row.base + docs[open_]).tolist(), ids[doc[open_]].tolist(), w[each[open_]].view(np.int64).tolist())
            out.extend((None, *x, *[None] * len(_SUMS)) for x in rows)
        names = ["block", "row", "id", "word"]
        return pd.DataFrame(out, columns=[*names, *(c for c, _ in _SUMS)], dtype=object).astype(dict.fromkeys(names, "Int64"))

    return answer


def score(docs: DataFrame, model: KatzModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, n_known, base_score, score`` of every row of ``docs``; scores are log10."""
    known = model.words
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most ``frequent`` words
    chosen = docs.select(F.coalesce(docs[key].cast("bigint"), F.lit(_NO_ID)).alias("_id"), docs[text].alias("_text"))
    asked = chosen.mapInArrow(_asker(shared), f"bucket int, {_PACK}, docs binary, ids binary, base bigint")
    tables = model.bigrams.select("bucket", "contexts", "runs", "followers", "counts").join(model.weights, "bucket")
    answered = tables.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(_answerer(shared, model.discount, model.hot), _ANSWER)
    answers = stored(answered, "answers")
    summed = answers.where("block IS NOT NULL").groupBy("block").applyInPandas(_add_up, "row bigint, id bigint, n bigint, known bigint, base double, score double")
    unseen = answers.where("block IS NULL").groupBy("row", "id", "word").agg(F.count("*").alias("times"))
    rarer = unseen.join(model.rare, "word", "left")
    unigram = F.when(F.col("n").isNull(), F.lit(known.unknown)).otherwise(_word_column(known))
    rest = rarer.select("row", "id", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), (F.log10(unigram) * F.col("times")).alias("score"))
    both = summed.unionByName(rest)
    total = both.groupBy("row", "id").agg(*[F.sum(c).alias(c) for c in ("n", "known", "base", "score")])
    end = float(np.log10(known.documents + 1))
    floor = float(np.log10(known.tokens + known.vocabulary + 1))
    return total.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias(key),
        F.col("n").alias("n_tokens"),
        (F.col("known") + int(known.documents > 0)).alias("n_known"),
        (F.col("base") + end - F.col("n") * floor).alias("base_score"),
        "score",
    )
