"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text of the training folds is unlabelled: it
holds toxic documents too, in the share of the class prior. With g the classifier, l the logistic loss and
p the prior, the risk is ``p E_pos l(g) + max(0, E_unl l(-g) - p E_pos l(-g))``; where the second part
turns negative, the step goes the other way, so a flexible classifier can't overfit the positives.

Features are words and word starts (4 and 5 bytes), present or not, hashed into ``BUCKETS``. How many
positive and unlabelled documents hold each bucket is counted over all training documents (positives: all, or
about ``CONFIRMED`` drawn by hash where there are more); the ``SELECTED`` buckets most typical of the positives are the inputs of the classifier, which is fitted on a
bounded sample (``most`` documents of either kind in expectation). The class prior is the share of
toxic among labelled training documents.

Null and empty texts hold no feature and get the score of the bias. Without positives every score is
0. Null ids are never learned from and count as held out. Repeated rows are scored one by one; a label counts for
all rows of its id, toxic if one of an id's labels is. Of equally typical buckets the lower number is taken. Other columns
are ignored, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.llm.tables import fold
from shoreline.llm.text import slices, words
from shoreline.plans.materialize import stored

BUCKETS = 1 << 20
SELECTED = 4096
MOST = 20_000
CONFIRMED = 200_000
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, sorted distinct document number x BUCKETS + bucket)."""
    for a, b, data, offsets in slices(column):
        found = words(data, offsets, _GAP)
        shift = np.uint64(64 - 20)
        base = found.doc.astype(np.int64) << 20
        parts = []
        for hashes, long_enough in ((found.hashes, None), (found.prefix(4) * np.uint64(3), 4), (found.prefix(5) * np.uint64(5), 5)):
            bucket = base + (hashes >> shift).astype(np.int64)
            parts.append(bucket if long_enough is None else bucket[found.ends - found.starts > long_enough])
        yield a, b, np.unique(np.concatenate(parts))


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        lookup = np.full(BUCKETS, len(self.buckets), dtype=np.int32)
        lookup[self.buckets] = np.arange(len(self.buckets))
        weights = np.append(self.weights, 0.0)
        for a, b, found in features(column):
            out[a:b] += np.bincount(found >> 20, weights[lookup[found & (BUCKETS - 1)]], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _draw(salt: str) -> Column:
    """A number in [0, 1) by the id."""
    return F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def _bucket_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents by bucket, unlabelled (all) and positive; the last entry is their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            positive = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for a, b, found in features(batch.column(0)):
                marked = positive[a:b][found >> 20]
                held[0, :-1] += np.bincount(found & (BUCKETS - 1), minlength=BUCKETS)
                held[1, :-1] += np.bincount(found[marked] & (BUCKETS - 1), minlength=BUCKETS)
            held[0, -1] += len(positive)
            held[1, -1] += int(positive.sum())
        at = np.flatnonzero(held[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[0, at]), pa.array(held[1, at])], names=["bucket", "n", "p"])

    counted = train.select("_text", "_positive").mapInArrow(count, "bucket int, n bigint, p bigint")
    # No more rows than buckets.
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(f"p > 0 OR bucket = {BUCKETS}").toPandas()
    n, p = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    at = rows["bucket"].to_numpy(dtype=np.int64)
    n[at], p[at] = rows["n"].to_numpy(dtype=float), rows["p"].to_numpy(dtype=float)
    return n, p


def _sample(train: DataFrame, buckets: np.ndarray, shares: tuple[float, float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Selected features of sampled documents: unlabelled ones and positives."""
    draw = _draw("sample")
    drawn = train.select(
        "_text", (F.col("_positive") & (draw < shares[1])).alias("_positive"), (draw < shares[0]).alias("_u")
    ).where("_u OR _positive")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.full(BUCKETS, -1, dtype=np.int32)
        lookup[buckets] = np.arange(len(buckets))
        for batch in batches:
            rows: list[bytes] = []
            for a, b, found in features(batch.column(0)):
                at = lookup[found & (BUCKETS - 1)]
                ends = np.searchsorted(found >> 20, np.arange(1, b - a))
                rows += [x[x >= 0].astype(np.int32).tobytes() for x in np.split(at, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["at", "positive", "unlabelled"])

    rows = drawn.select("_text", "_positive", "_u").mapInArrow(select, "at binary, positive boolean, unlabelled boolean").collect()
    arrays = sorted((bytes(r["at"]), r["positive"], r["unlabelled"]) for r in rows)
    return (
        [np.frombuffer(x, np.int32) for x, _, u in arrays if u],
        [np.frombuffer(x, np.int32) for x, p, _ in arrays if p],
    )


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def nn_pu(unlabelled: list[np.ndarray], positive: list[np.ndarray], scale: np.ndarray, prior: float, *, epochs: int = 120, batches: int = 8, rate: float = 0.05, l2: float = 3e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk by Adam over mini-batches; returns weights and bias.

    ``scale`` is the value of each input where it is present: inputs of little evidence count less.
    """
    size = len(scale)
    w = np.zeros(size + 1)
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(seed)

    def margin(at: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(doc, (w[:size] * scale)[at], minlength=n) + w[size]

    def gradient(at: np.ndarray, doc: np.ndarray, slope: np.ndarray) -> np.ndarray:
        out = np.bincount(at, slope[doc] * scale[at], minlength=size + 1).astype(float)  # no entry: integers
        out[size] = slope.sum()
        return out

    for _ in range(epochs):
        u_order, p_order = rng.permutation(len(unlabelled)), rng.permutation(len(positive))
        for k in range(batches):
            u, p = [unlabelled[i] for i in u_order[k::batches]], [positive[i] for i in p_order[k::batches]]
            if not u or not p:
                continue
            (ua, ud), (pa_, pd_) = _flat(u), _flat(p)
            gu, gp = margin(ua, ud, len(u)), margin(pa_, pd_, len(p))
            su, sp = 1 / (1 + np.exp(-gu)), 1 / (1 + np.exp(-gp))
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            slope = gradient(ua, ud, su / len(u)) - gradient(pa_, pd_, prior * sp / len(p))
            if negative >= 0:
                slope = slope + gradient(pa_, pd_, prior * (sp - 1) / len(p))
            else:
                slope = -slope
            slope[:size] += l2 * w[:size]
            step += 1
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size] * scale, float(w[size])


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", *, selected: int = SELECTED, most: int = MOST, confirmed: int = CONFIRMED) -> ToxicityModel:
    """Learn from all rows of ``docs``; rows of ``labels`` with ``label`` = 1 confirm positives.

    Only ids are joined by a shuffle. Texts meet the ids of at most about ``confirmed`` positives, drawn by
    their hash, which are broadcast.
    """
    marks = stored(labels.select(labels[ident].alias("_id"), (labels[label] == 1).alias("_mark")).dropna().groupBy("_id").agg(F.max("_mark").alias("_mark")), "marks")
    texts = docs.select(docs[ident].alias("_id"), docs[text].alias("_text")).where("_id IS NOT NULL")
    known = texts.select("_id").join(marks, "_id").agg(F.count("*").alias("n"), F.count_if("_mark").alias("p")).first()
    if not known["p"]:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -500.0)
    ids = marks.where("_mark").select("_id")
    share = confirmed / max(ids.count(), 1)
    if share < 1:
        ids = ids.where(_draw("confirmed") < share)
    positive = stored(ids, "confirmed").withColumn("_positive", F.lit(True))
    train = texts.join(F.broadcast(positive), "_id", "left").withColumn("_positive", F.coalesce("_positive", F.lit(False)))
    n, p = _bucket_counts(train)
    documents, positives = n[-1], p[-1]
    if not positives:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -500.0)
    expected = n[:-1] / documents * positives
    typical = (p[:-1] - expected) / np.sqrt(expected + 1)
    best = np.argsort(-typical, kind="stable")[:selected]
    # By rank: a fixed threshold would learn nothing from a small table. Weak ones weigh little by ``scale``.
    buckets = np.sort(best[typical[best] > 0])
    unlabelled, positive = _sample(train, buckets, (min(1.0, most / documents), min(1.0, most / positives)))
    scale = typical[buckets] / (typical[buckets] + 10)
    weights, bias = nn_pu(unlabelled, positive, scale, known["p"] / known["n"])
    return ToxicityModel(buckets, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` for every row of ``docs``."""
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SELECTED weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(scores)], names=[*keep, "score"])

    chosen = docs.select(*[docs[k] for k in keep], docs[text].alias("_text"))
    return chosen.mapInArrow(judge, ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "score double"]))


def held_out(ident: str = "doc_id"):
    """crc32 of the id modulo 5 is 0; null ids count as held out."""
    return F.coalesce(fold(F.col(ident), 5) == 0, F.lit(True))
