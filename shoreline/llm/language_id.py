"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased, everything but letters counts as one kind of gap, and n-grams of 1 to
3 characters are hashed into ``DIMENSIONS`` buckets. Document frequencies are counted over all
training documents. Weights are fitted by follow-the-regularised-leader (per-coordinate rates,
elastic-net penalty, so unused weights are exactly zero) on a bounded sample, ``per_label``
documents of each language in expectation; a fifth of the sample, unseen by the fit, sets the
temperature of the probabilities.

``und`` with score 0 is predicted for null texts and texts without a letter. A language is learned
only where it occurs; without any training document everything is ``und``. Null ids are never
learned from. Extra columns are ignored, repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.tables import bounded_batches, fold
from shoreline.llm.text import mix, slices

DIMENSIONS = 1 << 15
ORDERS = 3
PER_LABEL = 1500
_GROUP = 32  # documents counted together: 32 x DIMENSIONS counters
_TABLE = 0x3000
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """Lower-cased code point of letters below ``_TABLE``, 1 for all others."""
    out = np.ones(_TABLE, dtype=np.uint32)
    for c in range(_TABLE):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LOWER = _letters()


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with gaps as 1, and the documents' offsets into them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    low = points < _TABLE
    out = points.copy()
    out[low] = _LOWER[points[low]]
    if not low.all():
        others = ~low
        out[others] = [c if chr(c).isalpha() else 1 for c in points[others].tolist()]
    return out, leads[offsets]


def counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, counts by bucket, whether it has a letter)."""
    points, starts = _characters(data, offsets)
    grams = []
    h = np.zeros(len(points), dtype=np.uint64)
    wide = points.astype(np.uint64) + np.uint64(1)
    for order in range(ORDERS):
        h = (h[:-1] if order else h) * np.uint64(1_000_003) + wide[order:]
        grams.append((mix(h * np.uint64(ORDERS) + np.uint64(order)) >> np.uint64(49)).astype(np.int64))
    lettered = np.concatenate([[0], np.cumsum(points > 1)])
    documents = len(starts) - 1
    for a in range(0, documents, _GROUP):
        b = min(a + _GROUP, documents)
        size = (b - a) * DIMENSIONS
        table = np.zeros(size, dtype=np.int32)
        for order, buckets in enumerate(grams):
            lengths = np.maximum(np.diff(starts[a : b + 1]) - order, 0)
            part = buckets[starts[a] : max(starts[a], starts[b] - order)]
            doc = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))[: len(part)]
            place = np.arange(starts[a], starts[a] + len(part))
            whole = place < starts[a:b][doc] + lengths[doc]
            table += np.bincount(part[whole] + doc[whole] * DIMENSIONS, minlength=size).astype(np.int32)
        yield a, b, table.reshape(b - a, DIMENSIONS), lettered[starts[a + 1 : b + 1]] > lettered[starts[a:b]]


def weighted(table: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length."""
    out = np.zeros(table.shape, dtype=np.float32)
    at = np.nonzero(table)
    out[at] = (1 + np.log(table[at])) * idf[at[1]]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.maximum(norm, 1e-12)[:, None]


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMENSIONS x labels
    bias: np.ndarray
    temperature: float

    def probabilities(self, table: np.ndarray) -> np.ndarray:
        return softmax((weighted(table, self.idf) @ self.weights + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader over sparse rows, one weight vector per class."""

    def __init__(self, classes: int, *, rate: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z = np.zeros((DIMENSIONS + 1, classes))
        self.n = np.zeros((DIMENSIONS + 1, classes))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def at(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        free = np.abs(z) > self.l1
        return np.where(free, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2), 0.0)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.at(rows)
        error = softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[rows] = n + g * g


def _document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Over all training documents: how many hold each bucket, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                for _, _, table, lettered in counts(data, offsets):
                    held[:-1] += (table > 0).sum(axis=0)
                    n += len(lettered)
        held[-1] = n
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["bucket", "n"])

    rows = train.select("_text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    held[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return held[:-1], int(held[-1])


def _sample(train: DataFrame, per_label: int) -> list[tuple[str, bytes, bytes]]:
    """About ``per_label`` documents of every language: label, buckets and counts."""
    sizes = {r["_label"]: r["n"] for r in train.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_label / n))])
    drawn = train.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share[F.col("_label")] * float(1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, many = batch.column(0).to_pylist(), [], []
            for _, _, data, offsets in slices(batch.column(1)):
                for _, _, table, _ in counts(data, offsets):
                    for row in table:
                        at = np.flatnonzero(row)
                        found.append(at.astype(np.int32).tobytes())
                        many.append(row[at].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(many, pa.binary())], names=["label", "at", "n"])

    rows = drawn.select("_label", "_text").mapInArrow(features, "label string, at binary, n binary").collect()
    return sorted((r["label"], bytes(r["at"]), bytes(r["n"])) for r in rows)


def fit(docs: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "lang", *, per_label: int = PER_LABEL, epochs: int = 2, seed: int = 3) -> LanguageModel:
    """Learn from the rows of ``docs`` that have an id, a text and a label."""
    bounded_batches(docs.sparkSession)
    train = docs.select(docs[ident].alias("_id"), docs[text].alias("_text"), docs[label].alias("_label")).dropna()
    held, total = _document_frequencies(train)
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)
    sample = _sample(train, per_label)
    labels = sorted({name for name, _, _ in sample})
    rows = []
    for name, at, n in sample:
        buckets, times = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        values = (1 + np.log(times)) * idf[buckets]
        values = values / max(np.sqrt((values**2).sum()), 1e-12)
        rows.append((np.append(buckets, DIMENSIONS), np.append(values, 1.0), labels.index(name)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held_back, used = order[: len(order) // 5], order[len(order) // 5 :]
    solver = Ftrl(max(len(labels), 1))
    for _ in range(epochs):
        for i in rng.permutation(used):
            solver.learn(*rows[i])
    w = solver.at(slice(None))
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held_back]).reshape(len(held_back), w.shape[1])
    truth = np.array([rows[i][2] for i in held_back], dtype=int)
    return LanguageModel(labels, idf, w[:-1].astype(np.float32), w[-1].astype(np.float32), _temperature(logits, truth))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss on held-back documents, within 0.2 to 20."""
    if not len(truth):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())

    return float(min(np.geomspace(0.2, 20, 121), key=loss))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x languages numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            names, scores = [], np.zeros(batch.num_rows)
            for first, _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                for a, b, table, lettered in counts(data, offsets):
                    lettered = lettered & bool(fitted.labels)
                    p = fitted.probabilities(table)
                    best = p.argmax(axis=1)
                    names += [fitted.labels[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)]
                    scores[first + a : first + b] = np.where(lettered, p.max(axis=1), 0.0)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    chosen = docs.select(*[docs[k] for k in keep], docs[text].alias("_text"))
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "lang_pred string, score double"])
    return chosen.mapInArrow(judge, schema)


def held_out(ident: str = "doc_id"):
    """crc32 of the id modulo 4 is 2; null ids count as held out."""
    return F.coalesce(fold(F.col(ident), 4) == 2, F.lit(True))
