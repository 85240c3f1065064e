"""Best-fit packing of token sequences by minimum bin slack.

Documents become token pieces of at most ``size`` ids: only longer documents are cut, into pieces of
``size`` ids with the shorter piece first. What fits together depends on the lengths alone, so the plan is made
on the histogram of lengths, which has ``size`` entries at any input. The longest piece left opens
a sequence, so that long ones never pile up; a subset-sum dynamic program over bitsets finds the combination of
the lengths that are still available which fills the rest most (of equally full ones that of the longest
pieces), and both are removed. A combination stays the best one while its lengths last, so it is taken as often as they do: the plan equals the one made sequence by sequence,
but has some thousand entries at most (each use-up of a length ends one).

Pieces are dealt to the plan by their rank among the pieces of their length. Every task numbers its own
pieces of a length while it encodes them; one row per task and length carries the counts forward. Neither
texts nor ids are sorted or shuffled, and no length is a hot key.

Null and empty texts hold the end id only. Null ids and rows that repeat an id are documents of their own.
Equal lengths are interchangeable; their order follows the stored rows. An empty table gives no rows. Other
columns are ignored, so their names can't clash.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.pieces import PieceEncoder
from shoreline.llm.tables import bounded_batches
from shoreline.plans.materialize import stored
from shoreline.plans.sizing import broadcast_if_small

SIZE = 1024
CACHED = 100_000  # different pieces in either generation of a worker's cache, some 20 MB
_TEXTS = 64  # texts taken out of a batch at once
_PART = 1 << 20  # characters of a text encoded at once
_ROWS = 4096  # pieces returned at once
# White space of the tokenizer's pattern; a piece never goes on from other signs into white space.
_S = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
_CUT = re.compile(f"[^{_S}](?=[{_S}])")
# Without "<" no special token can occur; the letters and digits of these signs are those of the pattern.
_PLAIN = re.compile(r"[\t-\r -;=-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Encoder(PieceEncoder):
    """Encodes texts with a byte-level BPE tokenizer file, each different piece once while it is cached.

    Text of plain Latin letters, digits and signs is cut where the tokenizer's own pattern cuts, so its
    model alone encodes the pieces; other chunks between white space go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__(path, _PLAIN)

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, little-endian."""
        return b"".join(map(self._encode_part, _parts(text)))

    def _encode_part(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return self.joined(_PIECE.findall(text), CACHED)
        return self.joined([p for c in _CHUNK.findall(text) for p in (_PIECE.findall(c) if _PLAIN.fullmatch(c) else (c,))], CACHED)


def _parts(text: str) -> Iterator[str]:
    """The text cut before white space into parts of about ``_PART`` characters, or more within a word."""
    at = 0
    while len(text) - at > _PART:
        gap = _CUT.search(text, at + _PART)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One tokenizer and one cache per Python worker, kept from task to task."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = 2) -> DataFrame:
    """All of ``docs`` as pieces of at most ``size`` ids, in a stored table.

    ``key, piece, start, length, ids_crc32, ids`` and the place of the piece among those of its length in its
    task, ``_task, _nth``. ``ids`` are little-endian 16-bit integers, 32-bit for large vocabularies;
    ``ids_crc32`` is over 32-bit ones.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width, kind_of_id = encoder.width, f"<u{encoder.width}"
        end = encoder.pack([end_id])
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        names = [key, "piece", "start", "length", "ids_crc32", "ids", "_task", "_nth"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

        def batch_of(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 8
            at, *rest = columns
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=names)

        for batch in batches:
            keys, texts, rows = batch.column(0), batch.column(1), []
            for low in range(0, batch.num_rows, _TEXTS):
                for i, value in enumerate(texts.slice(low, _TEXTS).to_pylist(), low):
                    ids = encoder.encode(value or "") + end
                    n = len(ids) // width
                    start, stop = 0, n % size or size
                    for piece in range(-(-n // size)):
                        part = ids[start * width : stop * width]
                        crc = zlib.crc32(np.frombuffer(part, kind_of_id).astype("<u4").tobytes())
                        rows.append((i, piece, start, stop - start, crc, part, task, int(seen[stop - start])))
                        seen[stop - start] += 1
                        start, stop = stop, stop + size
                        if len(rows) >= _ROWS:
                            yield batch_of(keys, rows)
                            rows = []
            yield batch_of(keys, rows)

    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, _task int, _nth bigint"
    return stored(docs.select(docs[key], docs[text].alias("_text")).mapInArrow(encode, schema), "pieces")


def fullest(available: dict[int, int], size: int) -> list[tuple[int, int]]:
    """The longest length and what fills up its sequence most, as (length, copies), longest first.

    ``available`` counts the pieces by length, ascending.
    """
    counts = list(available.items())
    longest, held = counts[-1]
    counts[-1] = (longest, held - 1)
    room = size - longest
    mask, reached, before = (1 << (room + 1)) - 1, 1, []
    for length, count in counts:
        before.append(reached)  # sums of shorter ones
        left, step = min(count, room // length), 1
        while left > 0:
            step = min(step, left)
            reached |= (reached << (step * length)) & mask
            left, step = left - step, step * 2
    total, chosen = reached.bit_length() - 1, {longest: 1}
    for (length, count), sums in zip(reversed(counts), reversed(before)):
        for copies in range(min(count, total // length), 0, -1):
            if sums >> (total - copies * length) & 1:
                chosen[length] = chosen.get(length, 0) + copies
                total -= copies * length
                break
    return list(chosen.items())


def minimum_bin_slack(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations of lengths and how many sequences use each, until no piece is left."""
    left = {length: count for length, count in sorted(histogram.items()) if count}
    plan = []
    while left:
        chosen = fullest(left, size)
        times = min(left[length] // copies for length, copies in chosen)
        plan.append((times, chosen))
        for length, copies in chosen:
            left[length] -= times * copies
            if not left[length]:
                del left[length]
    return plan


@dataclass
class Slots:
    """Where the pieces of every length go, by rank: one entry per combination and length."""

    first: np.ndarray  # length * _RANKS + first rank, ascending
    rank: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.first, length * _RANKS + rank, "right") - 1
        turn = rank - self.rank[at]
        return self.sequence[at] + turn // self.copies[at], self.offset[at] + turn % self.copies[at] * length


_RANKS = 1 << 50


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> Slots:
    rows, used, sequence = [], {}, 0
    for times, chosen in plan:
        offset = 0
        for length, copies in chosen:
            rank = used.get(length, 0)
            rows.append((length * _RANKS + rank, rank, sequence, copies, offset))
            used[length] = rank + times * copies
            offset += copies * length
        sequence += times
    return Slots(*np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T.copy())


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (as by ``token_pieces``) with ``sequence_id`` from 0 and the gapless ``offset`` there."""
    counts = stored(pieces.groupBy("_task", "length").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # ``size`` rows at most
    where = pieces.sparkSession.sparkContext.broadcast(slots(minimum_bin_slack(histogram, size)))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = where.value.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_task", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = pieces.join(broadcast_if_small(stored(bases, "bases")), ["_task", "length"])
    placed = ranked.withColumn("_place", place("length", F.col("_base") + F.col("_nth")))
    columns = [c for c in pieces.columns if c not in ("_task", "_nth")]
    return placed.select(*columns, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids`` and the ``offsets`` where pieces begin."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("_parts", F.lit(bytearray()).cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"), F.col("_parts.offset").alias("offsets"))
