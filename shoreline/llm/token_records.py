"""Token ids as length-delimited binary records with a separate offset index.

File format, one record per document in ascending id order:
    8 bytes  payload length, little-endian
    4 bytes  masked checksum of these 8 bytes
    payload  one byte w (2 or 4), then every id as w bytes, little-endian
    4 bytes  masked checksum of the payload
The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data that
holds checksums stays useful. The index is a Parquet table with one row per record: part, file,
offset, payload length, number of ids, and ids before it in its part. Parts follow each other in id
order, so records can be read in any order, each with one seek.

A task writes files of its own names and returns their index rows; only rows of tasks that
succeeded reach the index, so a repeated or lost task leaves at most an unlisted file.

Null text counts as empty and holds the end id only. Null ids come first; rows that repeat an id
are records of their own, in the order of their texts' hashes. An empty table gives no file. Other columns are
ignored, so their names can't clash.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoreline.llm.pieces import PieceEncoder
from shoreline.llm.tables import bounded_batches

MASK = 0xA282EAD8
FILE_BYTES = 64 << 20
CACHED = 100_000  # different pieces in either generation of a worker's cache, some 20 MB
_TEXTS = 64  # texts taken out of a batch at once
_PART = 1 << 20  # characters of a text encoded at once
_FRAME = struct.Struct("<QI")
# With these characters no normalisation but lower-casing takes place, and words end where letters do.
_PLAIN = re.compile(r"[\t-\r !-&(-;=-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\t-\r ]+")
_CHUNK = re.compile(r"[^\t-\r ]+")
_GAP = re.compile(r"[\t-\r ]")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``folder``; Hadoop writes local folders with one slash, file:/x."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole record; raises if anything was changed."""
    length, check = _FRAME.unpack_from(data)
    payload = data[12 : 12 + length]
    if check != masked(data[:8]) or len(data) != 16 + length or struct.unpack_from("<I", data, 12 + length)[0] != masked(payload):
        raise ValueError("record is damaged")
    return payload


class Encoder(PieceEncoder):
    """Encodes texts with a tokenizer file that drops white space and works word by word.

    Texts of plain Latin letters, digits and signs are cut exactly where the tokenizer itself cuts, so
    its model alone encodes the pieces, each different one once while it stays in the cache. Other
    chunks between ASCII white space go through the whole tokenizer, also once each.
    """

    def __init__(self, path: str):
        super().__init__(path, _PLAIN)
        self.kind = np.dtype(f"<u{self.width}")

    def encode(self, texts: list[bytes], end: bytes) -> Iterator[bytes]:
        """The ids of every text followed by ``end``."""
        for text in texts:
            yield b"".join([*map(self._encode_part, _parts(text.decode("utf-8"))), end])

    def _encode_part(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text):
            return self.joined(_PIECE.findall(text.lower()), CACHED)
        return self.joined([p for c in _CHUNK.findall(text) for p in (_PIECE.findall(c.lower()) if _PLAIN.fullmatch(c) else (c,))], CACHED)


def _parts(text: str) -> Iterator[str]:
    """The text cut at ASCII white space into parts of about ``_PART`` characters, or more within a word."""
    at = 0
    while len(text) - at > _PART:
        gap = _GAP.search(text, at + _PART)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One tokenizer and one cache per Python worker, kept from task to task."""
    return Encoder(path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Write all of ``docs`` below ``folder``, which all executors can reach; returns the index."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        mark = bytes([encoder.width])
        store, root = _store(folder)
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        store.create_dir(f"{root}/records", recursive=True)
        out, name, offset, before, made = None, "", 0, 0, 0
        for batch in batches:
            rows = []
            held = batch.column(1).cast(pa.binary())
            parts = (held.slice(a, _TEXTS).to_pylist() for a in range(0, len(held), _TEXTS))
            for ids in (i for part in parts for i in encoder.encode([t or b"" for t in part], end)):
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset, made = f"part-{part:06d}-{made:04d}-{own}.rec", 0, made + 1
                    out = store.open_output_stream(f"{root}/records/{name}")
                data = frame(mark + ids)
                out.write(data)
                n = len(ids) // encoder.width
                rows.append((part, name, offset, len(data) - 16, n, before))
                offset, before = offset + len(data), before + n
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, "part", "file", "offset", "length", "n_tokens", "before"])
        if out is not None:
            out.close()

    # The bounds of the ranges pass the driver: they hold hashes of texts, not texts.
    place = [F.col(key), F.xxhash64("_text")]
    ordered = docs.select(docs[key], docs[text].alias("_text")).repartitionByRange(*place).sortWithinPartitions(*place, "_text")
    schema = f"`{key}` {kind}, part int, file string, offset bigint, length bigint, n_tokens bigint, before bigint"
    ordered.mapInArrow(write, schema).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, *, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """The records that ``index`` lists, checked: ``key, part, before, n_tokens, ids_crc32`` and ``ids``.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers. Rows may come in any order.
    """
    kind = dict(index.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        name, file = "", None
        for batch in batches:
            counts, crcs, lists = [], [], []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, store.open_input_file(f"{root}/records/{path}")
                payload = unframe(file.read_at(length + 16, offset))
                found = np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")
                counts.append(len(found))
                crcs.append(zlib.crc32(found.tobytes()))
                if ids:
                    lists.append(found.astype(np.int32))
            columns = [*(batch.column(i) for i in range(3)), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
            names = [key, "part", "before", "n_tokens", "ids_crc32"]
            if ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if file is not None:
            file.close()

    schema = f"`{key}` {kind}, part int, before bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return index.select(key, "part", "before", "file", "offset", "length").mapInArrow(read, schema)


def starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all records before it. One row per part is summed in order."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return records.join(bases, "part").withColumn("start", F.col("_base") + F.col("before")).drop("_base")
