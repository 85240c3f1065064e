"""Packing against the tokenizers library, a plain bin-by-bin version and the lower bound."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.llm import packing
from shoreline.llm.queries import BYTE_TOKENIZER, op12_packing
from shoreline.llm.tables import table

SF = "/root/testdata/sf0.001"


def checked(rows, size):
    """The sequences are gapless from 0 and hold ``size`` ids at most; returns their number."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length >= 1
            at += length
        assert at <= size
    return len(held)


def test_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_TOKENIZER)
    rows = op12_packing(spark, SF).collect()
    total = sum(r["length"] for r in rows)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for r in table(spark, SF, "documents").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, part in enumerate(np.split(ids, range(first, len(ids), 1024))):
            want[r["doc_id"], k] = (first + 1024 * (k - 1) if k else 0, len(part), zlib.crc32(part.tobytes()))
    assert got == want and len(rows) == len(want)
    assert checked(rows, 1024) <= 1.02 * -(-total // 1024)


def plain_sequences(histogram, size):
    """One sequence after the other, the fullest combination found by trying all."""
    left, made = dict(histogram), []
    while any(left.values()):
        top = max(n for n, c in left.items() if c)
        rest = [n for n in sorted(left, reverse=True) for _ in range(left[n] - (n == top))]
        best = [()]

        def search(i, chosen, total):
            if total > sum(best[0]) or (total == sum(best[0]) and chosen > best[0]):
                best[0] = chosen
            for k in range(i, len(rest)):
                if (k == i or rest[k] != rest[k - 1]) and total + rest[k] <= size - top:
                    search(k + 1, (*chosen, rest[k]), total + rest[k])

        search(0, (), 0)
        made.append(tuple(sorted((top, *best[0]), reverse=True)))
        for n in made[-1]:
            left[n] -= 1
    return collections.Counter(made)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_bin_by_bin(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 21), 6, replace=False), rng.integers(1, 6, 6))}
    got = collections.Counter()
    for times, chosen in packing.minimum_bin_slack(histogram, 20):
        got[tuple(n for n, copies in chosen for _ in range(copies))] += times
    assert got == plain_sequences(histogram, 20)


def test_plan_does_not_grow_with_the_counts():
    small = packing.minimum_bin_slack({n: 3 for n in range(1, 1025)})
    large = packing.minimum_bin_slack({n: 3 * 10**9 for n in range(1, 1025)})
    assert len(large) <= 7200 and len(small) <= 7200
    assert sum(t for t, _ in large) >= sum(n for n in range(1, 1025)) * 3 * 10**9 // 1024


def test_odd_rows(spark):
    rows = [(1, "a b " * 40, "x", 1), (1, "a b " * 40, "x", 1), (None, None, None, None), (2, None, "x", 1), (3, "", "x", 1), (None, "word", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, length int")
    pieces = packing.token_pieces(docs, BYTE_TOKENIZER, size=16)
    packed = packing.pack(pieces, 16)
    found = packed.collect()
    assert collections.Counter(r["doc_id"] for r in found if r["piece"] == 0) == {1: 2, None: 2, 2: 1, 3: 1}
    assert {r["length"] for r in found if r["doc_id"] in (2, 3)} == {1}
    long = sorted((r["piece"], r["start"], r["length"]) for r in found if r["doc_id"] == 1)
    assert long[0][2] == long[1][2] <= 16 and {n for k, _, n in long if k} == {16}
    checked(found, 16)
    whole = packing.sequences(packed).collect()
    assert all(2 * r["n_tokens"] == len(r["ids"]) for r in whole)
    assert collections.Counter(b for r in whole for b in np.frombuffer(r["ids"], "<u2").tolist())[2] == len(rows)
    none = packing.pack(packing.token_pieces(docs.where("doc_id < 0"), BYTE_TOKENIZER))
    assert none.count() == 0 and none.columns == packed.columns


@pytest.mark.parametrize("text", ["Don't it's WE'LL  ok", "x²y ½ ªº", "é İ Σς", "<|endoftext|> a\n\n<|endoftext|>", "a\x1cb\x85c\xa0d  \xa0\n e!\x1c z", "日本語 текст  \n\n x", "ÀÉß×÷¡¿ 12,3!!", "", "  \n\tA b  ", "\n\n\n b's 'S"])
def test_encoder_is_exact(text, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "_PART", 7)
    monkeypatch.setattr(packing, "CACHED", 3)
    encoder = packing.Encoder(BYTE_TOKENIZER)
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == Tokenizer.from_file(BYTE_TOKENIZER).encode(text, add_special_tokens=False).ids


def test_token_records_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, clashing names, an empty table, reads in random order."""
    from tokenizers import Tokenizer

    from shoreline.llm import token_records
    from shoreline.llm.queries import TOKENIZER

    rows = [(2, "b text", "x", 1), (2, "a text", "x", 1), (2, "b text", "x", 1), (None, None, None, None), (None, "no id", "x", 1), (1, "", "x", 1), (3, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, offset int")
    folder = f"file://{tmp_path}/odd"
    index = token_records.write_records(docs, folder, TOKENIZER)
    records = token_records.starts(token_records.read_records(index, folder), index).orderBy("start").collect()
    library = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((k, *library.encode(t or "", add_special_tokens=False).ids, 1) for k, t, *_ in rows)
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in records) == want
    assert [r["doc_id"] for r in records] == [None, None, 1, 2, 2, 2, 3]
    assert [r["start"] for r in records] == np.cumsum([0, *(r["n_tokens"] for r in records[:-1])]).tolist()
    shuffled = index.orderBy(F.rand(3)).repartition(3)
    again = token_records.read_records(shuffled, folder).collect()
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in again) == want
    none = token_records.write_records(docs.where("doc_id < 0"), f"file://{tmp_path}/none", TOKENIZER)
    assert none.count() == 0 and token_records.read_records(none, f"file://{tmp_path}/none").count() == 0
