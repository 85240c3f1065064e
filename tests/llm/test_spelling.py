"""Spelling variants: near words against brute force at several dictionary sizes, odd rows, long paths."""

import itertools
import random
import zlib

import numpy as np
import pytest

from shoreline.llm import spelling

DOCS = "doc_id bigint, text string, word string, n int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed):
    """Words of few syllables, so that grams are frequent and edits hit all places."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(["an", "ti", "th", "e", "é", "on", "aa"]) for _ in range(rng.randint(3, 6))) for _ in range(150)}
    for w in sorted(words)[:80]:
        i = rng.randrange(len(w) + 1)
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("aentix") + w[i:], w[:i] + rng.choice("aentix") + w[i + 1 :]}
    return sorted(w for w in words if len(w) >= 5)


@pytest.mark.parametrize("frequent, limit", [(0, 10**6), (2, 10**6), (20, 10**6), (10**6, 1), (0, 200)])
def test_near_words(spark, frequent, limit):
    words = vocabulary(frequent)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")
    found = [(r["a"], r["b"]) for r in spelling.near_words(table, limit=limit, frequent=frequent).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    assert {frozenset(p) for p in found} == want and len(found) == len(want)


@pytest.mark.parametrize("frequent", [0, 3, 30])
def test_bound_holds_for_every_edit(frequent):
    """An edit leaves all grams but ``affected`` of them, and one list at least is shared."""
    words = vocabulary(7)
    counts = {}
    for w in words:
        marked = f"{spelling.FIRST}{w}{spelling.LAST}"
        for q in range(2, 6):
            for p in range(len(marked) - q + 1):
                counts[marked[p : p + q]] = counts.get(marked[p : p + q], 0) + 1
    dictionary = {g: n for g, n in counts.items() if n > frequent}
    for w in words[:60]:
        grams = spelling.decompose(w, dictionary)
        bound = spelling.affected(grams)
        assert bound < len(grams)
        for i in range(len(w) + 1):
            for other in {w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :]} - {w}:
                if len(other) < 5:
                    continue
                left = list(spelling.decompose(other, dictionary))
                kept = sum(1 for g in grams if g in left and (left.remove(g) or True))
                assert kept >= len(grams) - bound
                assert set(spelling.lists(w, dictionary)) & set(spelling.lists(other, dictionary))


def test_slip(spark):
    runs = [(i, r) for i in range(300) for r in ("straße", "abcdefg", "élan")]
    table = spark.createDataFrame(runs, "i int, r string")
    found = table.select("i", "r", spelling.slipped(table["i"], table["r"]).alias("s")).collect()
    changed = 0
    for i, r, s in found:
        h = zlib.crc32(f"{i}:{r}".encode())
        assert s == (r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r)
        changed += s != r
    assert changed


def test_odd_rows(spark):
    text = "Largest largest LARGEST largests largests largests ÉTUDE Étude étude"
    rows = [(1, text, "x", 1), (1, text, "x", 1), (None, text, None, None), (2, None, "x", 1), (3, "", "x", 1), (4, "12 !! abcd " * 20_000 + "etude" * 3000, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["word"]: tuple(r) for r in spelling.spelling_variants(docs, every=10**9).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    # Only A-Z is lower-cased: É stays.
    assert found == {
        "largest": ("largest", None, "largest", 9, 1, None),
        "largests": ("largests", None, "largests", 9, 1, None),
        "étude": ("étude", "Étude", "Étude", 3, 1, 6),
        "Étude": ("Étude", None, "Étude", 6, 1, None),
    }
    none = spelling.spelling_variants(docs.where("doc_id < 0"))
    assert none.count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, shortest=4)


def test_forms_ties_and_roots(spark):
    counts = {"aaaaa": 100, "aaaab": 40, "aaabb": 20, "aabbb": 9, "aaaac": 100, "abbbb": 4, "zzzzz": 3, "aaaaad": 50}
    rows = [(i, " ".join([w] * n), "x", 1) for i, (w, n) in enumerate(counts.items())]
    found = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(rows, DOCS), every=10**9).collect()}
    assert {w: (r["form"], r["form_n"], r["root"]) for w, r in found.items()} == {
        "aaaaa": (None, None, "aaaaa"),
        "aaaac": (None, None, "aaaac"),
        "aaaab": ("aaaaa", 100, "aaaaa"),
        "aaabb": ("aaaab", 40, "aaaaa"),
        "aabbb": ("aaabb", 20, "aaaaa"),
        "abbbb": ("aabbb", 9, "aaaaa"),
        "aaaaad": ("aaaaa", 100, "aaaaa"),
        "zzzzz": (None, None, "zzzzz"),
    }
    assert found["aaaab"]["n_near"] == 3  # aaaaa, aaaac, aaabb


def test_left_out_hashes():
    words = ["straße", "aab", "x", "日本語のテキスト", "a\U0001f600b"]
    whole, owner, place, left_out, first = spelling._hashes(words)
    for k in range(len(owner)):
        w = words[owner[k]]
        short = w[: place[k]] + w[place[k] + 1 :]
        if short:
            assert spelling._hashes([short])[0][0] == left_out[k]
        else:
            assert left_out[k] == np.uint64(0)
    assert len(set(whole.tolist())) == len(words) and first.tolist()[6:9] == [True, False, True]
