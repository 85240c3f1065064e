"""The divergence audit on odd rows against a plain version; its SQL is compared in test_llm."""

import collections
import re

import pytest

from shoreline.llm import divergence

DOCS = "doc_id bigint, text string, lang string, source string, value bigint, item string"
ROWS = [
    (1, "Alpha beta beta, ÄRGER ärger", "en", "a", 1, "x"),
    (2, "alpha gamma x1y", "en", "b", 1, "x"),
    (2, "alpha gamma x1y", "en", "b", 1, "x"),
    (3, None, "en", "c", None, None),
    (4, "123 !!", "en", None, 1, "x"),
    (5, "", None, "a", 1, "x"),
    (6, "solo word", None, None, 1, "x"),
    (None, "tie tie two two", "\x00odd", "é", 1, "x"),
    (7, "two tie", "\x00odd", "z", 1, "x"),
    (8, "word " * 50_000, "fr", "a", 1, "x"),
    (9, "!", "xx", "a", 1, "x"),
    (10, "?", "xx", "b", 1, "x"),
]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_df, top):
    counts, df, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        counts[g].update(terms)
        df.update((g[0], t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (other, t), n in df.items() if other == lang and n >= min_df]
        mine = {s: counts[lang, s] for other, s in groups if other == lang}
        every = sum(mine.values(), collections.Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in mine.items()}, shares(every)
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("min_df, top, cells", [(1, 50, 1 << 20), (2, 1, 1 << 20), (1, 2, 1), (12, 50, 1 << 20), (13, 50, 1 << 20)])
def test_odd_rows(spark, monkeypatch, min_df, top, cells):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    found = divergence.divergence(spark.createDataFrame(ROWS, DOCS), min_df=min_df, top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(ROWS, min_df, top)


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
