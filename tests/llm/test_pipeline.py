"""The pipeline through run(): the written rows of every stage against plain versions."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shoreline.llm import language_id, minhash, mixing
from shoreline.llm.queries import TOKENIZER
from shoreline.llm.tables import table

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(spark, monkeypatch, folder, sf):
    """The rows of documents and of every stage of run()."""
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: folder)
    result = corpus_pipeline.run(spark, sf)
    (run,) = [p for p in __import__("pathlib").Path(folder.removeprefix("file://")).iterdir() if p.name.startswith("pipeline-")]
    stages = [spark.read.parquet(f"file://{run}/stage-{i}") for i in range(len(corpus_pipeline.STAGES))]
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(map(tuple, stages[-1].collect()), key=repr)
    return [table(spark, sf, "documents"), *stages]


def test_stage_by_stage(spark, monkeypatch, tmp_path):
    frames = written(spark, monkeypatch, f"file://{tmp_path}", SF)
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    docs, named, single, clean, mix, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    by_id = lambda rows: sorted(r["doc_id"] for r in rows)

    # Language ID: who stays follows from the model's predictions.
    model = language_id.fit(frames[0].where(~language_id.held_out()))
    found = language_id.predict(frames[0], model).collect()
    assert by_id(named) == sorted(r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE)
    assert len(named) >= 0.9 * len(docs)

    # Near duplicates: one of every group of a full comparison.
    rows = sorted((r["doc_id"], r["text"]) for r in named)
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in minhash._elements(pa.array([t for _, t in rows]))]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    assert by_id(single) == sorted({rows[t][0] for t in top})

    # Decontamination: no text with a window of ten benchmark words.
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    windows = collections.defaultdict(set)
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        n = min(len(w), 10)
        windows[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    hit = lambda w: any(tuple(w[i : i + n]) in of for n, of in windows.items() if n for i in range(len(w) - n + 1))
    assert by_id(clean) == sorted(r["doc_id"] for r in single if not hit(words(r["text"])))

    # Mixing: every document as often as systematic sampling says, texts unchanged.
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(frames[3]).collect()}
    assert collections.Counter(r["doc_id"] for r in mix) == collections.Counter({d: n for d, n in copies.items() if n})
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert all(texts[r["doc_id"]] == r["text"] for r in mix)

    # Token records: the library's ids, gapless in order of the ids.
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(TOKENIZER), 0
    want = collections.Counter()
    for r in mix:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == want
    for r in sorted(tokens, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(tokens, key=lambda r: r["start"])] == by_id(mix)


def test_empty_tables(spark, monkeypatch, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    frames = written(spark, monkeypatch, f"file://{tmp_path}/out", f"file://{tmp_path}/in")
    assert all(f.count() == 0 for f in frames)


@pytest.mark.parametrize("url", [None, "", "no scheme/x", "://", "http://", "http://EXAMPLE.com/en/x?casino", "casino " * 30_000])
def test_odd_urls(spark, url):
    from shoreline.llm import url_filter

    pages = spark.createDataFrame([(1, url, "x", "y")], "page_id int, url string, host string, verdict string")
    (row,) = url_filter.filter_urls(pages).collect()
    scheme = url is not None and "://" in url
    assert scheme or (row["host"], row["path"]) == ("", "")
    assert row["verdict"] in ("allow", "block")
    assert (row["rule"] == "example.com/en/") == (url is not None and "EXAMPLE" in url)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
