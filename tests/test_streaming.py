import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoreline.config import DriftConfig
from shoreline.operators import graph as G
from shoreline.operators import profile as P
from shoreline.operators.windows import count_windows
from shoreline.sources import events as E
from shoreline.sources import history as H
from shoreline.sources import tables as T
from shoreline.streaming.live import LiveIncidents, LiveMonitor, LiveWindows, time_window_stream

FEATURES = ["inflow", "pressure", "warmth", "level"]


def frame(n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "inflow": rng.normal(41 + 4.5 * shift, 3.7, n),
            "pressure": rng.normal(-2.5 + 0.8 * shift, 0.7, n),
            "warmth": rng.normal(310 + 13 * shift, 9, n),
            "level": rng.uniform(0, 0.6, n),
        }
    )


def write_parts(spark, df, folder, size):
    """One file after the other, in event order."""
    for i in range(0, len(df), size):
        spark.createDataFrame(df.iloc[i : i + size]).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def test_stream_of_windows_equals_batch(spark, tmp_path):
    n = 235
    rng = np.random.default_rng(0)
    df = pd.DataFrame(
        {"model_id": rng.choice(["hot", "hot", "hot", "cold"], n), "event_id": np.arange(n), "ts": np.arange(n) * 1.0}
    )
    write_parts(spark, df, str(tmp_path / "in"), 60)

    def evaluate(rows, batch_id):
        H.write_batch(rows, str(tmp_path / "out"), batch_id)

    schema = spark.read.parquet(str(tmp_path / "in")).schema
    live = LiveWindows(str(tmp_path / "state"), evaluate, size=20)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.start(stream, str(tmp_path / "progress"), bounded=True).awaitTermination()
    before_flush = spark.read.parquet(str(tmp_path / "out")).groupBy("model_id", "window_id").count()
    assert {r["count"] for r in before_flush.collect()} == {20}
    live.flush(spark)
    got = spark.read.parquet(str(tmp_path / "out")).select("model_id", "event_id", "window_id")
    want = count_windows(spark.createDataFrame(df), 20).select("model_id", "event_id", "window_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert len(H.written_batches(spark, str(tmp_path / "state" / "closed"))) >= 4


def test_repeated_batch_changes_nothing(spark, tmp_path):
    seen = {}

    def evaluate(rows, batch_id):
        seen.setdefault(batch_id, []).append(sorted((r.event_id, r.window_id) for r in rows.collect()))

    live = LiveWindows(str(tmp_path), evaluate, size=4)
    part = lambda a, b: spark.range(a, b).select(F.lit("m").alias("model_id"), F.col("id").alias("event_id"), F.col("id").alias("ts"))
    live.on_batch(part(0, 6), 0)
    live.on_batch(part(6, 9), 1)
    live.on_batch(part(6, 9), 1)
    assert seen[1][0] == seen[1][1] == [(4, 1), (5, 1), (6, 1), (7, 1)]


@pytest.mark.parametrize("with_graph", [True, False])
def test_stable_drift_recover(spark, tmp_path, with_graph):
    # With 100 rows a window the index of equal samples is about 0.1, so the bands are wider here.
    config = DriftConfig(window_size=100, window_min_samples=30, cooldown_seconds=150,
                         psi_warning=0.5, psi_drift=0.8)
    ref = spark.createDataFrame(frame(500, 1).assign(model_id="m", row=range(500)))
    base = P.build_baseline(ref, FEATURES, F.col("row"), config)
    if with_graph:
        g = G.graph_from_edges(spark.createDataFrame([("inflow", "pressure"), ("pressure", "warmth")], "parent string, child string"))
    else:
        g = G.trivial_graph(spark.createDataFrame([(f,) for f in FEATURES], "node string"))
    closure, levels = G.transitive_closure(g.edges), G.node_levels(g.nodes, g.edges)
    rows = pd.concat([frame(200, 2), frame(300, 3, 6.0), frame(500, 4)], ignore_index=True)
    rows["model_id"], rows["event_id"] = "m", range(1000)
    rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["event_id"], unit="s")
    write_parts(spark, rows, str(tmp_path / "in"), 470)
    ids = ["model_id", "window_id"]
    monitor = LiveMonitor(
        str(tmp_path / "out"), base, closure, levels,
        lambda d: P.collect_batch_features(d, ids, FEATURES),
        lambda d: P.collect_batch_categories(d, ids, []),
        p_method="exact", config=config, with_graph=with_graph,
    )
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitor.start(stream, str(tmp_path / "progress"), bounded=True).awaitTermination()
    monitor.flush(spark)
    found = H.read_history(spark, str(tmp_path / "out")).orderBy("window_id").collect()
    assert [r.window_id for r in found] == list(range(10))
    assert [r.status == "DRIFT" for r in found] == [False, False, True, True, True] + [False] * 5
    for r in found[2:5]:
        assert set(r.drifted_features) == {"inflow", "pressure", "warmth"}
        if with_graph:
            assert r.root_cause_candidates == ["inflow"] and r.primary_symptom_path == ["pressure", "warmth"]
            assert r.symptoms == ["pressure", "warmth"]
        else:
            assert len(r.root_cause_candidates) == 3 and r.symptoms == [] and r.alerts is None
    assert [r.incident_status for r in found] == [None] * 3 + ["OPEN"] * 4 + [None] * 3
    assert {r.incident_id for r in found if r.incident_id} == {"live-inc-0001"}
    if with_graph:
        # One alert a window, the second within the cool-down of the first.
        assert [len(r.alerts or []) for r in found] == [0, 0, 1, 0, 1, 0, 0, 0, 0, 0]
        latest = H.latest_window(H.read_history(spark, str(tmp_path / "out"))).first()
        assert latest.window_id == 9


def test_incident_stream_in_batches(spark, tmp_path):
    flags = [c == "D" for c in "DDSSSDDSDDSSDS"]
    df = pd.DataFrame({"model_id": "m", "window_id": range(len(flags)), "drifted": flags})
    write_parts(spark, df, str(tmp_path / "in"), 3)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    LiveIncidents(str(tmp_path / "out")).start(stream, str(tmp_path / "progress"), bounded=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "states")).orderBy("window_id").collect()
    assert [r.transition for r in rows if r.transition] == ["OPENED", "CLOSED", "OPENED"]
    assert rows[-1].incident_no == 2 and rows[-1].incident_status == "OPEN"


def test_event_time_windows_with_late_data(spark, tmp_path):
    stamps = ["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:05:00", "2024-01-01 00:05:30",
              "2024-01-01 00:00:20", "2024-01-01 00:10:00", "2024-01-01 00:10:10"]
    df = pd.DataFrame({"model_id": "m", "ts": pd.to_datetime(stamps), "x": [1.0, 3.0, 5.0, 6.0, 100.0, 7.0, 8.0]})
    write_parts(spark, df, str(tmp_path / "in"), 1)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = (
        time_window_stream(stream, "1 minute", "1 minute", ["x"])
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    job.awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("window").first()
    # The event that came after the watermark had passed its window is not counted.
    assert (first.event_count, first.mean_x) == (2, 2.0)


LINES = [
    {"event_id": "a", "model_id": "m", "timestamp": "2024-01-01T00:00:00+00:00", "features": {"x": 1.5, "c": "blue"}, "prediction": 1},
    {"model_id": "m", "features": {"x": 2}, "output": 0.5},
]


def test_event_files_round_trip(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    text = "\n".join([json.dumps(LINES[0]), "", "  ", "{broken", json.dumps(LINES[1]), json.dumps({"features": {"x": [1]}})])
    (path / "events.jsonl").write_text(text)
    events = E.replay_events(spark, str(path))
    rows = {r.event_id: r for r in events.collect()}
    assert len(rows) == 2 and rows["a"].features["c"].text == "blue" and rows["a"].features["x"].num == 1.5
    assert {r.source for r in rows.values()} == {"api"} and {r.schema_version for r in rows.values()} == {"1.0"}
    assert E.replay_events(spark, str(path), limit=1).count() == 1
    early = tmp_path / "early"
    early.mkdir()
    (early / "a.jsonl").write_text("\n".join(["{broken", json.dumps(LINES[0]), "{", json.dumps(LINES[1])]))
    assert [r.event_id for r in E.replay_events(spark, str(early), limit=1).collect()] == ["a"]
    assert E.replay_events(spark, str(early), limit=2).count() == 2
    good, bad = E.validate_events(spark.read.text(str(path)))
    assert good.count() == 2 and bad.count() == 2
    E.emit_events(events, str(tmp_path / "again"))
    again = E.replay_events(spark, str(tmp_path / "again"))
    assert {r.event_id for r in again.collect()} == set(rows)


def test_tail_skips_files_from_before(spark, tmp_path):
    path, out, skip = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "skip")
    path.mkdir()
    for i in range(5):
        (path / f"old-{i}.jsonl").write_text(json.dumps({**LINES[0], "event_id": f"old-{i}"}))

    def run():
        stream = E.tail_events(spark, str(path), skip=skip)
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-p").trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.event_id for r in spark.read.schema(stream.schema).parquet(out).collect())

    E.tail_events(spark, str(path), skip=skip)  # the session starts: names are listed
    for i in range(1000):
        (path / f"new-{i}.jsonl").write_text(json.dumps({**LINES[0], "event_id": f"new-{i}"}) + "\n{broken")
    assert run() == sorted(f"new-{i}" for i in range(1000))
    (path / "later.jsonl").write_text(json.dumps({**LINES[0], "event_id": "later"}))
    assert run() == sorted(["later", *(f"new-{i}" for i in range(1000))])


def test_kafka_is_guarded(spark):
    if E.kafka_available(spark):
        pytest.skip("connector present")
    with pytest.raises(RuntimeError, match="kafka"):
        E.kafka_batch_source(spark, "localhost:1", "t")
    with pytest.raises(RuntimeError, match="kafka"):
        E.kafka_stream_source(spark, "localhost:1", "t")


def test_baselines_by_version(spark, tmp_path):
    config = DriftConfig()
    for version, seed in (("v1", 1), ("v2", 2)):
        ref = spark.createDataFrame(frame(100, seed).assign(model_id="m", row=range(100)))
        T.store_baseline(P.build_baseline(ref, FEATURES, F.col("row"), config), str(tmp_path), version)
    assert T.load_baseline(spark, str(tmp_path), "v2").values.count() == 400
    assert T.load_baseline(spark, str(tmp_path)).values.count() == 800
    for text in ("007", "1.10", "1e3"):
        T.store_baseline(P.build_baseline(ref, FEATURES, F.col("row"), config), str(tmp_path / "texts"), text)
    for text in ("007", "1.10", "1e3"):
        assert T.load_baseline(spark, str(tmp_path / "texts"), text).values.count() == 400


def test_empty_reference(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="empty"):
        T.scan_reference(spark, str(tmp_path / "r.csv"), "csv")
    (tmp_path / "s.csv").write_text("a,b\n1,x\n")
    assert dict(T.scan_reference(spark, str(tmp_path / "s.csv"), "csv").dtypes) == {"a": "int", "b": "string"}
