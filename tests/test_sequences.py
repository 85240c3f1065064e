import numpy as np
import pandas as pd
import pytest

from shoreline.operators import sequences as S
from shoreline.plans.materialize import stored


def machine(flags, open_after=2, close_after=3):
    """The rule, one window after the other."""
    out, run, calm, is_open, number = [], 0, 0, False, 0
    for drifted in flags:
        run, calm = (run + 1, 0) if drifted else (0, calm + 1)
        moved = None
        if not is_open and run >= open_after:
            is_open, number, moved = True, number + 1, "OPENED"
        elif is_open and calm >= close_after:
            is_open, moved = False, "CLOSED"
        out.append((number, "OPEN" if is_open else None, moved))
    return out


def flags_frame(spark, sequences):
    rows = [(m, i, bool(f)) for m, s in sequences.items() for i, f in enumerate(s)]
    return spark.createDataFrame(rows, "model_id string, window_id bigint, drifted boolean")


def states(df):
    found = {}
    for r in df.orderBy("model_id", "window_id").collect():
        found.setdefault(r.model_id, []).append((r.incident_no, r.incident_status, r.transition))
    return found


@pytest.mark.parametrize("chunk", [1, 7])
def test_incidents_equal_state_machine(spark, chunk):
    rng = np.random.default_rng(chunk)
    cases = {f"m{i}": rng.random(n) < p for i, (n, p) in enumerate([(400, 0.5), (60, 0.8), (60, 0.2), (1, 1.0)])}
    cases["named"] = [c == "D" for c in "DDSSSDDSDDSSDSDDSSS"]
    got = states(S.incident_lifecycle(flags_frame(spark, cases), chunk_size=chunk))
    assert got == {m: machine(f) for m, f in cases.items()}


def test_incident_batches_equal_one_run(spark):
    rng = np.random.default_rng(8)
    cases = {"a": rng.random(90) < 0.5, "b": rng.random(40) < 0.6}
    whole = flags_frame(spark, cases)
    carry, parts = None, None
    for low, high in ((0, 13), (13, 14), (14, 50), (50, 90)):
        part = whole.filter(f"window_id >= {low} AND window_id < {high}")
        found = stored(S.incident_states(part, chunk_size=5, before=carry), "t")
        carry = stored(S.incident_carry(found, carry), "t")
        parts = found if parts is None else parts.unionByName(found)
    assert states(parts) == {m: machine(f) for m, f in cases.items()}


def test_incident_summary(spark):
    rows = [
        ("m", i, f == "D", r, p)
        for i, (f, r, p) in enumerate(
            [("D", "early", ["x"]), ("D", None, []), ("S", None, []), ("D", "a", ["b"]), ("D", "z", ["q"]),
             ("S", None, []), ("S", None, []), ("S", None, []), ("D", "n", []), ("D", "n", [])]
        )
    ]
    df = spark.createDataFrame(
        rows, "model_id string, window_id bigint, drifted boolean, root_cause string, symptom_path array<string>"
    )
    found = S.incident_summary(S.incident_lifecycle(df)).orderBy("incident_no").collect()
    first, second = found
    assert (first.incident_id, first.status) == ("live-inc-0001", "CLOSED")
    assert (first.opened_window, first.drifted_windows, first.last_window, first.closed_window) == (1, 4, 4, 7)
    assert (first.root_cause, first.symptom_path) == ("a", ["b"])
    assert (second.status, second.opened_window, second.root_cause) == ("OPEN", 9, "n")
    live, closed = S.incident_snapshot(S.incident_summary(S.incident_lifecycle(df)))
    assert live.count() == 1 and closed.count() == 1


def greedy(times, cooldown):
    last, kept = None, []
    for t in times:
        if last is None or t - last >= cooldown:
            last = t
            kept.append(True)
        else:
            kept.append(False)
    return kept


def alert_frame(spark, cases):
    rows = [(k, "m", i, float(t)) for k, ts in cases.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "root_cause string, model_id string, window_id bigint, ts double")


@pytest.mark.parametrize("blocks", [1, 5])
def test_cooldown_equals_loop(spark, blocks):
    rng = np.random.default_rng(blocks)
    cases = {f"r{i}": np.sort(rng.integers(0, 40_000, 300)) for i in range(3)}
    cases["rare"] = np.cumsum(rng.integers(1, 30_000, 40))
    cases["named"] = [1000, 1100, 1899, 1900, 2500, 2800]
    cases["first"] = [1000, 1100, 2500]
    found = S.alert_cooldown(alert_frame(spark, cases), 900, blocks).toPandas()
    for k, ts in cases.items():
        got = found[found.root_cause == k].sort_values("window_id").emitted.tolist()
        assert got == greedy(ts, 900), k


def test_cooldown_batches_equal_one_run(spark):
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(0, 30_000, 200))
    whole = alert_frame(spark, {"r": times})
    before, parts = None, []
    for low, high in ((0, 50), (50, 51), (51, 200)):
        part = whole.filter(f"window_id >= {low} AND window_id < {high}")
        found = stored(S.alert_cooldown(part, 900, 3, before=before), "t")
        before = stored(S.last_emitted(found, before), "t")
        parts.append(found.toPandas())
    got = pd.concat(parts).sort_values("window_id").emitted.tolist()
    assert got == greedy(times, 900)


def test_no_cooldown_emits_everything(spark):
    found = S.alert_cooldown(alert_frame(spark, {"r": [1, 1, 2]}), 0)
    assert found.filter("emitted").count() == 3 and S.suppressed_alerts(found).isEmpty()


def test_window_status_ignores_output(spark):
    rows = [("m", 0, "x", "STABLE"), ("m", 0, "prediction", "DRIFT"), ("m", 1, "x", "WARNING"),
            ("m", 2, "x", "DRIFT"), ("m", 3, "x", "INSUFFICIENT_DATA")]
    df = spark.createDataFrame(rows, "model_id string, window_id bigint, node string, verdict string")
    found = {r.window_id: (r.status, r.any_drift) for r in S.window_status(df).collect()}
    assert found == {0: ("STABLE", True), 1: ("WARNING", False), 2: ("DRIFT", True), 3: ("STABLE", False)}
