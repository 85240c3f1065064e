import itertools
import math
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoreline.config import DriftConfig
from shoreline.functions.pvalues import exceedance, with_ks_pvalue
from shoreline.functions.verdicts import combine_verdict
from shoreline.operators import drift as D
from shoreline.operators import profile as P

CONFIG = DriftConfig()


def lattice(m, n, steps):
    """P(D >= h / lcm) step by step over all n + m draws."""
    g, i, h = math.gcd(m, n), np.arange(m + 1), steps[:, None]
    p = np.where(h <= 0, 1.0, np.zeros((len(steps), m + 1)))
    for k in range(1, m + n + 1):
        before = np.concatenate([np.zeros((len(steps), 1)), p[:, :-1]], axis=1)
        p = (p * (k - i) + before * i) / k
        p = np.where(np.abs(i * (n // g) - (k - i) * (m // g)) >= h, 1.0, p)
        p[:, (i > k) | (k - i > n)] = 0
    return p[:, m]


@pytest.mark.parametrize("seed", range(20))
def test_exact_p_value_equals_the_lattice(seed):
    rng = np.random.default_rng(seed)
    m, n = int(rng.integers(1, 60)), int(rng.integers(1, 60) * rng.integers(1, 8))
    steps = np.unique(rng.integers(0, math.lcm(m, n) + 1, 5))
    small, large = sorted((m, n))
    assert np.allclose(exceedance(m, n, steps), lattice(small, large, steps), rtol=1e-10, atol=0)


def test_exact_p_value_does_not_depend_on_the_larger_sample():
    steps = np.array([round(d * math.lcm(100, 10**7)) for d in (0.05, 0.3)])
    began = time.time()
    high, low = exceedance(100, 10**7, steps)
    assert time.time() - began < 2 and 0.9 < high < 1 and 1e-9 < low < 1e-7


def enumerate_tail(m, n):
    g = math.gcd(m, n)
    seen = Counter()
    for chosen in itertools.combinations(range(m + n), m):
        i = j = widest = 0
        for k in range(m + n):
            if k in chosen:
                i += 1
            else:
                j += 1
            widest = max(widest, abs(i * (n // g) - j * (m // g)))
        seen[widest] += 1
    total = sum(seen.values())
    return {h: sum(v for k, v in seen.items() if k >= h) / total for h in seen}


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6))
def test_exact_p_value_equals_enumeration(m, n):
    want = enumerate_tail(m, n)
    steps = np.array(sorted(want))
    assert np.allclose(exceedance(m, n, steps), [want[h] for h in steps], rtol=1e-12)


def test_exact_p_value_published_values():
    # n = 30 against 1000 at D = 0.25, where the limit distribution would flip the verdict.
    assert exceedance(30, 1000, np.array([750]))[0] == pytest.approx(0.0433, abs=1e-4)
    # A strong shift: D = 0.910 with 300 against 569 is far below 1e-170 and not rounded to 0.
    assert 1e-178 < exceedance(300, 569, np.array([round(0.910 * 300 * 569)]))[0] < 1e-174


def frame(spark, **columns):
    rows = pd.DataFrame(columns)
    rows["model_id"] = "m"
    rows["row"] = np.arange(len(rows))
    return spark.createDataFrame(rows)


def compare(spark, base, current, config=CONFIG, p_method="exact", **options):
    """Results by node of one frame against another."""
    columns = [c for c in base.columns if c not in ("model_id", "row")]
    made = P.build_baseline(base, columns, F.col("row"), config)
    found = D.drift_from_frame(current, columns, made, config, p_method=p_method, **options)
    return {r.node: r for r in found.collect()}


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(11)


def test_same_and_shifted_samples(spark, rng):
    base = frame(spark, same=rng.normal(0, 1, 500), moved=rng.normal(0, 1, 500), slight=rng.normal(0, 1, 500))
    cur = frame(spark, same=rng.normal(0, 1, 500), moved=rng.normal(5, 1, 500), slight=rng.normal(0.3, 1, 500))
    found = compare(spark, base, cur)
    assert found["same"].ks_verdict == "STABLE" and found["same"].psi < 0.1
    assert found["same"].verdict == "STABLE"
    assert found["moved"].ks_verdict == "DRIFT" and found["moved"].psi_verdict == "DRIFT"
    strict = compare(spark, base, cur, DriftConfig(ks_pvalue=1e-9))
    assert found["slight"].p_value == strict["slight"].p_value
    assert found["slight"].ks_verdict == "DRIFT" and strict["slight"].ks_verdict == "STABLE"


def test_too_few_samples(spark, rng):
    base = frame(spark, x=rng.normal(0, 1, 100), c=["A", "B"] * 50)
    cur = frame(spark, x=[1.0, 2.0], c=["A", "B"])
    found = compare(spark, base, cur)
    assert found["x"].verdict == "INSUFFICIENT_DATA" and found["x"].current_n == 2
    assert found["x"].statistic is None and found["x"].p_value is None
    assert found["c"].verdict == "INSUFFICIENT_DATA" and found["c"].psi is None


def test_empty_bins_are_finite(spark):
    found = compare(
        spark, frame(spark, x=np.linspace(0, 1, 500)), frame(spark, x=np.linspace(100, 101, 500))
    )
    assert found["x"].psi_verdict == "DRIFT" and math.isfinite(found["x"].psi)
    assert found["x"].statistic == pytest.approx(1.0)


def test_collapsed_bins_give_zero(spark):
    base = frame(spark, two=[0.0] * 45 + [1.0] * 46, flat=[3.0] * 91)
    cur = frame(spark, two=[0.0] * 10 + [1.0] * 81, flat=[9.0] * 91)
    found = compare(spark, base, cur)
    assert found["two"].psi == 0.0 and found["flat"].psi == 0.0


def test_categorical(spark):
    base = frame(spark, c=["A"] * 65 + ["B"] * 35)
    same = compare(spark, base, frame(spark, c=["A"] * 65 + ["B"] * 35))["c"]
    moved = compare(spark, base, frame(spark, c=["A"] * 10 + ["B"] * 90))["c"]
    unseen = compare(spark, base, frame(spark, c=["A"] * 60 + ["Z"] * 40))["c"]
    assert same.psi == pytest.approx(0.0) and same.verdict == "STABLE"
    assert moved.verdict == "DRIFT" and moved.ks_verdict is None
    term = lambda c, b: (c - b) * math.log(c / b)
    want = term(0.6, 0.65) + term(1e-6, 0.35) + term(0.4, 1e-6)
    assert unseen.psi == pytest.approx(want)


def test_ties_and_random_samples_equal_numpy(spark, rng):
    base = {f"f{i}": np.round(rng.normal(0, 1 + i, 700), i % 3) for i in range(6)}
    cur = {f"f{i}": np.round(rng.normal(0.2 * i, 1, 300), i % 3) for i in range(6)}
    found = compare(spark, frame(spark, **base), frame(spark, **cur))
    for name, b in base.items():
        c = cur[name]
        at = np.concatenate([b, c])
        cdf = lambda s: np.searchsorted(np.sort(s), at, side="right") / len(s)
        assert found[name].statistic == pytest.approx(np.abs(cdf(c) - cdf(b)).max(), abs=1e-12)
        edges = np.unique(np.quantile(b, np.linspace(0, 1, 11)))
        edges[0], edges[-1] = -np.inf, np.inf
        share = lambda s: np.maximum(np.histogram(s, edges)[0] / len(s), 1e-6)
        psi = ((share(c) - share(b)) * np.log(share(c) / share(b))).sum()
        assert found[name].psi == pytest.approx(psi, abs=1e-9)


def test_cells_place_every_value(spark, rng):
    """Counts below, at or below, and bin of every value; one value is held by all windows."""
    x = np.round(rng.normal(0, 1, 900), 1)
    base = frame(spark, x=x, y=rng.normal(0, 1, 900))
    made = P.build_baseline(base, ["x", "y"], F.col("row"))
    current = np.where(np.arange(3000) % 3 == 0, 0.3, np.round(rng.normal(0, 2, 3000), 2))
    cur = frame(spark, x=current, y=rng.normal(1, 1, 3000))
    values = P.collect_batch_features(
        cur.withColumn("window_id", F.expr("row div 20")), ["model_id", "window_id"], ["x", "y"]
    )
    cells = D.baseline_cells(values, made)
    found = {
        (r.window_id, r.lt, r.le, r.bin): r.n for r in cells.filter("node = 'x'").collect()
    }
    ordered = np.sort(x)
    edges = np.array(made.nodes.filter("node = 'x'").first().edges)[1:-1]
    want = Counter(
        (row // 20, np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right"), np.searchsorted(edges, v, "right"))
        for row, v in enumerate(current)
    )
    assert found == want


def test_sample_is_capped_and_repeatable(spark, rng):
    base = frame(spark, x=rng.normal(0, 1, 3000))
    config = DriftConfig(baseline_cap=500)
    one = P.build_baseline(base, ["x"], F.col("row"), config)
    two = P.build_baseline(base.repartition(5), ["x"], F.col("row"), config)
    assert one.values.count() == 500
    assert one.values.exceptAll(two.values).isEmpty()
    node = one.nodes.first()
    assert (node.n, node.baseline_n) == (3000, 500)


def test_combine_table(spark):
    cases = {
        ("DRIFT", "DRIFT"): "DRIFT", ("STABLE", "DRIFT"): "DRIFT", ("DRIFT", "WARNING"): "DRIFT",
        ("STABLE", "WARNING"): "WARNING", ("DRIFT", "STABLE"): "WARNING",
        ("STABLE", "STABLE"): "STABLE", (None, "INSUFFICIENT_DATA"): "INSUFFICIENT_DATA",
        ("DRIFT", None): "WARNING", (None, "DRIFT"): "DRIFT",
    }
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], "ks string, psi string, want string")
    wrong = rows.filter(combine_verdict("ks", "psi") != F.col("want"))
    assert wrong.isEmpty()


def test_missing_node_is_insufficient(spark, rng):
    base = frame(spark, x=rng.normal(0, 1, 200), y=rng.normal(0, 1, 200))
    made = P.build_baseline(base, ["x", "y"], F.col("row"))
    found = D.drift_from_frame(base.drop("y"), ["x"], made, p_method="exact").collect()
    assert {r.node: r.verdict for r in found} == {"x": "STABLE", "y": "INSUFFICIENT_DATA"}


def test_too_few_reference_rows(spark):
    with pytest.raises(Exception, match="too few rows"):
        P.reference_profile(frame(spark, x=[1.0] * 19), ["x"]).collect()


def test_unsupported_column_type(spark):
    with pytest.raises(TypeError, match="must be a number"):
        P.column_kinds(spark.sql("SELECT array(1) AS a"))


def test_all_reference_rows_count(spark, rng, monkeypatch):
    # More values than the former cap, with ties, over many stretches of the running sum.
    monkeypatch.setattr(D, "STRETCH", 700)
    b, c = np.round(rng.normal(0, 1, 12_000), 3), np.round(rng.normal(0.1, 1, 4_000), 3)
    base = frame(spark, x=b)
    made = P.build_baseline(base, ["x"], F.col("row"))
    node = made.nodes.first()
    assert (node.n, node.baseline_n) == (12_000, 12_000)
    want = np.unique(np.quantile(b, [i * 0.1 for i in range(10)] + [1.0]))
    assert np.allclose(node.edges[1:-1], want[1:-1], rtol=0, atol=1e-12)
    found = D.drift_from_frame(frame(spark, x=c), ["x"], made, p_method="asymptotic").first()
    at = np.concatenate([b, c])
    cdf = lambda s: np.searchsorted(np.sort(s), at, side="right") / len(s)
    assert found.statistic == pytest.approx(np.abs(cdf(c) - cdf(b)).max(), abs=1e-12)
    edges = np.array(node.edges)
    share = lambda s: np.maximum(np.histogram(s, edges)[0] / len(s), 1e-6)
    psi = ((share(c) - share(b)) * np.log(share(c) / share(b))).sum()
    assert found.psi == pytest.approx(psi, abs=1e-9)


def test_named_p_values_do_not_switch_by_size(spark):
    sizes = spark.createDataFrame([(40, 12_000, 0.2), (40, 900, 0.2)], "n1 bigint, n2 bigint, d double")
    exact, limit = (
        {r.n2: r.p_value for r in with_ks_pvalue(sizes, "n1", "n2", "d", m).collect()} for m in ("exact", "limit")
    )
    for n in (12_000, 900):
        assert exact[n] == pytest.approx(exceedance(40, n, np.array([round(0.2 * math.lcm(40, n))]))[0], rel=1e-12)
        assert limit[n] != exact[n]


def test_bins_written_out_equal_those_of_the_array(spark):
    """Compared one by one the bins are the same, also at edges, without inner edges and for infinite values."""
    from shoreline.operators import profile as P

    inf = float("inf")
    nodes = spark.createDataFrame(
        [("a", [-inf, 1.0, 2.0, inf]), ("b", [-inf, inf]), ("c", [inf]), ("d", [-inf, -inf, 0.0, 5.0, 7.5, inf]), ("e", None)],
        "node string, edges array<double>",
    )
    values = spark.createDataFrame([(v,) for v in (-inf, -1.0, 0.0, 1.0, 1.5, 2.0, 5.0, 7.5, 9.0, inf)], "value double")
    rows = nodes.crossJoin(values)
    assert P.most_edges(nodes) == 6
    compiled = P.bin_of("value", "edges", P.most_edges(nodes))
    assert rows.filter(~compiled.eqNullSafe(P.bin_of("value", "edges"))).count() == 0
    assert "lambda" not in rows.select(compiled)._jdf.queryExecution().executedPlan().toString()


def test_exact_p_values_of_many_triples_take_few_logarithms(spark, rng, monkeypatch):
    """Logarithms grow with the smaller sample, not with its square; sizes may differ from row to row."""
    from shoreline.functions import pvalues

    sizes = [(int(m), int(n)) for m, n in zip(rng.choice([1, 30, 64], 200), rng.integers(64, 700, 200))]
    rows = [(n, m, h / math.lcm(m, n)) for m, n in sizes for h in [int(rng.integers(0, math.lcm(m, n) + 1))]]
    made = spark.createDataFrame(rows, "n1 bigint, n2 bigint, d double")
    for r in with_ks_pvalue(made, "n1", "n2", "d", "exact").collect():
        step = np.array([round(r.d * math.lcm(r.n1, r.n2))])
        assert r.p_value == pytest.approx(lattice(r.n2, r.n1, step)[0], rel=1e-9)
    taken, log = [0], pvalues._log_factorial
    def counted(k):
        taken[0] += np.size(k)
        return log(k)
    monkeypatch.setattr(pvalues, "_log_factorial", counted)
    exceedance(100, 600_007, rng.integers(1, 10_000_000, 40))
    assert taken[0] < 40 * 40 * 100
