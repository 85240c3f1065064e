import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.operators import graph as G
from shoreline.operators import rca as R


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "parent string, child string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_chain_and_output_node(spark):
    g = G.graph_from_edges(edges(spark, ("a", "b"), ("b", "c")))
    assert pairs(g.edges) == {("a", "b"), ("b", "c"), ("c", "prediction")}
    assert dict(pairs(g.nodes)) == {
        "a": "raw_input", "b": "derived_feature", "c": "derived_feature", "prediction": "model_output",
    }
    closure = G.transitive_closure(g.edges)
    assert {r.ancestor for r in G.ancestors(closure).filter("node = 'c'").collect()} == {"a", "b"}
    order = G.topological_order(G.node_levels(g.nodes, g.edges))
    assert [r.node for r in order.orderBy("position").collect()] == ["a", "b", "c", "prediction"]


def test_diamond_and_cycle_close(spark):
    diamond = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))
    assert ("a", "e") in pairs(G.transitive_closure(diamond))
    assert G.transitive_closure(diamond).count() == 9
    cycle = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert G.transitive_closure(cycle).count() == 9
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("r",)], "node string")
    with pytest.raises(G.GraphError):
        G.node_levels(nodes, cycle.union(edges(spark, ("r", "a"))))


def test_deep_chain(spark):
    chain = spark.range(70).select(
        F.format_string("n%03d", "id").alias("parent"), F.format_string("n%03d", F.col("id") + 1).alias("child")
    )
    assert G.transitive_closure(chain).count() == 71 * 70 // 2
    path = G.longest_chain(chain.filter("parent < 'n030'"))
    assert [r.node for r in path.orderBy("step").collect()] == [f"n{i:03d}" for i in range(31)]


def test_longest_chain_ignores_the_output(spark):
    found = G.longest_chain(
        edges(spark, ("a", "b"), ("b", "c"), ("x", "c"), ("c", "prediction"), ("a", "d"))
    )
    assert [r.node for r in found.orderBy("step").collect()] == ["a", "b", "c"]


def test_validation(spark):
    nodes = spark.createDataFrame(
        [("a", "raw_input"), ("b", "derived_feature"), ("c", "odd"), ("lone", "raw_input")],
        "node string, kind string",
    )
    bad = edges(spark, ("a", "b"), ("b", "a"), ("ghost", "c"), ("c", "c"), (None, "b"))
    found = pairs(G.validate_graph(nodes, bad, nodes.filter("node <> 'b'").select("node")))
    assert found == {
        ("malformed_edge", "?->b"), ("self_edge", "c"), ("invalid_kind", "c"), ("undefined_parent", "ghost->c"),
        ("orphan", "lone"), ("cycle", "a"), ("cycle", "b"), ("unknown_feature", "b"), ("unknown_feature", "ghost"),
    }
    empty = G.validate_graph(nodes.limit(0), bad.limit(0))
    assert pairs(empty) == {("no_edges", "graph")}
    good = G.graph_from_edges(edges(spark, ("a", "b")))
    assert G.validate_graph(good.nodes, good.edges).isEmpty()


@pytest.mark.parametrize(
    "body, message",
    [
        ({"x": 1}, "edges"),
        ({"edges": []}, "no edges"),
        ({"edges": [["a"]]}, "pair"),
        ({"edges": [["a", "b"], ["b", "a"]]}, "cycle"),
        ({"edges": [["a", "b"], ["c", "c"]]}, "self_edge c"),
        ({"nodes": {"a": {"kind": "raw_input"}, "b": {"parents": ["x"]}}}, "undefined_parent"),
        ({"nodes": {"a": {"kind": "other"}, "b": {"parents": ["a"]}}}, "invalid_kind a"),
    ],
)
def test_bad_graph_files(spark, tmp_path, body, message):
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(body))
    with pytest.raises(G.GraphError, match=message):
        G.load_graph(spark, str(path))


def test_node_form_of_graph_file(spark, tmp_path):
    path = tmp_path / "graph.json"
    path.write_text(
        json.dumps({"nodes": {"a": {"kind": "raw_input"}, "b": {"parents": ["a"]}, "out": {"kind": "model_output", "parents": ["b"]}}})
    )
    g = G.load_graph(spark, str(path))
    assert pairs(g.edges) == {("a", "b"), ("b", "out")}
    assert dict(pairs(g.nodes))["b"] == "derived_feature"


def verdicts(spark, drifted, nodes="abcd"):
    rows = [
        ("m", 0, n, "DRIFT" if n in drifted else "STABLE", {"a": 0.3, "b": 0.9, "c": 0.5, "d": 0.4}[n], 0.01)
        for n in nodes
    ]
    rows.append(("m", 0, "prediction", "DRIFT", 2.0, None))
    return spark.createDataFrame(
        rows, "model_id string, window_id bigint, node string, verdict string, psi double, p_value double"
    )


@pytest.mark.parametrize(
    "graph, drifted, roots, symptoms, paths",
    [
        ([("a", "b"), ("b", "c")], "abc", {"a"}, {"b", "c"}, {"a": ["b", "c"]}),
        ([("a", "b"), ("b", "c")], "bc", {"b"}, {"c"}, {"b": ["c"]}),
        ([("a", "b"), ("b", "c")], "c", {"c"}, set(), {"c": []}),
        ([("a", "b"), ("b", "c")], "ac", {"a"}, {"c"}, {"a": ["c"]}),
        ([("a", "c"), ("b", "c")], "abc", {"a", "b"}, {"c"}, {"a": ["c"], "b": ["c"]}),
        ([("a", "b"), ("c", "d")], "abcd", {"a", "c"}, {"b", "d"}, {"a": ["b"], "c": ["d"]}),
        ([("a", "b")], "d", {"d"}, set(), {"d": []}),
    ],
)
def test_roots_and_symptoms(spark, graph, drifted, roots, symptoms, paths):
    g = G.graph_from_edges(edges(spark, *graph))
    closure = G.transitive_closure(g.edges)
    nd = verdicts(spark, drifted)
    found = R.root_severity(R.rca_roots(nd, closure))
    assert {r.node for r in found.collect()} == roots
    assert {r.node for r in R.rca_symptoms(nd, closure).collect()} == symptoms
    got = R.symptom_paths(nd, found, closure, G.node_levels(g.nodes, g.edges))
    assert {r.node: list(r.symptom_path) for r in got.collect()} == paths
    classes = {r.node: r.classification for r in R.classify_nodes(nd, closure).collect()}
    assert classes["prediction"] == "STABLE"
    assert {n for n, c in classes.items() if c == "ROOT_CAUSE"} == roots
    assert {n for n, c in classes.items() if c == "SYMPTOM"} == symptoms


def test_severity_order(spark):
    closure = G.transitive_closure(edges(spark, ("a", "prediction"), ("b", "prediction"), ("c", "prediction")))
    ranked = R.root_severity(R.rca_roots(verdicts(spark, "abc"), closure))
    assert [r.node for r in ranked.orderBy("rank").collect()] == ["b", "c", "a"]


def cyclic(pairs_of):
    """Nodes that reach themselves."""
    out = {}
    for a, b in pairs_of:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if start in seen:
            found.add(start)
    return found


def test_levels_and_cycles_of_many_graphs_in_one_call(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = []
    for g in range(6):
        # Graphs 0-2 have no cycle; the others have several, chains between them and closed rings.
        n = 9
        for _ in range(14):
            a, b = rng.sample(range(n), 2)
            rows.append((f"g{g}", f"n{min(a, b)}", f"n{max(a, b)}") if g < 3 else (f"g{g}", f"n{a}", f"n{b}"))
    rows += [("ring", f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    rows += [("two", a, b) for a, b in ["ab", "ba", "bc", "cd", "de", "ef", "fe", "fg"]]
    table = spark.createDataFrame(rows, "model_id string, parent string, child string")
    monkeypatch.setattr(G, "PLAIN_ROUNDS", 2)
    ends = G._endpoints(table, ["model_id"])
    found = {(r.model_id, r.node): r.level for r in G.peeled(ends, table, ["model_id"]).collect()}
    on_cycle = {tuple(r) for r in G.cyclic_nodes(ends, table, ["model_id"]).collect()}
    graphs = {g: [(a, b) for k, a, b in rows if k == g] for g, _, _ in rows}
    for g, edges_of in graphs.items():
        bad = cyclic(edges_of)
        assert {n for k, n in on_cycle if k == g} == bad
        behind = set(bad)
        while grown := {b for a, b in edges_of if a in behind} - behind:
            behind |= grown
        level = {}

        def height(n):
            return level.setdefault(n, max((height(a) + 1 for a, b in edges_of if b == n), default=0))

        for n in {x for e in edges_of for x in e}:
            assert found[g, n] == (None if n in behind else height(n))
    rules = {(r.model_id, r.subject) for r in G.validate_graph(ends.withColumn("kind", F.lit("raw_input")), table, keys=["model_id"]).collect() if r.rule == "cycle"}
    assert rules == on_cycle


def test_chain_of_a_thousand_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "PLAIN_ROUNDS", 2)
    chain = spark.range(1000).select(F.format_string("n%04d", "id").alias("parent"), F.format_string("n%04d", F.col("id") + 1).alias("child"))
    g = G.graph_from_edges(chain)
    assert G.validate_graph(g.nodes, g.edges).isEmpty()
    levels = {r.node: r.level for r in G.node_levels(g.nodes, g.edges).collect()}
    assert levels["prediction"] == 1001 and all(levels[f"n{i:04d}"] == i for i in range(1001))
    path = G.longest_chain(g.edges).orderBy("step").collect()
    assert [(r.step, r.node) for r in path] == [(i, f"n{i:04d}") for i in range(1001)]


def test_ancestor_sets_of_random_graphs(spark, monkeypatch):
    """Wide nodes, chains between branches and many graphs in one call, against plain search."""
    import random

    rng = random.Random(5)
    rows = set()
    for g in range(2):
        for b in range(1, 20):
            for a in rng.sample(range(b), min(b, rng.choice([0, 1, 1, 1, 1, 2]))):
                rows.add((f"g{g}", f"n{a:03d}", f"n{b:03d}"))
    rows |= {("wide", f"w{i}", "sink") for i in range(300)} | {("wide", "sink", "end")}
    table = spark.createDataFrame(sorted(rows), "model_id string, parent string, child string")
    up = {}
    for g, a, b in rows:
        up.setdefault((g, b), set()).add(a)

    def above(g, n, seen):
        for a in up.get((g, n), ()):
            if a not in seen:
                seen.add(a)
                above(g, a, seen)
        return seen

    want = {(g, a, n) for g, n in up for a in above(g, n, set())}
    monkeypatch.setattr(G, "PLAIN_ROUNDS", 2)
    ends = G._endpoints(table, ["model_id"])
    numbers = G.dense_index(ends, ["model_id"], ["node"], "number")
    found = G.pairs_of_sets(G.ancestor_sets(ends, table, numbers, ["model_id"]), numbers, ["model_id"]).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_built_graph_is_compared_once(spark):
    """Repeated and incomplete edges in, none twice out; users of the built graph compare nothing again."""
    given = edges(spark, ("a", "b"), ("a", "b"), ("b", "c")).union(
        spark.createDataFrame([(None, "c"), (None, "c")], "parent string, child string")
    )
    g = G.graph_from_edges(given)
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    ends = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert ends(g.edges) == ends(spark.createDataFrame(
        [("a", "b"), ("b", "c"), (None, "c"), ("c", "prediction"), (None, "prediction")], "parent string, child string"
    ))
    assert {(r.node, r.kind) for r in g.nodes.collect()} == {
        ("a", "raw_input"), (None, "raw_input"), ("b", "derived_feature"), ("c", "derived_feature"), ("prediction", "model_output")
    }
    near = G.graph_neighbors(g.edges, unique=True)
    assert "Aggregate" not in near._jdf.queryExecution().executedPlan().toString()
    assert ends(near) == ends(G.graph_neighbors(g.edges))


def test_peeling_reads_only_edges_still_ahead(spark, monkeypatch):
    """Dropping used edges, or joining large tables without broadcasts, changes no level."""
    wide = [(f"a{i}", f"b{i % 7}") for i in range(60)] + [(f"b{i}", f"c{j}") for i in range(7) for j in range(9)]
    wide += [(f"c{i}", "d0") for i in range(9)] + [(f"d{i}", f"d{i + 1}") for i in range(4)]
    table = edges(spark, *wide)
    want = {**{f"a{i}": 0 for i in range(60)}, **{f"b{i}": 1 for i in range(7)}, **{f"c{i}": 2 for i in range(9)}, **{f"d{i}": i + 3 for i in range(5)}}
    names = table.selectExpr("explode(array(parent, child)) AS node").distinct()
    for rows in (0, 30):
        monkeypatch.setattr(G, "BROADCAST_ROWS", rows)
        assert {r.node: r.level for r in G.node_levels(names, table).collect()} == want
    sizes = type("Sizes", (), {"ready": 2, "open": 1, "edges": 3})
    left = spark.createDataFrame([("b", 0), ("c", 0), ("d", 2)], "node string, need bigint")
    monkeypatch.setattr(G, "BROADCAST_ROWS", 5)
    ahead, held = G._still_ahead(edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("x", "b")), 6, left, sizes, ())
    assert held == 2 and pairs(ahead.selectExpr("parent AS ancestor", "child AS descendant")) == {("b", "d"), ("c", "d")}


def _closure(rows):
    """(key, ancestor, descendant) by following edges from every node."""
    below = {}
    for k, a, b in rows:
        below.setdefault((k, a), set()).add(b)
    found = set()
    for k, a in below:
        open_ = list(below[k, a])
        while open_:
            b = open_.pop()
            if (k, a, b) not in found:
                found.add((k, a, b))
                open_ += below.get((k, b), ())
    return found


def test_closure_by_layers_equals_a_walk(spark, monkeypatch):
    """Graphs of one and of several ends, with cycles above them, behind them and beside them, and without any end."""
    monkeypatch.setattr(G, "LAYER_EDGES", 0)
    rng = np.random.default_rng(0)
    rows = set()
    for k in ("one", "many", "ring"):
        rows |= {(k, f"a{i % 3}", f"b{rng.integers(4)}") for i in range(6)}
        rows |= {(k, f"b{rng.integers(4)}", f"c{i}") for i in range(30)}
        rows |= {(k, f"a{rng.integers(3)}", f"c{i}") for i in range(0, 30, 3)}
        rows |= {(k, "b0", "a0"), (k, "c1", "x"), (k, "x", "y"), (k, "y", "x"), (k, "z", "z")}
    rows |= {("one", f"c{i}", "end") for i in range(30) if i != 1}
    rows |= {("many", f"c{i}", f"d{i % 4}") for i in range(5, 30)}
    rows = {r for r in rows if r[0] != "ring" or not r[2].startswith("c")} | {("ring", "y", "a1")}
    given = spark.createDataFrame(sorted(rows) + [("one", None, "c3"), ("one", "c3", None)], "k string, parent string, child string")
    assert sorted(map(tuple, G.transitive_closure(given, ["k"]).collect())) == sorted(_closure(rows))
    for k in ("one", "many", "ring"):
        alone = G.transitive_closure(given.filter(F.col("k") == k).drop("k"))
        assert sorted(map(tuple, alone.collect())) == sorted(r[1:] for r in _closure(rows) if r[0] == k)


def test_closure_doubles_the_upper_rows_of_a_wide_graph_only(spark, monkeypatch):
    written, store = [], G.stored
    def counted(df, label):
        out = store(df, label)
        written.append((label, out.count()))
        return out
    monkeypatch.setattr(G, "stored", counted)
    rows = [(f"a{i % 3}", f"b{i}") for i in range(300)] + [(f"b{i % 300}", f"c{i % 7000}") for i in range(14_000)]
    rows += [(f"c{i}", "prediction") for i in range(7000)]
    found = G.transitive_closure(edges(spark, *rows))
    want = _closure({("", *r) for r in rows})
    assert found.count() == len(want) == found.distinct().count()
    assert pairs(found) == {r[1:] for r in want}
    assert max(n for label, n in written if label == "closure") <= 300
