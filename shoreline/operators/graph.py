"""Declared dependency graphs as two tables: nodes(node, kind) and edges(parent, child).

``keys`` (for example ``("model_id",)``) keeps the graphs of many models in the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shoreline.config import DERIVED_FEATURE, MODEL_OUTPUT, NODE_KINDS, OUTPUT_NODE, RAW_INPUT
from shoreline.plans.materialize import stored
from shoreline.plans.scan import dense_index
from shoreline.plans.sizing import BROADCAST_ROWS, broadcast_if_small

_FILE_SCHEMA = (
    "edges array<array<string>>, "
    "nodes map<string, struct<kind: string, parents: array<string>>>"
)


class GraphError(ValueError):
    """The declared graph cannot be used."""


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _endpoints(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        edges.select(*keys, F.explode(F.array("parent", "child")).alias("node")).distinct()
    )


def _distinct(edges: DataFrame, keys: Sequence[str], unique: bool) -> DataFrame:
    """``parent, child``; where the caller knows that no edge repeats, as in a built graph, nothing is compared again."""
    pairs = edges.select(*keys, "parent", "child")
    return pairs if unique else pairs.distinct()


def _output_edges(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node without children feeds the output node."""
    parents = edges.select(*keys, F.col("parent").alias("node"))
    leaves = nodes.join(parents, [*keys, "node"], "left_anti")
    return leaves.select(*keys, F.col("node").alias("parent"), F.lit(OUTPUT_NODE).alias("child"))


def graph_from_edges(edges: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> Graph:
    """Kinds follow from the edges; the output node is fed by the leaves. No edge of the graph repeats.

    Edges are compared once and stored, unless they are known to be ``unique``; one aggregation over their ends tells
    what is fed and what feeds others. The graph's tables are scans of the two.
    """
    edges = stored(_distinct(edges, keys, unique), "graph-edges")
    key = [*keys, "node"]
    end = lambda c: F.struct(F.col(c).alias("node"), F.lit(c == "child").alias("fed"), F.lit(c == "parent").alias("feeds"))
    ends = edges.select(*keys, F.explode(F.array(end("parent"), end("child"))).alias("_e")).select(*keys, "_e.*")
    ends = stored(ends.groupBy(*key).agg(F.bool_or("fed").alias("fed"), F.bool_or("feeds").alias("feeds")), "graph-nodes")
    # A missing name equals no other one.
    named = F.lit(True)
    for c in key:
        named = named & F.col(c).isNotNull()
    features = ends.select(*key, F.when(named & F.col("fed"), DERIVED_FEATURE).otherwise(RAW_INPUT).alias("kind"))
    output = ends.select(*keys, F.lit(OUTPUT_NODE).alias("node"), F.lit(MODEL_OUTPUT).alias("kind"))
    leaves = ends.filter(~(named & F.col("feeds")))
    return Graph(
        features.unionByName(output.distinct()),
        edges.unionByName(leaves.select(*keys, F.col("node").alias("parent"), F.lit(OUTPUT_NODE).alias("child"))),
    )


def graph_from_nodes(declared: DataFrame, keys: Sequence[str] = ()) -> Graph:
    """From (node, kind, parents array); an output node is added where none is declared."""
    nodes = declared.select(
        *keys, "node", F.coalesce("kind", F.lit(DERIVED_FEATURE)).alias("kind")
    )
    edges = declared.select(
        *keys, F.explode("parents").alias("parent"), F.col("node").alias("child")
    ).distinct()
    outputs = nodes.filter(F.col("kind") == MODEL_OUTPUT)
    if keys:
        without = nodes.join(outputs.select(*keys).distinct(), list(keys), "left_anti")
    else:
        without = nodes if outputs.isEmpty() else nodes.filter(F.lit(False))
    feeding = without.select(*keys, "node")
    added = feeding.select(
        *keys, F.lit(OUTPUT_NODE).alias("node"), F.lit(MODEL_OUTPUT).alias("kind")
    ).distinct()
    return Graph(
        nodes.unionByName(added), edges.unionByName(_output_edges(feeding, edges, keys))
    )


def trivial_graph(features: DataFrame, keys: Sequence[str] = ()) -> Graph:
    """No declared graph: every feature feeds the output and nothing else."""
    names = features.select(*keys, "node").distinct()
    output = names.select(*keys, F.lit(OUTPUT_NODE).alias("node")).distinct()
    return Graph(
        names.withColumn("kind", F.lit(RAW_INPUT)).unionByName(
            output.withColumn("kind", F.lit(MODEL_OUTPUT))
        ),
        names.select(*keys, F.col("node").alias("parent"), F.lit(OUTPUT_NODE).alias("child")),
    )


def _accepted(graph: Graph, features: DataFrame | None) -> Graph:
    # The first few violations are enough for a message.
    found = validate_graph(graph.nodes, graph.edges, features).orderBy("rule", "subject").limit(5).collect()
    if found:
        raise GraphError("bad graph: " + ", ".join(f"{r.rule} {r.subject}" for r in found))
    return graph


def load_graph(spark: SparkSession, path: str, features: DataFrame | None = None) -> Graph:
    """Graph file: ``{"nodes": {...}}`` or ``{"edges": [[parent, child], ...]}``.

    A graph that :func:`validate_graph` objects to is an error; ``features`` (node) names those that exist.
    """
    raw = spark.read.json(path, schema=_FILE_SCHEMA, multiLine=True, mode="PERMISSIVE")
    shape = raw.agg(
        F.max(F.coalesce(F.size("nodes"), F.lit(-1))).alias("nodes"),
        F.max(F.coalesce(F.size("edges"), F.lit(-1))).alias("edges"),
        F.max(F.exists("edges", lambda e: F.size(e) != 2)).alias("malformed"),
    ).first()
    if shape.nodes and shape.nodes > 0:
        entries = raw.select(F.explode("nodes").alias("node", "v"))
        return _accepted(graph_from_nodes(entries.select("node", "v.kind", "v.parents")), features)
    if shape.edges is None or shape.edges < 0:
        raise GraphError("a graph file needs an 'edges' list or a 'nodes' map")
    if shape.edges == 0:
        raise GraphError("the graph has no edges")
    if shape.malformed:
        raise GraphError("each edge must be a [parent, child] pair")
    pairs = raw.select(F.explode("edges").alias("e"))
    ends = pairs.select(F.col("e")[0].alias("parent"), F.col("e")[1].alias("child"))
    return _accepted(graph_from_edges(ends), features)


WORD = 64  # nodes per word of a set
_BIT = "shiftleft(1L, CAST({0} % 64 AS INT))"


def _bits(rows: DataFrame, owner: Sequence[str], member: str) -> DataFrame:
    """Sets of ``member`` numbers by owner: one word of bits for every 64 numbers that occur."""
    words = rows.select(*owner, F.expr(f"{member} div {WORD}").alias("bucket"), F.expr(_BIT.format(member)).alias("word"))
    return words.groupBy(*owner, "bucket").agg(F.bit_or("word").alias("word"))


def ancestor_sets(nodes: DataFrame, edges: DataFrame, numbers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``node, bucket, word``: the ancestors of every node of an acyclic graph as words of bits.

    ``numbers`` (node, number) gives the places of the bits. A set is complete once all parents are, so it
    is passed on to the children once, round by round; a node with very many parents receives words, added up
    by bit before they move. A node inside a contracted chain adds the part of the chain above it to the set of the
    chain's head. A cycle is an error.
    """
    found = _peel(nodes, edges, keys)
    below = found.chains.join(found.tops.select(*keys, F.col("node").alias("head")), [*keys, "head"], "left_semi")
    levelled = found.tops.select(*keys, "node").unionByName(below.select(*keys, "node"))
    if not found.every.join(levelled, [*keys, "node"], "left_anti").isEmpty():
        raise GraphError("the graph contains a cycle")
    key = [*keys, "node"]
    named = lambda c: numbers.select(*keys, F.col("node").alias(c), F.col("number").alias(f"_{c}"))
    place = found.tops.select(*keys, F.col("node").alias("child"), F.col("round").alias("_round"))
    # What comes by an edge itself: the parent, or the head and the nodes of the chain between.
    ends = found.pairs.join(found.chains.select(*keys, F.col("node").alias("parent"), "head", "top"), [*keys, "parent"]).join(place, [*keys, "child"])
    between = ends.select(*keys, "child", "head", "top").join(found.chains, [*keys, "head", "top"]).select(*keys, "child", "node")
    given = found.short.select(*keys, "child", F.col("parent").alias("node")).unionByName(between)
    own = _bits(given.join(numbers, key).join(place, [*keys, "child"]), [*keys, "child", "_round"], "number")
    arrived, sets = stored(own, "arrived-0"), []
    for r in range(1, found.rounds):
        ready = arrived.filter(F.col("_round") == r).groupBy(*keys, "child", "bucket").agg(F.bit_or("word").alias("word"))
        ready = stored(ready.withColumnRenamed("child", "node"), f"sets-{r}")
        sets.append(ready)
        onward = found.short.join(place, [*keys, "child"]).join(ready.withColumnRenamed("node", "parent"), [*keys, "parent"])
        onward = onward.groupBy(*keys, "child", "_round", "bucket").agg(F.bit_or("word").alias("word"))
        arrived = arrived.unionByName(stored(onward, f"arrived-{r}"))
    whole = own.drop("_round").withColumnRenamed("child", "node").limit(0)
    for part in sets:
        whole = whole.unionByName(part)
    chains = found.chains
    above = chains.select(*keys, "head", "top", F.col("node").alias("_above"), F.col("dist").alias("_dist"))
    prefix = chains.join(above, [*keys, "head", "top"]).filter("_dist < dist").select(*key, F.col("_above").alias("_up"))
    prefix = prefix.unionByName(chains.select(*key, F.col("head").alias("_up")))
    inside = _bits(prefix.join(named("_up"), [*keys, "_up"]), key, "__up")
    inside = inside.unionByName(chains.select(*key, "head").join(whole.withColumnRenamed("node", "head"), [*keys, "head"]).select(*key, "bucket", "word"))
    return whole.unionByName(inside.groupBy(*key, "bucket").agg(F.bit_or("word").alias("word")))


LAYER_EDGES = 10_000  # a rest of no more edges is not cut into layers


def _layers(edges: DataFrame, parents: DataFrame, keys: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """Edges into nodes without children, then those into nodes whose children are all in earlier layers, and so on;
    and the rest, with every cycle in it.

    Ends with a small rest, or once a layer takes off less than half of the edges left, as in deep graphs. The first
    layer is often one output node and may be thin.
    """
    layers, size = [], edges.count()
    while size > LAYER_EDGES:
        feeding = parents.select(*keys, F.col("parent").alias("child"), F.lit(True).alias("_feeds"))
        met = stored(edges.join(feeding, [*keys, "child"], "left").select(*keys, "parent", "child", F.col("_feeds").isNotNull().alias("_feeds")), "layer")
        left = met.filter("_feeds").count()
        layers.append(met.filter("NOT _feeds").drop("_feeds"))
        edges, taken, size = met.filter("_feeds").drop("_feeds"), size - left, left
        if len(layers) > 1 and taken <= size or not taken:
            break
        parents = edges.select(*keys, "parent").distinct()
    return layers, edges


def transitive_closure(edges: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """All (ancestor, descendant) pairs, of graphs with cycles too.

    Wide layers at the bottom are taken off first. The rest is closed by doubling; then the layers are put back
    from the top. All pairs into the parents of a layer are known by then, so the pairs into its nodes are made once
    and compared with no others. The only node without children of a graph is reached from every node taken
    off, so its pairs need no join. Where pairs need not be written out, :func:`ancestor_sets` holds the same as
    words of bits.
    """
    pair = [*keys, "ancestor", "descendant"]
    edges = _distinct(edges, keys, unique).dropna()
    edges = edges if unique else stored(edges, "closure-edges")  # a built graph is stored
    parents = stored(edges.select(*keys, "parent").distinct(), "closure-parents")
    layers, core = _layers(edges, parents, keys)
    known = _doubled(core, keys)
    if not layers:
        return known
    bottom = layers[0].groupBy(*keys).agg(F.min("child").alias("child"), F.max("child").alias("_last"))
    sole = broadcast_if_small(stored(bottom.filter("child = _last").drop("_last"), "sole"))
    reached = _reaching(layers, core, known, parents, keys)
    reached = reached.join(sole, list(keys)) if keys else reached.crossJoin(sole)
    shared = layers[0].join(sole, [*keys, "child"], "left_anti")
    layers = layers[1:] if shared.isEmpty() else [shared, *layers[1:]]
    for layer in reversed(layers):
        above = known.select(*keys, "ancestor", F.col("descendant").alias("parent"))
        longer = layer.join(above, [*keys, "parent"]).select(*keys, "ancestor", F.col("child").alias("descendant"))
        direct = layer.select(*keys, F.col("parent").alias("ancestor"), F.col("child").alias("descendant"))
        known = known.unionByName(stored(direct.unionByName(longer).distinct(), "layer-pairs"))
    return known.unionByName(stored(reached.select(*keys, F.col("node").alias("ancestor"), F.col("child").alias("descendant")), "sole-pairs").select(*pair))


def _reaching(layers: Sequence[DataFrame], core: DataFrame, closed: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes from which a node of the first layer can be reached: all with children outside ``core``, and in it those
    with an edge that leaves it or with such a descendant."""
    key = [*keys, "node"]
    inside = broadcast_if_small(stored(_endpoints(core, keys), "core"))
    nodes = parents.select(*keys, F.col("parent").alias("node"))
    leaving = layers[0]
    for layer in layers[1:]:
        leaving = leaving.unionByName(layer)
    leaving = stored(leaving.select(*keys, F.col("parent").alias("node")).join(inside, key, "left_semi").distinct(), "leaving")
    above = closed.select(*keys, "ancestor", F.col("descendant").alias("node")).join(leaving, key).select(*keys, F.col("ancestor").alias("node"))
    return nodes.join(inside, key, "left_anti").unionByName(leaving.unionByName(above).distinct())


def _doubled(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closure by doubling.

    Each round extends the pairs found in the last round by every known pair. A shortest path of
    twice the length starts with a pair that was new in the last round, so the length covered
    doubles and a graph of depth d needs about log2(d) rounds.
    """
    pair = [*keys, "ancestor", "descendant"]
    known = stored(edges.select(*keys, F.col("parent").alias("ancestor"), F.col("child").alias("descendant")), "closure")
    fresh, count = known, known.count()
    while count:
        start = fresh.select(*keys, "ancestor", F.col("descendant").alias("via"))
        rest = known.select(*keys, F.col("ancestor").alias("via"), "descendant")
        longer = rest.join(
            F.broadcast(start) if count <= BROADCAST_ROWS else start, [*keys, "via"]
        )
        fresh = stored(longer.select(*pair).distinct().join(known, pair, "left_anti"), "closure")
        count = fresh.count()
        known = known.unionByName(fresh)
    return known


def pairs_of_sets(sets: DataFrame, numbers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The (ancestor, descendant) pairs of :func:`ancestor_sets`."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("word", b) == 1)
    pairs = sets.select(*keys, F.col("node").alias("descendant"), "bucket", F.explode(bits).alias("bit"))
    pairs = pairs.select(*keys, "descendant", (F.col("bucket") * WORD + F.col("bit")).alias("number"))
    return pairs.join(numbers.withColumnRenamed("node", "ancestor"), [*keys, "number"]).select(*keys, "ancestor", "descendant")


def ancestors(closure: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return closure.select(*keys, F.col("descendant").alias("node"), "ancestor")


def descendants(closure: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return closure.select(*keys, F.col("ancestor").alias("node"), "descendant")


def _chains(inner: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``node, head, dist, top``: for every inner node (of one parent and one child) the first node above it that
    is not inner, and the first node of its chain.

    Pointers are doubled, so a chain takes log2 of its length in rounds. Nodes of a closed ring of inner
    nodes have no head and are left out.
    """
    key = [*keys, "node"]
    count = inner.count()
    above = pairs.select(*keys, F.col("child").alias("node"), F.col("parent").alias("head")).join(inner, key, "left_semi")
    ahead = stored(above.select(*key, "head", F.lit(1).cast("bigint").alias("dist"), F.col("node").alias("top")), "chains")
    for _ in range(count.bit_length() + 1 if count else 0):
        onward = ahead.select(*keys, F.col("node").alias("head"), F.col("head").alias("_head"), F.col("dist").alias("_dist"), F.col("top").alias("_top"))
        moved = ahead.join(onward, [*keys, "head"], "left")
        ahead = stored(
            moved.select(*key, F.coalesce("_head", "head").alias("head"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.coalesce("_top", "top").alias("top"), F.col("_head").isNotNull().alias("_moved")), "chains"
        )
        if ahead.filter("_moved").isEmpty():
            return ahead.drop("_moved")
        ahead = ahead.drop("_moved")
    heads = inner.select(*keys, F.col("node").alias("head"))
    return ahead.join(heads, [*keys, "head"], "left_anti").select(*key, "head", "dist", "top")


PLAIN_ROUNDS = 12  # before chains are contracted


@dataclass(frozen=True)
class _Peeled:
    every: DataFrame  # node
    pairs: DataFrame  # parent, child: all edges
    chains: DataFrame  # node, head, dist, top: inner nodes of chains
    short: DataFrame  # parent, child, steps: edges of the contracted graph
    tops: DataFrame  # node, level, round: its nodes
    rounds: int


def peeled(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """``node, level``: length of the longest path from a root; null on or behind a cycle."""
    found = _peel(nodes, edges, keys, unique)
    heads = found.tops.select(*keys, F.col("node").alias("head"), F.col("level").alias("_level"))
    along = found.chains.join(heads, [*keys, "head"]).select(*keys, "node", (F.col("_level") + F.col("dist")).alias("level"))
    return found.every.join(found.tops.drop("round").unionByName(along), [*keys, "node"], "left")


def _peel(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], unique: bool = False) -> _Peeled:
    """Levels by taking off nodes without open parents.

    Round by round the children's counts of open parents are lowered. Edges that can't lower one any more are dropped
    as soon as that halves those that a round reads; the open counts add up to the edges still to come.
    What is left after ``PLAIN_ROUNDS`` is deep: its chains are contracted to one edge of their length first, so
    that the rounds are the depth of the contracted graph.
    """
    key = [*keys, "node"]
    pairs = _distinct(edges, keys, unique).dropna()
    pairs = pairs if unique else stored(pairs, "edges")  # a built graph is stored
    met = pairs.groupBy(*keys, F.col("child").alias("node")).agg(F.count("*").alias("need"))
    none = F.lit(0).cast("bigint")
    named = pairs.select(*keys, F.col("parent").alias("node")).distinct().unionByName(nodes.select(*key).dropna())
    each = met.unionByName(named.withColumn("need", none)).groupBy(*key).agg(F.sum("need").alias("need"))
    left = stored(each.withColumn("level", none), "degrees")
    every = left.select(*key)
    short, chains = pairs.withColumn("steps", F.lit(1).cast("bigint")), None
    ahead, held = short, None  # the edges a round reads, and how many they are where that is known
    done, rounds = None, 0
    while True:
        if rounds == PLAIN_ROUNDS:
            left, short, chains = _contracted(left, pairs, keys)
            ahead, held = short, None
        ready = left.filter("need = 0").select(*key, "level", F.lit(rounds).alias("round"))
        sizes = left.agg(F.count_if(F.col("need") == 0).alias("ready"), F.count_if(F.col("need") > 0).alias("open"), F.sum("need").alias("edges")).first()
        size = sizes.ready
        done = ready if done is None else done.unionByName(ready)
        if not size and (chains is not None or not sizes.open):
            break
        rounds = rounds + 1 if size else PLAIN_ROUNDS
        if not size:
            continue
        ahead, held = _still_ahead(ahead, held, left, sizes, keys)
        start = ready.select(*keys, F.col("node").alias("parent"), F.col("level").alias("_from"))
        reached = (
            ahead.join(F.broadcast(start) if size <= BROADCAST_ROWS else start, [*keys, "parent"])
            .groupBy(*keys, F.col("child").alias("node"))
            .agg(F.count("*").alias("_met"), F.max(F.col("_from") + F.col("steps")).alias("_level"))
        )
        if sizes.open > BROADCAST_ROWS:  # few of many are reached: these need not move
            reached = broadcast_if_small(stored(reached, "reached"))
        lowered = left.filter("need > 0").join(reached, key, "left")
        left = stored(
            lowered.select(*key, (F.col("need") - F.coalesce("_met", F.lit(0))).alias("need"), F.greatest("level", F.coalesce("_level", F.lit(0))).alias("level")), "open"
        )
    if chains is None:
        chains = every.select(*key, F.col("node").alias("head"), none.alias("dist"), F.col("node").alias("top")).limit(0)
    return _Peeled(every, pairs, chains, short, stored(done, "levels"), rounds)


def _still_ahead(ahead: DataFrame, held: int | None, left: DataFrame, sizes: Row, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Edges without those into nodes taken off, and without those from them if the rest is few; else as they are."""
    held = sizes.edges if held is None else held
    if sizes.edges * 2 > held or held <= BROADCAST_ROWS or sizes.open > BROADCAST_ROWS:
        return ahead, held
    end = lambda rows, c: F.broadcast(rows.select(*keys, F.col("node").alias(c)))
    ahead = ahead.join(end(left.filter("need > 0"), "child"), [*keys, "child"], "left_semi")
    if sizes.ready + sizes.open <= BROADCAST_ROWS:
        ahead = ahead.join(end(left, "parent"), [*keys, "parent"], "left_semi")
    ahead = stored(ahead, "ahead")
    return ahead, ahead.count()


def _contracted(left: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes left that are not inside a chain, all edges with those of a chain as one, and the chains."""
    key = [*keys, "node"]
    waiting = left.filter("need > 0").select(*key)
    single = lambda c: (
        pairs.select(*keys, F.col(c).alias("node")).join(waiting, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n")).filter("n = 1")
    )
    # Of one parent and one child.
    inner = stored(waiting.join(single("child"), key, "left_semi").join(single("parent"), key, "left_semi"), "inner")
    chains = stored(_chains(inner, pairs, keys), "chains")
    below = chains.select(*keys, F.col("node").alias("parent"), "head", "dist")
    short = (
        pairs.join(inner.withColumnRenamed("node", "child"), [*keys, "child"], "left_anti")
        .join(below, [*keys, "parent"], "left")
        .groupBy(*keys, F.coalesce("head", "parent").alias("parent"), "child")
        .agg(F.max(F.coalesce("dist", F.lit(0)) + 1).alias("steps"))
    )
    short = stored(short, "contracted")
    rest = stored(left.join(inner, key, "left_anti"), "open")
    waiting = short.join(left.select(*keys, F.col("node").alias("parent")), [*keys, "parent"], "left_semi")
    need = waiting.groupBy(*keys, F.col("child").alias("node")).agg(F.count("*").alias("_need"))
    left = rest.join(need, key, "left").select(*key, F.coalesce("_need", F.lit(0)).alias("need"), "level")
    return stored(left, "open"), short, chains


def node_levels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Level of each node: length of the longest path from a root; a cycle is an error."""
    found = stored(peeled(nodes, edges, keys, unique), "levels")
    if not found.filter("level IS NULL").isEmpty():
        raise GraphError("the graph contains a cycle")
    return found.withColumn("level", F.col("level").cast("int"))


def _spread(marks: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest ``mark`` from which a node can be reached, itself included."""
    key = [*keys, "node"]
    while True:
        onward = edges.join(marks.withColumnRenamed("node", "parent"), [*keys, "parent"])
        arrived = onward.groupBy(*keys, F.col("child").alias("node")).agg(F.max("mark").alias("_mark"))
        step = stored(marks.join(arrived, key, "left").select(*key, F.greatest("mark", "_mark").alias("mark"), (F.col("_mark") > F.col("mark")).alias("_grown")), "marks")
        marks = step.drop("_grown")
        if step.filter("_grown").isEmpty():
            return marks


def cyclic_nodes(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``node`` of every node that lies on a cycle.

    What peeling leaves from above and from below is empty in a sound graph. In the rest every node takes the
    largest name that reaches it; a node that keeps its own name and what reaches it under that name are
    one strongly connected part. Parts are taken off until nothing is left.
    """
    key = [*keys, "node"]
    found = nodes.select(*key).limit(0)
    while True:
        core = stored(peeled(nodes, edges, keys).filter("level IS NULL").select(*key), "behind")
        if core.isEmpty():
            return found
        inside = _inside(edges, core, keys)
        turned = inside.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("child"))
        core = stored(peeled(core, turned, keys).filter("level IS NULL").select(*key), "core")
        inside = stored(_inside(inside, core, keys), "core-edges")
        color = _spread(core.withColumn("mark", F.col("node")), inside, keys)
        own = color.withColumnRenamed("mark", "_color")
        ends = [own.select(*keys, F.col("node").alias(e), F.col("_color").alias(f"_{e}")) for e in ("parent", "child")]
        same = inside.join(ends[0], [*keys, "parent"]).join(ends[1], [*keys, "child"]).filter("_parent = _child")
        back = stored(same.select(*keys, F.col("child").alias("parent"), F.col("parent").alias("child")), "back")
        reach = _spread(color.select(*key, F.when(F.col("mark") == F.col("node"), 1).otherwise(0).alias("mark")), back, keys)
        parts = stored(reach.filter("mark = 1").select(*key).join(own, key), "parts")
        rings = parts.groupBy(*keys, "_color").agg(F.count("*").alias("n")).filter("n > 1")
        found = found.unionByName(parts.join(rings, [*keys, "_color"], "left_semi").select(*key))
        nodes = stored(core.join(parts.select(*key), key, "left_anti"), "rest")
        edges = _inside(inside, nodes, keys)


def _inside(edges: DataFrame, nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges between ``nodes``."""
    for end in ("parent", "child"):
        edges = edges.join(nodes.select(*keys, F.col("node").alias(end)), [*keys, end], "left_semi")
    return edges


def topological_order(levels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes numbered parents first; ties by name."""
    return dense_index(levels, list(keys), ["level", "node"], "position")


def feature_nodes(nodes: DataFrame, order: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes other than the model output, in topological order."""
    features = nodes.filter(F.col("kind") != MODEL_OUTPUT)
    return features.join(order, [*keys, "node"]).orderBy(*keys, "position")


def graph_neighbors(edges: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Direct parents and children, one row per neighbour."""
    pairs = _distinct(edges, keys, unique)
    return pairs.select(
        *keys, F.col("child").alias("node"), F.lit("parent").alias("relation"),
        F.col("parent").alias("neighbor"),
    ).unionByName(
        pairs.select(
            *keys, F.col("parent").alias("node"), F.lit("child").alias("relation"),
            F.col("child").alias("neighbor"),
        )
    )


def edge_list(edges: DataFrame, order: DataFrame, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Edges ordered by the position of the parent, then of the child.

    The placed edges are stored, as the sort reads them twice (range bounds, then rows).
    """
    at_parent = order.select(*keys, F.col("node").alias("parent"), F.col("position").alias("parent_pos"))
    at_child = order.select(*keys, F.col("node").alias("child"), F.col("position").alias("child_pos"))
    placed = _distinct(edges, keys, unique).join(at_parent, [*keys, "parent"]).join(at_child, [*keys, "child"])
    return stored(placed, "placed-edges").orderBy(*keys, "parent_pos", "child_pos")


def longest_chain(edges: DataFrame, unique: bool = False) -> DataFrame:
    """Longest root-to-leaf path over feature nodes as (step, node); ties by name.

    The height of each node is found first, so one successor per node is enough and paths are
    never enumerated. The successor tables of 1, 2, 4, ... steps are kept; a place on the path
    follows from the start by the tables of its binary digits, all places at once.
    """
    edges = edges.filter((F.col("parent") != OUTPUT_NODE) & (F.col("child") != OUTPUT_NODE))
    reverse = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    heights = node_levels(_endpoints(edges, ()), reverse, unique=unique)
    above = heights.select(F.col("node").alias("parent"), F.col("level").alias("height"))
    below = heights.select(F.col("node").alias("child"), F.col("level").alias("child_height"))
    leap = stored(
        _distinct(edges, (), unique)
        .join(above, "parent")
        .join(below, "child")
        .filter(F.col("child_height") == F.col("height") - 1)
        .groupBy("parent")
        .agg(F.min("child").alias("node")),
        "leap-0",
    )
    start = heights.orderBy(F.col("level").desc(), "node").limit(1).select("node", "level")
    places = start.select(F.explode(F.sequence(F.lit(0), "level")).alias("step"), "node")
    places = places.withColumn("step", F.col("step").cast("int"))
    top = start.first()
    for digit in range((top.level if top else 0).bit_length()):
        if digit:
            onward = leap.select(F.col("parent").alias("node"), F.col("node").alias("_next"))
            leap = stored(leap.join(onward, "node").select("parent", F.col("_next").alias("node")), f"leap-{digit}")
        ahead = leap.select(F.col("parent").alias("node"), F.col("node").alias("_next"))
        set_bit = F.shiftright("step", digit).bitwiseAND(1) == 1
        taken = places.filter(set_bit).join(ahead, "node").select("step", F.col("_next").alias("node"))
        places = stored(places.filter(~set_bit).unionByName(taken), "places")
    return places


def validate_graph(
    nodes: DataFrame, edges: DataFrame, features: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Every violation as (keys, rule, subject); an empty result means all graphs are valid.

    ``nodes`` holds the declared nodes and their kinds. A missing or equal endpoint, a parent
    or feature nobody declared, an unknown kind, a cycle and a node without edges are reported.
    """
    edges = edges.select(*keys, "parent", "child").distinct()
    pair = F.concat_ws("->", F.coalesce("parent", F.lit("?")), F.coalesce("child", F.lit("?")))
    complete = edges.filter(F.col("parent").isNotNull() & F.col("child").isNotNull())
    proper = complete.filter(F.col("parent") != F.col("child"))
    names = nodes.select(*keys, "node").distinct()
    used = _endpoints(proper, keys)

    def found(df: DataFrame, rule: str, subject) -> DataFrame:
        return df.select(*keys, F.lit(rule).alias("rule"), subject.alias("subject"))

    rules = [
        found(
            edges.filter(F.col("parent").isNull() | F.col("child").isNull()), "malformed_edge", pair
        ),
        found(complete.filter(F.col("parent") == F.col("child")), "self_edge", F.col("parent")),
        found(
            names.select(*keys).distinct().join(edges.select(*keys).distinct(), list(keys), "left_anti")
            if keys
            else edges.agg(F.count("*").alias("n")).filter(F.col("n") == 0),
            "no_edges",
            F.lit("graph"),
        ),
        found(nodes.filter(~F.col("kind").isin(*NODE_KINDS)), "invalid_kind", F.col("node")),
        found(
            proper.join(names.withColumnRenamed("node", "parent"), [*keys, "parent"], "left_anti"),
            "undefined_parent",
            pair,
        ),
        found(names.join(used, [*keys, "node"], "left_anti"), "orphan", F.col("node")),
        found(cyclic_nodes(names, stored(proper, "proper"), keys), "cycle", F.col("node")),
    ]
    if features is not None:
        rules.append(
            found(
                used.filter(F.col("node") != OUTPUT_NODE).join(
                    features.select(*keys, "node"), [*keys, "node"], "left_anti"
                ),
                "unknown_feature",
                F.col("node"),
            )
        )
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out
