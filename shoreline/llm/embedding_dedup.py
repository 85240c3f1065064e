"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again by random directions, at a random quantile of
a bounded sample (``sample`` vectors in expectation), until a leaf is expected to hold ``leaf`` vectors of
the label; the depth follows the label's count over all rows. A vector near a split goes to both sides.
All vectors are placed in the leaves of all trees; those that share a leaf are compared by their cosine
in double precision, in blocks, so a leaf of any size is compared whole. Each link is counted in the first
leaf its two vectors share, so counts need no list of pairs; of the links only a spanning subset per
leaf is returned, for the components.

Vectors that are null, zero, or hold null or non-finite components, and vectors without a label or id, link with
nothing. Vectors of different lengths don't link. Equal vectors of a label are one class with a count. Rows
that repeat an id are vectors of their own with a common component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.llm.components import components
from shoreline.llm.minhash import spanning
from shoreline.plans.materialize import stored

THRESHOLD = 0.93
TREES, LEAF, SPILL, SAMPLE = 6, 256, 0.02, 20_000
BLOCK = 1024
_FEWEST = 16  # sample vectors below which a split is put at 0


class Forest:
    """Directions by tree and level, and the split points of the nodes that the sample reaches."""

    def __init__(self, sample: np.ndarray, dimension: int, *, trees: int, deepest: int, seed: int = 11):
        rng = np.random.default_rng([seed, dimension])
        self.directions = rng.standard_normal((trees, deepest, dimension))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits: list[dict[int, float]] = []
        for tree in range(trees):
            splits: dict[int, float] = {}
            level = [(1, np.arange(len(sample)))]
            for depth in range(deepest):
                lower = []
                for node, held in level:
                    if len(held) < _FEWEST:
                        continue
                    at = sample[held] @ self.directions[tree, depth]
                    splits[node] = float(np.quantile(at, rng.uniform(0.35, 0.65)))
                    low = at < splits[node]
                    lower += [(2 * node, held[low]), (2 * node + 1, held[~low])]
                level = lower
            self.splits.append(splits)

    def leaves(self, units: np.ndarray, depth: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, tree and leaf as one number): every leaf of every tree that a row falls into."""
        rows, names = [], []
        trees = len(self.splits)
        for tree, splits in enumerate(self.splits):
            row, node = np.arange(len(units)), np.ones(len(units), dtype=np.int64)
            for level in range(int(depth.max(initial=0))):
                deeper = depth[row] > level
                at = units @ self.directions[tree, level]
                known, back = np.unique(node, return_inverse=True)
                point = np.array([splits.get(int(n), 0.0) for n in known])[back]
                left = deeper & (at[row] < point + spill)
                right = deeper & (at[row] >= point - spill)
                row, node = (
                    np.concatenate([row[~deeper], row[left], row[right]]),
                    np.concatenate([node[~deeper], 2 * node[left], 2 * node[right] + 1]),
                )
            rows.append(row)
            names.append(node * trees + tree)
        return np.concatenate(rows), np.concatenate(names)


def _units(vectors: list[bytes]) -> np.ndarray:
    raw = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    # Divide by the largest component first: squares of very large or small numbers leave the range.
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for v in batch.column(2).to_pylist():
            raw = np.array(v if v and None not in v else [np.nan], dtype=np.float64)
            found.append((raw + 0.0).tobytes() if np.isfinite(raw).all() and raw.any() else None)
        digests = [None if v is None else hashlib.md5(v).digest() for v in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["_id", "_label", "_same", "_vector"])


def _compare(threshold: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids, copies, own = (group[c].to_numpy() for c in ("_first", "copies", "_own"))
        units = _units(group["_vector"].tolist())
        linked = units @ units.T >= threshold
        np.fill_diagonal(linked, False)
        i, j, here = group["_i"].iloc[0], group["_j"].iloc[0], group["_leaf"].iloc[0]
        if i != j:
            linked &= own[:, None] != own[None, :]
        if not linked.any():
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        # Leaves before this one, by member: pairs that share one were counted there.
        earlier = [[x for x in leaves if x < here] for leaves in group["_leaves"]]
        names = {x: k for k, x in enumerate(sorted({x for e in earlier for x in e}))}
        held = np.zeros((len(ids), len(names)), dtype=np.float32)
        for row, e in enumerate(earlier):
            held[row, [names[x] for x in e]] = 1
        counted = linked & ~((held @ held.T) > 0)
        n = counted @ copies
        edges = spanning(np.argwhere(np.triu(linked, 1)), len(ids))
        some = np.flatnonzero(n)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], [ids[x] for x, _ in edges]]).astype("int64"),
            "b": np.concatenate([np.full(len(some), -1), [ids[y] for _, y in edges]]).astype("int64"),
            "n": np.concatenate([n[some], np.zeros(len(edges))]).astype("int64"),
        })

    return compare


def linked_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    *,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per row of ``vectors``: ``key, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    read = vectors.select(vectors[key].cast("bigint").alias("_id"), vectors[label].cast("string").alias("_label"), vectors[embedding].cast("array<double>").alias("_v"))
    digested = stored(read.mapInArrow(_digest, "_id bigint, _label string, _same binary, _vector binary"), "vectors")
    valid = digested.where("_id IS NOT NULL AND _label IS NOT NULL AND _same IS NOT NULL")
    classes = stored(
        valid.groupBy("_label", F.length("_vector").alias("_bytes"), "_same").agg(F.min("_id").alias("_first"), F.count("*").alias("copies"), F.first("_vector").alias("_vector")),
        "vector-classes",
    )
    sizes = classes.groupBy("_label", "_bytes").agg(F.count("*").alias("_n"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / float(leaf)))).cast("int")
    deep = stored(sizes.select("_label", "_bytes", depth.alias("_depth")), "depths")
    facts = deep.agg(F.max("_depth").alias("deepest"), F.collect_set("_bytes").alias("lengths")).first()
    total = classes.count()
    drawn = classes.where(F.pmod(F.xxhash64("_first", F.lit("sample")), F.lit(1 << 30)) < min(1.0, sample / max(total, 1)) * (1 << 30))
    by_length: dict[int, list[bytes]] = {n: [] for n in facts["lengths"]}
    for r in drawn.select("_bytes", "_vector").collect():
        by_length[r["_bytes"]].append(bytes(r["_vector"]))
    forests = {n: Forest(_units(v) if v else np.zeros((0, n // 8)), n // 8, trees=trees, deepest=facts["deepest"] or 0) for n, v in by_length.items()}
    shared = spark.sparkContext.broadcast(forests)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, vector, depths = batch.column(2).to_numpy(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            lists: list[list[int]] = [[] for _ in vector]
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                row, name = shared.value[int(n)].leaves(_units([vector[i] for i in at]), depths[at], spill)
                for r, x in zip(at[row].tolist(), name.tolist()):
                    lists[r].append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(x) for x in lists], pa.list_(pa.int64()))], names=["_first", "_leaves"])

    ready = classes.join(deep, ["_label", "_bytes"]).select("_first", "_vector", "_bytes", "_depth")
    leaves = stored(ready.mapInArrow(place, "_first bigint, _leaves array<bigint>"), "leaves")
    placed = leaves.join(classes, "_first").select("_label", "_bytes", "_first", "copies", "_vector", "_leaves", F.explode("_leaves").alias("_leaf"))
    each = leaves.join(classes.select("_first", "_label", "_bytes"), "_first").select("_label", "_bytes", F.explode("_leaves").alias("_leaf"))
    counted = stored(each.groupBy("_label", "_bytes", "_leaf").agg(F.count("*").alias("_m")).where("_m > 1"), "leaf-sizes")
    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    cut = placed.join(counted, ["_label", "_bytes", "_leaf"]).withColumn("_own", F.pmod(F.xxhash64("_first", F.lit("block")), blocks).cast("int"))
    paired = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with"))
    found = stored(paired.drop("_with", "_m").groupBy("_label", "_bytes", "_leaf", "_i", "_j").applyInPandas(_compare(threshold), "a bigint, b bigint, n bigint"), "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("_first")).agg(F.sum("n").alias("_links"))
    grouped = components(found.where("n = 0").select("a", "b")).select(F.col("node").alias("_first"), "label")
    final = stored(
        classes.join(counts, "_first", "left").join(grouped, "_first", "left").select(
            F.col("_label").alias("_l"), F.col("_bytes").alias("_b"), F.col("_same").alias("_s"),
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "_first").alias("component_id"),
        ),
        "vector-labels",
    )
    same = (F.col("_label") == F.col("_l")) & (F.length("_vector") == F.col("_b")) & (F.col("_same") == F.col("_s"))
    joined = digested.join(final, same & F.col("_id").isNotNull(), "left")
    component = F.coalesce("component_id", "_id")
    return joined.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS top FROM embeddings UNION SELECT l.b, r.top FROM r JOIN l ON r.node = l.a WHERE r.top < l.b),
c AS (SELECT node, min(top) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
