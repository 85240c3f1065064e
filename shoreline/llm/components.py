"""Connected components of a table of links, by least label with pointer jumping.

Every round is a few joins and map-side combined minima over stored tables, so a node with very many
links is no hot key, and a lost executor repeats tasks of one round only. Nothing is collected but
the number of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.plans.materialize import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` of every node that occurs in ``links``; label is the smallest node reachable."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = stored(both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near")), "near")
        hooked = stored(
            labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "hooked"
        )
        roots = hooked.select(F.col("node").alias("root"), F.col("label").alias("top"))
        jumped = stored(hooked.join(roots, hooked["label"] == roots["root"]).select("node", "before", F.least("label", "top").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> before").count():
            return labels
