"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorlens.sources.shared import settled


def _to_least(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """Each neighbour of a node is linked to the least of the node and its neighbours.

    `pairs` are (node, other). With `keep_larger`, only neighbours above the node are
    (a large star); otherwise the node is too and all given neighbours are below (a small star).
    The least comes from an aggregate that combines on the map side, and it joins back on
    the node, where a hub's links can be split.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    linked = pairs.join(least, "node")
    if keep_larger:
        return linked.filter(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("root").alias("other")).filter("node <> other").distinct()
    own = least.select("node", F.col("root").alias("other"))
    return linked.select(F.col("other").alias("node"), F.col("root").alias("other")).unionByName(own).filter("node <> other").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id): for each node with a link, the smallest node that links reach.

    Direction, repeats and self-links do not matter; nulls link nothing. An empty table gives
    an empty one. Each round is cut off by a checkpoint; rounds grow with the logarithm of the
    longest chain, and stop when the links no longer change.
    """
    edges = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("node") != F.col("other"))).distinct()
    edges, was = settled(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _to_least(both, True)
        edges = settled(_to_least(large, False))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")).alias("s")).collect()[0]
        if (now["n"], now["s"]) == was:
            break
        was = (now["n"], now["s"])
    roots = edges.select(F.col("other").alias("node"), F.col("other").alias("component_id")).distinct()
    return edges.select("node", F.col("other").alias("component_id")).unionByName(roots)
