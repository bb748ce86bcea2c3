"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.session import materialize


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b); a component is named by its smallest node.

    Every round replaces links by links to the smallest neighbour (minima are combined before the shuffle) and
    is written, so no lineage grows; the number of rounds grows with the logarithm of the number of nodes.
    No node sees its neighbours in one place: hubs only meet their minimum in a join.
    """
    # (a, b) with a > b: b is nearer to the smallest node
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node go to its minimum
        above = edges.select(F.col("b").alias("v"), F.col("a").alias("u")).join(low, "v")
        large = above.select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "edges")
        # small star: neighbours below a node, and the node, go to its minimum
        least = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        below = large.select(F.col("a").alias("v"), F.col("b").alias("u")).join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
        edges = below.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = materialize(edges, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
