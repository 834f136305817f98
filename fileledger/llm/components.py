"""Connected components of a graph that is only ever seen as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileledger.operators.heavy_keys import join_groups
from fileledger.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node of a link, with the smallest node that it reaches.

    Large stars and small stars in turn: each node's neighbours are linked to the smallest of them,
    first the larger neighbours, then the smaller. The number of links never grows, and the rounds
    grow with the logarithm of the number of nodes. A node with very many neighbours is spread over
    slices where they meet their smallest. Each round is written down, so a lost executor costs part
    of a round. Loops and repeated links are ignored, links with a null too.
    """
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = cut_lineage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        large = cut_lineage(_star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), True))
        small = cut_lineage(_star(large, False))
        # In stars each larger node has one link, to a node that is nobody's larger node.
        done = small.select("u").distinct().count() == small.count() and small.select("v").join(
            small.select(F.col("u").alias("v")), "v", "left_semi"
        ).isEmpty()
        edges = small
        if done:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links of u's neighbours v, larger than u or else smaller, to the smallest of u and all v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    met = join_groups(edges, least, "u", "n", "v")
    if large:
        linked = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # Here all v are smaller than u, so m is one of them; u itself is linked to it too.
        linked = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.distinct()
