"""Connected components by alternating large-star and small-star steps.

All state is a table of links; no step gathers the links of a node: the smallest
neighbour is a partial aggregate, and the join that hands it out starts at two
written tables, so that adaptive execution can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwater.llm.common import durable, release


def _star(directed: DataFrame) -> DataFrame:
    """Each (u, v) becomes (v, m), where m is the smallest of u and its neighbours."""
    least = durable(directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "cc-least")
    return directed.join(least, directed.u == least.w).select("u", "v", "m")


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for each node of the links src, dst; root is the smallest node of the component.

    Rows with a null end, self-links and repeats are ignored; no links give an
    empty result.  The number of rounds grows with the logarithm of the longest
    path.
    """
    edges = durable(
        links.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc-links"
    )
    while True:
        both = durable(edges.union(edges.select("v", "u")), "cc-both")
        large = durable(_star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        starred = _star(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v")))
        after = durable(small.where("u != v").distinct(), "cc-small")
        same = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        for x in (both, large, edges):
            release(x)
        edges = after
        if same:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
