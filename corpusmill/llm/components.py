"""Connected components of an edge table by alternating stars: every round joins and aggregates edges, none gathers a
node's neighbours, and rounds grow with the logarithm of a component's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link every larger (both_ways) or smaller neighbour of a node to the smallest of the node and its neighbours."""
    if both_ways:
        out = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        out = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpoint(out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = out.join(least, "u")
    if both_ways:
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return checkpoint(new.filter(F.col("u") != F.col("v")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v), two columns of a type with an order: (node, component), component being the smallest node that is
    reachable. Loops and repeated edges change nothing; a null end makes no edge; no edges give no rows."""
    u, v = edges.columns
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = checkpoint(edges)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
