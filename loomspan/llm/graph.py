"""Connected components without ever gathering a node's neighbours in one task. Every round is written to the shared folder.

Of a forest, where each node names one smaller neighbour, by pointer jumping: a join on node ids a round, and rounds grow with
the logarithm of the longest path. Of any edges by alternating large and small stars (Kiveris et al., 2014): two aggregations
with map-side combining and two joins a round; rounds grow with the logarithm of the components' size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.plans.shared import materialize, release


def forest(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), each node at most once and each parent smaller: the end of each node's path."""
    now = materialize(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        then = materialize(now.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        release(now)
        now = then
        if now.where("moved").isEmpty():
            return now.drop("moved")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots themselves; root is the component's smallest node.
    Repeated edges and loops count for nothing; without edges there is no row."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # Large star: each larger neighbour is tied to the smallest of the neighbourhood.
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the same for the smaller neighbours; the node itself is tied to its smallest neighbour.
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        then = materialize(small, "edges")
        after = _mark(then)
        release(now)
        if after == seen:
            now = then
            break
        now, seen = then, after
    out = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    release(now)
    return out


def united(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components that ``links`` (u, v) make of those of ``roots``: the links between roots are far fewer than all edges."""
    of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    top = components(between)
    up = top.select(F.col("node").alias("root"), F.col("root").alias("far"))
    out = roots.join(up, "root", "left").select("node", F.coalesce("far", "root").alias("root")).unionByName(top)
    out = materialize(out, "roots")
    release(top, roots)
    return out
