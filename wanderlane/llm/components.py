"""Connected components by alternating star operations; the graph never leaves the executors.

large-star links each larger neighbour of a node to the least node around it, small-star the smaller ones; repeated, every
component becomes a star around its least node. A round is a grouped minimum (with partial aggregation, so a hub is summed
before the shuffle) joined back to the links (by a merge, where a hub is split by the skew join; no side is broadcast). Each round is written to the shared
folder; the one before the last is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

MAX_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over links (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.hint("shuffle_merge"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is its least node. Ids are longs; loops are ignored."""
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = cut(links, "links")
    mark, most = None, links.count()  # a star operation adds no links but one for each node it ends at
    for _ in range(MAX_ROUNDS):
        large = cut(_star(links, True), "links", most=2 * most)
        small = cut(_star(large, False), "links", most=2 * most)
        drop(links, large)
        links = small
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        mark = now
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
