"""Single-source scores: personalised PageRank (ppr) and discounted hitting (dht = ppr(s, t) / ppr(t, t)).

All take a batch of sources (column source) and give (source, node, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import ALPHA
from ..functions.rng import RANGE, draw
from ..plans.iterate import cut
from .graph import Graph
from .push import forward_push, in_blocks, reverse_push, unit_state
from .topk import kth_score
from .walks import starts_from, walks

#: Keeps the ceiling of a whole number that a sum in another order would put just above it.
SLACK = 1e-9
PART = 1 << 16  # node ids whose residuals are summed in one task


def reserves(state: DataFrame) -> DataFrame:
    return state.filter("reserve <> 0").select("source", "node", F.col("reserve").alias("score"))


def push_only(graph: Graph, sources: DataFrame, rmax: float, **options) -> DataFrame:
    return reserves(forward_push(graph, unit_state(sources), rmax, **options))


def walk_counts(state: DataFrame, omega: float) -> DataFrame:
    """source, node, residual, n: walks to start from each residual, in proportion to it; rsum: the residuals' sum."""
    sums = state.groupBy("source").agg(F.sum("residual").alias("rsum"))
    n = F.ceil(F.col("residual") / F.col("rsum") * F.floor(F.lit(omega) * F.col("rsum") + SLACK) - SLACK)
    return state.filter("residual > 0").join(sums, "source").select("source", "node", "residual", "rsum", F.greatest(n, F.lit(1)).cast("long").alias("n"))


def with_walks(state: DataFrame, counts: DataFrame, ends: DataFrame) -> DataFrame:
    """Reserves, and the residuals carried to where walks end. ends(origin, start, walk_no, node)."""
    moved = ends.join(counts.select(F.col("source").alias("origin"), F.col("node").alias("start"), "residual", "n"), ["origin", "start"])
    parts = moved.select(F.col("origin").alias("source"), "node", (F.col("residual") / F.col("n")).alias("score")).unionByName(reserves(state))
    return parts.groupBy("source", "node").agg(F.sum("score").alias("score"))


def residual_starts(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("source").alias("origin"), F.col("node").alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("walk_no"))


def push_walk(graph: Graph, sources: DataFrame, rmax: float, omega: float, state: DataFrame | None = None, **options) -> DataFrame:
    """Forward push, then walks from what is left."""
    state = forward_push(graph, unit_state(sources), rmax) if state is None else state
    counts = cut(walk_counts(state, omega))
    return with_walks(state, counts, walks(graph, residual_starts(counts), **options))


def push_walk_indexed(graph: Graph, sources: DataFrame, rmax: float, omega: float, index: DataFrame) -> DataFrame:
    """The same with walks taken from an index (src, walk_no, dst): equal scores where no walk meets a dangling node."""
    state = forward_push(graph, unit_state(sources), rmax)
    counts = cut(walk_counts(state, omega))
    held = counts.join(index, counts["node"] == index["src"]).filter("walk_no <= n")
    return with_walks(state, counts, held.select(F.col("source").alias("origin"), F.col("src").alias("start"), "walk_no", F.col("dst").alias("node")))


def push_walk_cached(graph: Graph, sources: DataFrame, rmax: float, omega: float, cache: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The same with a cache of walk ends (src, walk_no, dst): only missing walks run, and are added. (scores, new cache)"""
    state = forward_push(graph, unit_state(sources), rmax)
    counts = cut(walk_counts(state, omega))
    need = counts.groupBy(F.col("node").alias("src")).agg(F.max("n").alias("n"))
    have = cache.groupBy("src").agg(F.max("walk_no").alias("have"))
    missing = need.join(have, "src", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("n > have")
    starts = missing.select(F.col("src").alias("origin"), F.col("src").alias("start"), F.explode(F.sequence(F.col("have") + 1, F.col("n"))).alias("walk_no"))
    new = walks(graph, starts, **options).select(F.col("start").alias("src"), "walk_no", F.col("node").alias("dst"))
    full = cut(cache.select("src", "walk_no", "dst").unionByName(new))
    held = counts.join(full, counts["node"] == full["src"]).filter("walk_no <= n")
    return with_walks(state, counts, held.select(F.col("source").alias("origin"), F.col("src").alias("start"), "walk_no", F.col("dst").alias("node"))), full


def push_walk_sampled(state: DataFrame, draws: int, salt: str = "sample") -> DataFrame:
    """source, draw, node: residual nodes sampled in proportion to their residual, by inverting their running sums.

    Running sums are made in two levels, of PART nodes and of parts, so that no task sorts all residuals of a source. A draw
    finds its part among the ends of parts and its node among the ends in the part: ends and draws are sorted together, and
    each draw takes the next end.
    """
    held = state.filter("residual > 0").select("source", "node", "residual", F.floor(F.col("node") / PART).alias("part"))
    parts = held.groupBy("source", "part").agg(F.sum("residual").alias("residual"))
    up = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    parts = parts.withColumn("upto", F.sum("residual").over(up("source", "part")))
    total = parts.groupBy("source").agg(F.max("upto").alias("rsum"))
    at = draw(salt, F.col("source"), F.col("draw")) / F.lit(float(RANGE)) * F.col("rsum")
    wanted = total.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")))).select("source", "draw", at.alias("at"))

    def next_end(ends: DataFrame, asked: DataFrame, keys: list[str], value: str) -> DataFrame:
        """asked with the value of the first end above at, among ends with the same keys."""
        both = ends.select(*keys, F.col("upto").alias("at"), F.lit(None).cast("long").alias("draw"), value)
        both = both.unionByName(asked.withColumn(value, F.lit(None).cast("long")))
        # An end at the very place of a draw is not above it, and goes before; the last end holds what rounding leaves over.
        ahead = Window.partitionBy(*keys).orderBy("at", F.col("draw").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
        whole = Window.partitionBy(*keys).orderBy("at", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = F.coalesce(F.first(value, ignorenulls=True).over(ahead), F.last(value, ignorenulls=True).over(whole))
        return both.withColumn("found", found).filter("draw is not null").drop(value).withColumnRenamed("found", value)

    chosen = next_end(parts.select("source", "part", "upto"), wanted, ["source"], "part")
    before = parts.select("source", "part", (F.col("upto") - F.col("residual")).alias("base"))
    chosen = chosen.join(before, ["source", "part"]).select("source", "part", "draw", (F.col("at") - F.col("base")).alias("at"))
    ends = held.join(chosen.select("source", "part").distinct(), ["source", "part"], "left_semi").withColumn("upto", F.sum("residual").over(up("source", "part", "node")))
    return next_end(ends.select("source", "part", "node", "upto"), chosen, ["source", "part"], "node").select("source", "draw", "node")


def push_walk_drawn(graph: Graph, sources: DataFrame, rmax: float, draws: int, state: DataFrame | None = None, **options) -> DataFrame:
    """source, node, score: reserves, and walks from nodes drawn in proportion to their residual, each of the same weight."""
    state = forward_push(graph, unit_state(sources), rmax) if state is None else state
    sums = state.groupBy("source").agg(F.sum("residual").alias("rsum"))
    starts = push_walk_sampled(state, draws).select(F.col("source").alias("origin"), F.col("node").alias("start"), F.col("draw").alias("walk_no"))
    ends = walks(graph, starts, **options).join(sums.withColumnRenamed("source", "origin"), "origin")
    parts = ends.select(F.col("origin").alias("source"), "node", (F.col("rsum") / F.lit(float(draws))).alias("score")).unionByName(reserves(state))
    return parts.groupBy("source", "node").agg(F.sum("score").alias("score"))


def unresolved(graph: Graph, state: DataFrame) -> DataFrame:
    """source, nodes: how many nodes with out-edges have no residual."""
    left = state.filter("residual > 0").join(graph.nodes.filter("out_deg > 0").select("node"), "node", "left_semi").groupBy("source").agg(F.count("*").alias("with"))
    total = graph.nodes.filter("out_deg > 0").agg(F.count("*").alias("all"))
    sources = state.select("source").distinct()
    return sources.join(left, "source", "left").join(F.broadcast(total)).select("source", (F.col("all") - F.coalesce("with", F.lit(0))).alias("nodes"))  # one row


def end_counts(graph: Graph, sources: DataFrame, count: int, **options) -> DataFrame:
    """source, node, cnt of count walks from each source."""
    ends = walks(graph, starts_from(sources, count), **options)
    return cut(ends.groupBy(F.col("origin").alias("source"), "node").agg(F.count("*").alias("cnt")))


def bippr(graph: Graph, sources: DataFrame, targets: DataFrame, rmax: float, count: int, counts: DataFrame | None = None, **options) -> DataFrame:
    """Reverse push from every target, met by walks from the source; plain walks if rmax >= 1."""
    counts = end_counts(graph, sources, count, **options) if counts is None else counts
    if rmax >= 1:
        return counts.select("source", "node", (F.col("cnt") / F.lit(float(count))).alias("score"))

    def run(some: DataFrame) -> DataFrame:
        return met_by_walks(reverse_push(graph, unit_state(some, "target"), rmax), sources, counts, count)

    return in_blocks(targets.select("target"), run)


def met_by_walks(pushed: DataFrame, sources: DataFrame, counts: DataFrame, count: int) -> DataFrame:
    """source, node, score from reverse pushes (target, node, reserve, residual) and counts (source, node, cnt) of walk ends."""
    direct = pushed.filter("reserve > 0").join(sources.select("source"), F.col("node") == F.col("source")).select("source", F.col("target").alias("node"), F.col("reserve").alias("score"))
    met = pushed.filter("residual > 0").join(counts, "node").select("source", F.col("target").alias("node"), (F.col("residual") * F.col("cnt") / F.lit(float(count))).alias("score"))
    return direct.unionByName(met).groupBy("source", "node").agg(F.sum("score").alias("score"))


def pairwise(graph: Graph, pairs: DataFrame, rmax: float, count: int, **options) -> DataFrame:
    """source, node, score of the pairs (source, node) only."""
    scores = bippr(graph, pairs.select("source").distinct(), pairs.select(F.col("node").alias("target")).distinct(), rmax, count, **options)
    return pairs.join(scores, ["source", "node"], "left").select("source", "node", F.coalesce("score", F.lit(0.0)).alias("score"))


def self_by_walks(graph: Graph, targets: DataFrame, rmax: float, count: int, counts: DataFrame | None = None, state: DataFrame | None = None, **options) -> DataFrame:
    """node, self_ppr, reserve of each target: reverse push, met by the target's own walks. state: the reverse push, if known."""
    counts = end_counts(graph, targets.select(F.col("target").alias("source")), count, **options) if counts is None else counts
    if state is None:
        return in_blocks(targets.select("target"), lambda some: self_by_walks(graph, some, rmax, count, counts, reverse_push(graph, unit_state(some, "target"), rmax)))
    pushed = state
    own = pushed.filter("target = node").select(F.col("target").alias("node"), F.col("reserve").alias("self_ppr"), "reserve")
    c = counts.select(F.col("source").alias("target"), "node", "cnt")
    met = pushed.filter("residual > 0").join(c, ["target", "node"]).select(F.col("target").alias("node"), (F.col("residual") * F.col("cnt") / F.lit(float(count))).alias("self_ppr"), F.lit(None).cast("double").alias("reserve"))
    return own.unionByName(met).groupBy("node").agg(F.sum("self_ppr").alias("self_ppr"), F.max("reserve").alias("reserve"))


def ratio(ppr: DataFrame, own: DataFrame, above: float | Column = 0.0) -> DataFrame:
    """dht from ppr and self scores, for ppr above a threshold; at most 1."""
    return ppr.filter(F.col("score") > above).join(own.select("node", "self_ppr"), "node").select("source", "node", F.least(F.col("score") / F.col("self_ppr"), F.lit(1.0)).alias("score"))


def hitting_raw(graph: Graph, sources: DataFrame, rmax: float, omega: float, rmax_self: float, count_self: int, above: float = 0.0, best: int | None = None, **options) -> DataFrame:
    """dht: push and walk, then reverse push and walks for each node above the threshold. best: only the nodes that can be among
    so many best by dht; a self score is between alpha and 1, so these have alpha times the ppr of the best-th by ppr at least."""
    ppr = cut(push_walk(graph, sources, rmax, omega, **options))
    if best:
        ppr = cut(ppr.join(kth_score(ppr, best), "source").filter(F.col("score") >= ALPHA * F.col("kth")).select("source", "node", "score"))
    targets = cut(ppr.filter(F.col("score") > above).select(F.col("node").alias("target")).distinct())
    return ratio(ppr, self_by_walks(graph, targets, rmax_self, count_self, **options), above)


def hitting_shared(graph: Graph, sources: DataFrame, rmax: float, omega: float, rmax_self: float, count_self: int, above: float = 0.0, **options) -> DataFrame:
    """dht with one batch of walks per node for both estimates: each uses the first walks that it needs."""
    state = forward_push(graph, unit_state(sources), rmax)
    counts = cut(walk_counts(state, omega))
    reach = state.filter(F.col("reserve") + F.col("residual") > 0).select("node").distinct()
    need = counts.groupBy("node").agg(F.max("n").alias("n")).join(reach, "node", "full").select("node", F.greatest(F.coalesce("n", F.lit(0)), F.lit(count_self)).alias("n"))
    starts = need.select(F.col("node").alias("origin"), F.col("node").alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("walk_no"))
    ends = cut(walks(graph, starts, **options).select("start", "walk_no", "node"))
    held = counts.select(F.col("source").alias("origin"), F.col("node").alias("start"), "n").join(ends, "start").filter("walk_no <= n").drop("n")
    ppr = cut(with_walks(state, counts, held))
    targets = cut(ppr.filter(F.col("score") > above).select(F.col("node").alias("target")).distinct())
    mine = ends.filter(F.col("walk_no") <= count_self).groupBy(F.col("start").alias("source"), "node").agg(F.count("*").alias("cnt"))
    extra = targets.join(need, F.col("target") == F.col("node"), "left_anti").select(F.col("target").alias("source"))
    mine = mine.unionByName(end_counts(graph, extra, count_self, **options))
    return ratio(ppr, self_by_walks(graph, targets, rmax_self, count_self, counts=mine), above)
