"""Random walks that stop with probability alpha before each step.

A walk's numbers are a hash of (salt, start, number, step), so its length is known before it moves, a longer run of walks
contains the shorter one, and walks can be cached, indexed and recomputed. On graphs that fit a worker the walkers move there
(local.py), all steps in one job. On others a step is a join of the walkers with the numbered edges on (node, drawn
number): it reads one edge, and the walkers at a hub are spread over its edges. Several steps make one plan, then the
walkers are written out.

Dangling nodes: a walker that must leave one goes to `origin` (restart="source"), to where it started ("start"), or stays
for good ("none").
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import ALPHA
from ..functions.rng import below, draw
from ..plans.iterate import cut, short_rounds
from . import local
from .graph import Graph

STEPS, STEPS_IN_A_PLAN = 60, 6
FEW, MANY_EDGES = 200_000, 1 << 20  # so few walkers are broadcast to so many edges, a step a plan


def walks(graph: Graph, starts: DataFrame, salt: str = "walk", alpha: float = ALPHA, steps: int = STEPS, restart: str = "source", trace: bool = False, halt: DataFrame | None = None) -> DataFrame:
    """starts(origin, start, walk_no) -> the same with `node`, where the walk ends.

    halt(node): a walk that comes to one of these nodes stays there, and `halted` is its step there (null: it ended by itself).
    Starts that have `node` and `halted` go on from there; a walk that was halted and goes on is the walk that was not.

    trace: a row for each visited node instead (with `step`). A walk that has not stopped after `steps` steps ends there, which
    happens to (1 - alpha)^steps of them: 1.5e-6 of them at 60.
    """
    if halt is None and "halted" not in starts.columns and local.fits(graph):
        return local.walk(graph, starts, salt, alpha, steps, restart, trace)
    stops = F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: draw(salt, F.lit("stop"), F.col("start"), F.col("walk_no"), k) < below(alpha))
    now = starts.select("origin", "start", "walk_no", F.coalesce(F.get(stops, F.lit(0)), F.lit(steps)).alias("length"), *(("node", F.col("halted").alias("step")) if "halted" in starts.columns else (F.col("start").alias("node"), F.lit(0).alias("step"))), F.lit(None).cast("int").alias("halted"))
    if trace:
        now = now.withColumn("path", F.array("start"))
    few = graph.entries > MANY_EDGES and starts.count() <= FEW
    edges = None if few else graph.numbered_edges.withColumnRenamed("node", "from")
    degrees = graph.placed
    now = now.join(degrees, "node", "left").withColumns({"deg": F.coalesce("deg", F.lit(0)), "list": F.coalesce("list", "node")})
    back = {"source": F.col("origin"), "start": F.col("start"), "none": F.col("node")}[restart]
    back_deg = {"source": F.col("origin_deg"), "start": F.col("start_deg"), "none": F.lit(0)}[restart]
    back_list = {"source": F.col("origin_list"), "start": F.col("start_list"), "none": F.col("list")}[restart]
    for end in {"source": ["origin"], "start": ["start"], "none": []}[restart]:
        at_end = degrees.select(F.col("node").alias(end), F.col("deg").alias(f"{end}_deg"), F.col("list").alias(f"{end}_list"))
        now = now.join(at_end, end, "left").withColumns({f"{end}_deg": F.coalesce(f"{end}_deg", F.lit(0)), f"{end}_list": F.coalesce(f"{end}_list", end)})
    halts, back_halts = F.lit(False), F.lit(False)
    if halt is not None:
        marks = halt.select("node").distinct().withColumn("halts", F.lit(True))
        marked = lambda e: e.join(marks.withColumnRenamed("node", "dst"), "dst", "left")
        edges = None if few else cut(marked(edges))
        now = now.join(marks.select(F.col("node").alias("back"), F.col("halts").alias("back_halts")), back == F.col("back"), "left").drop("back")
        halts, back_halts = F.coalesce("halts", F.lit(False)), F.coalesce("back_halts", F.lit(False))
    parts, at, in_a_plan = [], 0, 1 if few else STEPS_IN_A_PLAN
    now = cut(now) if few else now
    most = now.agg(F.max("length")).first()[0] or 0 if few else steps
    with short_rounds(graph.spark):
        while at < max(1, min(steps, most)):
            for k in range(at, min(at + in_a_plan, steps)):
                moves = (F.col("length") > k) & (F.col("step") <= k) & F.col("halted").isNull()
                # Walkers that take no edge match nothing, under numbers of their own, so that they do not meet in one task.
                n = F.pmod(draw(salt, F.lit("move"), F.col("start"), F.col("walk_no"), F.lit(k)), F.greatest(F.col("deg"), F.lit(1)))
                now = now.withColumn("number", F.when(moves & (F.col("deg") > 0), n).otherwise(-1 - F.abs(F.hash("start", "walk_no").cast("long"))))
                if few:
                    edges = graph.numbered_among(now.filter("number >= 0").select("list", F.col("number").alias("at"))).withColumnRenamed("node", "from")
                    edges = F.broadcast(edges if halt is None else marked(edges))
                taken = F.col("dst").isNotNull()
                node = F.when(taken, F.col("dst")).when(moves, back).otherwise(F.col("node"))
                deg = F.when(taken, F.col("dst_deg")).when(moves, back_deg).otherwise(F.col("deg"))
                at_list = F.when(taken, F.col("dst_list")).when(moves, back_list).otherwise(F.col("list"))
                stays = F.when(moves & F.when(taken, halts).otherwise(back_halts), F.lit(k + 1)).otherwise(F.col("halted"))
                joined = now.join(edges, (F.col("list") == F.col("from")) & (F.col("number") == F.col("at")), "left").withColumns({"node": node, "deg": deg, "list": at_list, "halted": stays})
                now = joined.withColumn("path", F.when(moves, F.concat("path", F.array("node"))).otherwise(F.col("path"))) if trace else joined
                now = now.drop("number", "from", "at", "dst", "dst_deg", "dst_list", "halts")
            at = min(at + in_a_plan, steps)
            now = cut(now)
            over = (F.col("length") <= at) | F.col("halted").isNotNull()
            parts.append(now.filter(over))
            now = now.filter(~over)
            if (not few or halt is not None) and now.isEmpty():
                break
    done = reduce(DataFrame.unionByName, parts)
    if trace:
        return done.select("origin", "start", "walk_no", F.posexplode("path").alias("step", "node"))
    return done.select("origin", "start", "walk_no", "node", *(["halted"] if halt is not None else []))


def starts_from(sources: DataFrame, count: int) -> DataFrame:
    """count walks from each source: (origin, start, walk_no from 1)."""
    return sources.select(F.col("source").alias("origin"), F.col("source").alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long"))).alias("walk_no"))


def monte_carlo(graph: Graph, sources: DataFrame, count: int, **options) -> DataFrame:
    """source, node, score: the share of walks that end at node."""
    ends = walks(graph, starts_from(sources, count), **options)
    return ends.groupBy(F.col("origin").alias("source"), "node").agg((F.count("*") / F.lit(float(count))).alias("score"))


def monte_carlo_hitting(graph: Graph, sources: DataFrame, count: int, **options) -> DataFrame:
    """source, node, score: the share of walks that visit node, the start included."""
    seen = walks(graph, starts_from(sources, count), trace=True, **options)
    once = seen.select("origin", "walk_no", "node").distinct()
    return once.groupBy(F.col("origin").alias("source"), "node").agg((F.count("*") / F.lit(float(count))).alias("score"))
