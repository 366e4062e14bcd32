"""Push operators in synchronous rounds: all nodes over the threshold push at once.

state(source, node, reserve, residual). A round joins the frontier with the edges and adds what arrives to what stays;
the invariant score(t) = reserve(t) + sum over v of residual(v) * score from v to t holds after each. A push runs until no
node is over the threshold; if that takes more rounds than allowed, it raises. On graphs that fit a worker the same rounds run
there, key by key (local.py). A source that the graph does not have is a
dangling node: it pushes to itself, in closed form.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import ALPHA
from ..plans.iterate import cut, drop, short_rounds
from . import local
from .graph import Graph

BLOCK = 10_000  # targets whose pushes run together
ROUNDS, ROUNDS_IN_A_PLAN = 1000, 4  # a residual of 1 is below 1e-10 after 104 rounds, if all of it moves on


def unit_state(sources: DataFrame, name: str = "source") -> DataFrame:
    return sources.select(name, F.col(name).alias("node"), F.lit(0.0).alias("reserve"), F.lit(1.0).alias("residual"))


def _run(state: DataFrame, edges: Callable[[], DataFrame], key: str, active: Column, target: Column, share: Column, alpha: float, rounds: int, degrees: DataFrame | None = None, whole: bool = True, counts: dict | None = None) -> DataFrame:
    """Rounds of: frontier x edges -> arrivals; state -> what stays; sum. ROUNDS_IN_A_PLAN make one plan; a round without
    a frontier changes nothing, so whether there is one is asked only between plans. degrees(node, deg): the state carries
    its nodes' degrees, which arrivals bring along with the edge; a source, where dangling nodes push to, has its own row.
    whole: a frontier that is left after the rounds is an error. counts: gets the rounds and the edges that were traversed."""
    last, carried, done = None, [] if degrees is None else ["deg"], 0
    seen = [] if counts is None else ["edges"]
    arrived = [F.when(F.col("deg") > 0, F.col("dst_deg")).alias("deg")] if carried else []
    with short_rounds(state.sparkSession):
        state = state.join(degrees, "node").select(key, "node", "reserve", "residual", "deg") if carried else state
        state = cut(state.withColumn("edges", F.lit(0).cast("long")) if seen else state)
        for done in range(0, rounds, ROUNDS_IN_A_PLAN):
            if state.filter(active).isEmpty():
                break
            new, e = state, edges().drop(*carried)
            for _ in range(min(ROUNDS_IN_A_PLAN, rounds - done)):
                arrivals = new.filter(active).join(e, "node").select(key, target.alias("node"), F.lit(0.0).alias("reserve"), share.alias("residual"), *arrived, *[F.lit(0).cast("long").alias(c) for c in seen])
                stays = new.select(key, "node", F.when(active, F.col("reserve") + alpha * F.col("residual")).otherwise(F.col("reserve")).alias("reserve"), F.when(active, 0.0).otherwise(F.col("residual")).alias("residual"), *carried, *[(F.col(c) + F.when(active, F.greatest(F.col("deg"), F.lit(1))).otherwise(0)).alias(c) for c in seen])
                new = arrivals.unionByName(stays).groupBy(key, "node").agg(F.sum("reserve").alias("reserve"), F.sum("residual").alias("residual"), *[F.max(c).alias(c) for c in carried], *[F.sum(c).alias(c) for c in seen])
            new = cut(new)
            if last is not None:
                drop(last)
            last, state = state, new
        else:
            if whole and not state.filter(active).isEmpty():
                raise RuntimeError(f"nodes are above the threshold after {rounds} rounds")
    if counts is not None:
        counts |= {"edges": int(state.agg(F.coalesce(F.sum("edges"), F.lit(0))).first()[0]), "rounds": done}
    return state


def _with_lone(out: DataFrame, state: DataFrame, graph: Graph, left: Column, alpha: float) -> DataFrame:
    """out and the rows of state whose node the graph does not have, pushed onto themselves until `left` remains."""
    lone = state.join(graph.nodes.select("node"), "node", "left_anti").select("source", "node", "reserve", "residual", left.alias("left"))
    return out.unionByName(lone.select("source", "node", (F.col("reserve") + F.col("residual") - F.col("left")).alias("reserve"), F.col("left").alias("residual")))


def _degrees(graph: Graph) -> DataFrame:
    return graph.nodes.select("node", F.col("out_deg").alias("deg"))


def forward_push(graph: Graph, state: DataFrame, rmax: float, alpha: float = ALPHA, rounds: int = ROUNDS, criterion: str = "per_edge", counts: dict | None = None) -> DataFrame:
    """Push every node with residual / out-degree >= rmax ("per_edge") or residual >= rmax ("absolute").

    Dangling nodes count as degree one and push to the source. Running on from a finished state with a smaller rmax is the
    incremental push. counts: a dictionary that gets the number of rounds and of edges that were traversed.
    """
    width = F.greatest(F.col("deg"), F.lit(1))
    active = F.col("residual") / width >= rmax if criterion == "per_edge" else F.col("residual") >= rmax
    to = F.when(F.col("deg") == 0, F.col("source")).otherwise(F.col("dst"))
    if counts is None and local.fits(graph):
        out = local.push(graph, state, "source", criterion if criterion == "per_edge" else "absolute", rmax, alpha, rounds)
    else:
        out = _run(state, lambda: graph.out_edges, "source", active, to, (1 - alpha) * F.col("residual") / width, alpha, rounds, _degrees(graph), counts=counts)
    again = F.greatest(F.lit(0.0), F.floor(F.log(F.col("residual") / rmax) / -math.log(1 - alpha)) + 1)
    left = F.when(F.col("residual") >= rmax, F.col("residual") * F.pow(F.lit(1 - alpha), again)).otherwise(F.col("residual"))
    return _with_lone(out.select("source", "node", "reserve", "residual"), state, graph, left, alpha)


def reverse_push(graph: Graph, state: DataFrame, rmax: float, alpha: float = ALPHA, rounds: int = ROUNDS, own: bool = False) -> DataFrame:
    """state(target, node, reserve, residual): push residual >= rmax over in-edges, each by its source's out-degree.
    own: only the row of each target's own node is asked for."""
    if local.fits(graph, reverse=True):
        return local.push(graph, state, "target", "reverse", rmax, alpha, rounds, own=own)
    active, share = F.col("residual") >= rmax, (1 - alpha) * F.col("residual") / F.col("deg")
    return _run(state, lambda: graph.in_edges, "target", active, F.col("src"), share, alpha, rounds)


def power_iteration(graph: Graph, sources: DataFrame, rounds: int = 100, alpha: float = ALPHA) -> DataFrame:
    """source, node, score: alpha times the sum of the residuals of a fixed number of rounds; dangling nodes go to the source."""
    if local.fits(graph):
        out = local.push(graph, unit_state(sources), "source", "power", 0.0, alpha, rounds, whole=False)
    elif (scores := local.power(graph, sources, rounds, alpha)) is not None:
        return scores
    else:
        out = _run(unit_state(sources), lambda: graph.out_edges, "source", F.col("residual") > 0, F.when(F.col("deg") == 0, F.col("source")).otherwise(F.col("dst")), (1 - alpha) * F.col("residual") / F.greatest(F.col("deg"), F.lit(1)), alpha, rounds, _degrees(graph), whole=False)
    out = _with_lone(out.select("source", "node", "reserve", "residual"), unit_state(sources), graph, F.col("residual") * (1 - alpha) ** rounds, alpha)
    return out.filter("reserve > 0").select("source", "node", F.col("reserve").alias("score"))


def in_blocks(targets: DataFrame, run, block: int = BLOCK) -> DataFrame:
    """run(targets) over blocks of some `block` targets, one after the other: the state of a push from all nodes has a row for
    each target and node that reaches it, which no cluster holds at once."""
    blocks = -(-targets.count() // block)
    if blocks <= 1:
        return run(targets)
    parts = [cut(run(targets.filter(F.pmod(F.xxhash64("target"), F.lit(blocks)) == b))) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def self_scores(graph: Graph, targets: DataFrame, rmax: float, alpha: float = ALPHA, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """node, self_ppr, of each target: the reserve that a reverse push from it leaves on it."""

    def run(some: DataFrame) -> DataFrame:
        out = reverse_push(graph, unit_state(some, "target"), rmax, alpha, rounds, own=True)
        return out.filter("target = node").select("node", F.col("reserve").alias("self_ppr"))

    return run(targets.select("target")) if local.fits(graph, reverse=True) else in_blocks(targets.select("target"), run, block)


def edge_visits(graph: Graph, state: DataFrame, rmax: float) -> int:
    """Edges that one more round at rmax would visit, for the cost model."""
    deg = graph.nodes.select("node", F.col("out_deg").alias("deg"))
    row = state.join(deg, "node").filter(F.col("residual") / F.greatest("deg", F.lit(1)) >= rmax).agg(F.sum("deg")).first()
    return int(row[0] or 0)


def hitting_iteration(graph: Graph, targets: DataFrame, rounds: int, alpha: float = ALPHA) -> DataFrame:
    """target, node, score: h(t) = 1, h(i) = (1 - alpha) * mean of h over i's out-neighbours, after a number of rounds."""
    if local.fits(graph, reverse=True):
        return local.push(graph, unit_state(targets, "target"), "target", "hitting", 0.0, alpha, rounds, whole=False).select("target", "node", F.col("reserve").alias("score"))
    with short_rounds(graph.spark):
        state = cut(targets.select("target", F.col("target").alias("node"), F.lit(1.0).alias("score")))
        for _ in range(rounds):
            moved = state.join(graph.in_edges, "node").select("target", F.col("src").alias("node"), ((1 - alpha) * F.col("score") / F.col("deg")).alias("score")).filter("target <> node")
            new = moved.groupBy("target", "node").agg(F.sum("score").alias("score"))
            last, state = state, cut(new.unionByName(targets.select("target", F.col("target").alias("node"), F.lit(1.0).alias("score"))))
            drop(last)
    return state


def rounds_for(eps: float, delta: float, alpha: float = ALPHA) -> int:
    """Rounds after which what value iteration still misses is at most eps * delta."""
    k, left = 0, 1 / alpha
    while left > eps * delta:
        left *= 1 - alpha
        k += 1
    return k


def hitting_local(graph: Graph, targets: DataFrame, hops: int, rounds: int, alpha: float = ALPHA, most: int | None = None, error: float | None = None) -> DataFrame:
    """target, node, lb, ub: hitting scores on the neighbourhood within `hops` in-steps of each target.

    The value iteration runs inside the neighbourhood; edges that leave it count 0 for the lower bound and the best
    possible score outside, (1 - alpha)^(hops + 1), for the upper one. most: a target's neighbourhood that has so many nodes
    grows no further; its bound is that of the steps it grew. error: the iteration ends when no bound moves by more than that.
    """
    inside = targets.select("target", F.col("target").alias("node"), F.lit(0).alias("hop"))
    with short_rounds(graph.spark):
        inside = cut(inside)
        for hop in range(1, hops + 1):
            grown = inside.groupBy("target").agg(F.count("*").alias("n"), F.max("hop").alias("last"))
            grows = grown.filter((F.col("last") == hop - 1) & (F.col("n") < most if most else F.lit(True))).select("target")
            more = inside.filter(F.col("hop") == hop - 1).join(grows, "target", "left_semi").join(graph.in_edges, "node").select("target", F.col("src").alias("node"), F.lit(hop).alias("hop"))
            inside = cut(inside.unionByName(more).groupBy("target", "node").agg(F.min("hop").alias("hop")))
        radius = inside.groupBy("target").agg((F.max("hop") if most else F.lit(hops)).alias("radius")).select(F.col("target").alias("t"), F.pow(F.lit(1 - alpha), F.col("radius") + 1).alias("far"))
        edges = inside.join(graph.out_edges.filter("deg > 0"), "node").filter("target <> node")
        here = inside.select(F.col("target").alias("t"), F.col("node").alias("d"))
        local = edges.join(here, (F.col("target") == F.col("t")) & (F.col("dst") == F.col("d")), "left").groupBy("target", "node", "deg", F.col("d").alias("dst")).agg(F.count("*").alias("n"))
        local = cut(local.join(radius, F.col("target") == F.col("t")).drop("t"))
        state = cut(inside.select("target", "node", F.when(F.col("target") == F.col("node"), 1.0).otherwise(0.0).alias("lb"), F.lit(1.0).alias("ub")))
        for _ in range(rounds):
            at = state.select(F.col("target").alias("t"), F.col("node").alias("d"), "lb", "ub")
            step = local.join(at, (F.col("target") == F.col("t")) & (F.col("dst") == F.col("d")), "left")
            w = (1 - alpha) * F.col("n") / F.col("deg")
            new = step.groupBy("target", "node").agg(F.sum(w * F.coalesce("lb", F.lit(0.0))).alias("lb"), F.sum(w * F.coalesce("ub", F.col("far"))).alias("ub"))
            own = targets.select("target", F.col("target").alias("node"), F.lit(1.0).alias("lb"), F.lit(1.0).alias("ub"))
            last, state = state, cut(new.unionByName(own))
            if error is not None:
                both = state.join(last.select("target", "node", F.col("lb").alias("l"), F.col("ub").alias("u")), ["target", "node"])
                moved = both.agg(F.max(F.greatest(F.abs(F.col("lb") - F.col("l")), F.abs(F.col("ub") - F.col("u"))))).first()[0]
                drop(last)
                if moved is None or moved <= error:
                    break
            else:
                drop(last)
    return state
