"""Top-k searches: rounds of refinement from persisted push state until bounds settle the k best of every source."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..plans.iterate import cut
from . import bounds as B
from .estimators import met_by_walks, reserves, residual_starts, self_by_walks, walk_counts, with_walks
from .graph import Graph
from .index import hub_walks
from .push import edge_visits, forward_push, in_blocks, reverse_push, unit_state
from .topk import top_k
from .walks import walks


def _round(graph: Graph, state: DataFrame, omega: float, **options) -> DataFrame:
    """source, node, score, reserve, rsum, walks after walks from the residuals of a state."""
    counts = cut(walk_counts(state, omega))
    scores = with_walks(state, counts, walks(graph, residual_starts(counts), **options)) if not counts.isEmpty() else reserves(state)
    total = counts.groupBy("source").agg(F.first("rsum").alias("rsum"), F.sum("n").alias("walks"))
    d = scores.join(state.select("source", "node", "reserve"), ["source", "node"], "left").join(total, "source", "left")
    return cut(d.select("source", "node", "score", F.coalesce("reserve", F.lit(0.0)).alias("reserve"), F.coalesce("rsum", F.lit(0.0)).alias("rsum"), F.coalesce("walks", F.lit(1)).alias("walks")))


def ppr_search(graph: Graph, sources: DataFrame, k: int, eps: float, least_delta: float | None = None, **options) -> DataFrame:
    """source, rank, node, score: delta halves from 1/4 until each source's k best are settled, or delta is 1/n."""
    n, m = graph.sizes
    least = max(1 / n, least_delta or 0)
    p = P.defaults(n, m, eps, 0.25, P.topk_pfail(n))
    threshold, open_, known, done = P.bound_threshold(n), cut(sources.select("source").distinct()), None, []
    state = unit_state(open_)
    while True:
        now = P.push_walk(p)
        state = cut(forward_push(graph, state, now.rmax))  # read many times, and by the next round
        found = cut(B.ppr_bounds(_round(graph, state, now.walks, **options), n, p.pfail, known))
        last = p.delta <= least
        stop = found.select("source").distinct() if last else B.stops(found, k, eps, p.delta, threshold).filter("stop").select("source")
        stop = cut(stop)
        done.append(top_k(found.join(stop, "source", "left_semi"), k))
        open_ = cut(open_.join(stop, "source", "left_anti"))
        if last or open_.isEmpty():
            break
        known, state = found.join(open_, "source", "left_semi"), cut(state.join(open_, "source", "left_semi"))
        p = P.replace(p, delta=max(least, p.delta / 2))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hitting_search(graph: Graph, sources: DataFrame, k: int, eps: float, least_delta: float | None = None, most_self_walks: int | None = None, **options) -> DataFrame:
    """source, rank, node, score of dht: each round refines either the ppr estimates (delta halves) or the candidates' self
    scores (their error halves), whichever the cost model expects to be cheaper, until bounds settle the k best or delta and
    the error are at their least; with one of them there, the other goes on alone.

    The reverse push of a candidate runs on from where the last one left it; of those that are no candidates any more the
    state is kept. least_delta and most_self_walks are for callers that want a rough answer: both loosen the result.
    """
    n, m = graph.sizes
    base = P.hitting(P.defaults(n, m, eps, pfail=P.topk_pfail(n, halves=True)))
    least, sources = max(P.ALPHA / n, least_delta or 0), cut(sources.select("source").distinct())
    delta, eps_self = 0.25, 0.5
    least_eps = math.sqrt(1 / (n * P.ALPHA))
    state, found, own, pushed, scores, scored = unit_state(sources), None, None, None, None, None
    refine_ppr = True
    while True:
        now = P.push_walk(P.replace(base, delta=delta))
        if refine_ppr or found is None:
            state = cut(forward_push(graph, state, now.rmax))
            found = cut(B.ppr_bounds(_round(graph, state, now.walks, **options), n, base.pfail, found))
        chosen = B.candidates(found, k) if own is None else B.candidates(B.hitting_bounds(found, own), k)
        targets = cut(chosen.select(F.col("node").alias("target")).distinct())
        s = P.replace(base, eps_self=eps_self)
        rmax = s.eps_self * math.sqrt(s.delta_self * m / (n * P.ALPHA * (2 + s.eps_self) * s.log_term))
        count = math.ceil(rmax * (2 + s.eps_self) * s.log_term / (s.delta_self * s.eps_self**2))
        count = max(1, min(count, most_self_walks or count))
        if scored != eps_self:  # else the scores of the last round, of targets that these are among
            begun = unit_state(targets, "target") if pushed is None else unit_state(targets.join(pushed.select("target"), "target", "left_anti"), "target").unionByName(pushed.join(targets, "target", "left_semi"))
            refined = cut(reverse_push(graph, begun, rmax).select("target", "node", "reserve", "residual"))
            pushed = refined if pushed is None else cut(refined.unionByName(pushed.join(targets, "target", "left_anti")))
            scores, scored = cut(self_by_walks(graph, targets, rmax, count, state=refined, **options)), eps_self
        mine = scores.join(targets.withColumnRenamed("target", "node"), "node", "left_semi")
        own = cut(B.self_bounds(mine, base.pfail, s.eps_self, rmax, float(count), own))
        both = cut(B.candidates(B.hitting_bounds(found, own), k))
        settled = B.stops(both, k, eps, P.ALPHA / n).agg(F.min(F.col("stop").cast("int"))).first()[0]
        if settled or (delta <= least and eps_self <= least_eps):
            return top_k(both, k)
        forward = P.cost_forward(edge_visits(graph, state, now.rmax / 2), 2 * now.walks)
        reverse = P.cost_reverse(max(1, targets.count()), rmax / 2, n, m)
        refine_ppr = delta > least and (forward < reverse or eps_self <= least_eps)
        if refine_ppr:
            delta = max(least, delta / 2)
        else:
            eps_self = max(least_eps, eps_self / 2)


def hub_search(graph: Graph, sources: DataFrame, k: int, eps: float, index: DataFrame, least: float | None = None, **options) -> DataFrame:
    """source, rank, node, score, lb, ub: reverse pushes from all targets, once, met by walks from the source over a hub index.
    The number of walks doubles until, by martingale bounds, no node outside the k best can be better than the k-th by more
    than a factor of 1 / (1 - eps), or the number is what the error bound asks for scores of at least `least` (1/n)."""
    n, m = graph.sizes
    least = least or 1 / n
    p = P.bippr(P.defaults(n, m, eps, least, P.topk_pfail(n)))
    rmax, most = min(p.rmax, 0.5), max(1, math.ceil(3 * min(p.rmax, 0.5) * p.log_term / (least * eps**2)))
    targets = graph.nodes.select(F.col("node").alias("target"))
    pushed = cut(in_blocks(targets, lambda some: reverse_push(graph, unit_state(some, "target"), rmax).select("target", "node", "reserve", "residual")))
    reserve = pushed.filter("reserve > 0").select(F.col("node").alias("source"), F.col("target").alias("node"), "reserve")
    open_, done, count = cut(sources.select("source").distinct()), [], min(most, 64)
    while True:
        scores = met_by_walks(pushed, open_, cut(hub_walks(graph, open_, count, index, **options)), count)
        known = scores.join(reserve, ["source", "node"], "left").withColumn("reserve", F.coalesce("reserve", F.lit(0.0)))
        found = cut(B.martingale(known, 1.0, p.pfail, rmax, count, least))
        best = cut(top_k(found, k, keep=("lb", "ub")))
        others = found.join(best.select("source", "node"), ["source", "node"], "left_anti").groupBy("source").agg(F.max("ub").alias("rival"))
        unseen = F.lit(B.martingale_slack(0.0, p.pfail, rmax, count, least))  # of nodes that no walk has met
        settled = best.groupBy("source").agg(F.min("lb").alias("kth"), F.count("*").alias("n")).join(others, "source", "left")
        sure = (F.col("n") >= k) & (F.col("kth") >= (1 - eps) * F.greatest(F.coalesce("rival", F.lit(0.0)), unseen))
        stop = open_ if count >= most else cut(settled.filter(sure).select("source"))
        done.append(best.join(stop, "source", "left_semi"))
        open_ = cut(open_.join(stop, "source", "left_anti"))
        if count >= most or open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        count = min(most, 2 * count)
