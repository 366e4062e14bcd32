"""One entry to every estimator, search, index build and ground-truth job, by action and algorithm."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as P
from ..operators import estimators, evaluate, index, push, search, topk, truth, walks
from ..operators.graph import Graph
from ..operators.walks import STEPS
from ..sources import graph_files as files
from .iterate import cut
from .report import Report, log

PPR = ("push_walk", "montecarlo", "montecarlo_all", "bippr", "fwdpush", "hub", "push_walk_mc", "power")
DHT = ("mc_dht", "shared_dht", "ratio_dht", "global_iteration", "local_expansion", "exact_dht")


@dataclass(frozen=True)
class Options:
    algo: str = "push_walk"
    eps: float = 0.5
    k: int = 500
    rmax_scale: float = 1.0
    ratio: float = 1.0  # of the first error to the second, for hitting scores
    walks: int | None = None  # instead of the number that the error bound asks for
    steps: int = STEPS
    restart: str = "source"
    hubs: int = 100
    hub_levels: int = 10
    rounds: int = 100
    hops: int = 2
    local_nodes: int | None = None  # a neighbourhood of so many nodes grows no further
    delta: float | None = None

    def __post_init__(self):
        if self.algo not in PPR + DHT:
            raise ValueError(f"no algorithm {self.algo!r}; there are {', '.join(PPR + DHT)}")
        if self.eps <= 0 or self.k < 1:
            raise ValueError("eps and k must be above 0")


def query(graph: Graph, sources: DataFrame, options: Options, walk_index: DataFrame | None = None) -> DataFrame:
    """source, node, score of every node that the algorithm reaches, for all sources at once."""
    n, m = graph.sizes
    o, p = options, P.defaults(n, m, options.eps, options.delta)
    sources = sources.select("source").distinct()
    w = {"steps": o.steps, "restart": o.restart}
    count = lambda x: o.walks or max(1, math.ceil(x))
    targets = graph.nodes.select(F.col("node").alias("target"))
    to = sources.select(F.col("source").alias("target"))
    if o.algo == "push_walk":
        q = P.push_walk(p, o.rmax_scale)
        if walk_index is not None:
            return estimators.push_walk_indexed(graph, sources, q.rmax, o.walks or q.walks, walk_index)
        return estimators.push_walk(graph, sources, q.rmax, o.walks or q.walks, **w)
    if o.algo == "push_walk_mc":
        q = P.push_walk(p, o.rmax_scale)
        state = push.forward_push(graph, push.unit_state(sources), q.rmax)
        return estimators.unresolved(graph, state).select("source", F.lit(None).cast("long").alias("node"), F.col("nodes").cast("double").alias("score"))
    if o.algo in ("montecarlo", "montecarlo_all"):
        q = P.monte_carlo(p) if o.algo == "montecarlo" else P.monte_carlo_all(p)
        return walks.monte_carlo(graph, sources if o.algo == "montecarlo" else graph.nodes.select(F.col("node").alias("source")), count(q.walks), **w)
    if o.algo in ("bippr", "hub"):
        q = P.bippr(p, o.rmax_scale)
        counts = None
        if o.algo == "hub":
            hub_index = index.hub_index(graph, index.hubs(graph, o.hubs), o.hub_levels, steps=o.steps) if walk_index is None else walk_index
            counts = cut(index.hub_walks(graph, sources, count(q.walks), hub_index, **w))
        return estimators.bippr(graph, sources, targets, q.rmax, count(q.walks), counts=counts, **w)
    if o.algo == "fwdpush":
        return estimators.push_only(graph, sources, P.forward_push(p, o.rmax_scale).rmax)
    if o.algo == "power":
        return push.power_iteration(graph, sources, o.rounds)
    if o.algo == "mc_dht":
        return walks.monte_carlo_hitting(graph, sources, count(P.monte_carlo_hitting(p).walks), **w)
    if o.algo in ("ratio_dht", "shared_dht"):
        q = P.hitting(p, o.ratio)
        run = estimators.hitting_raw if o.algo == "ratio_dht" else estimators.hitting_shared
        return run(graph, sources, q.rmax, o.walks or q.walks, q.rmax_self, count(q.walks_self), above=q.delta, **w)
    if o.algo == "global_iteration":
        h = push.hitting_iteration(graph, to, push.rounds_for(o.eps, p.delta))
        return h.select(F.col("node").alias("source"), F.col("target").alias("node"), "score")
    if o.algo == "local_expansion":
        h = push.hitting_local(graph, to, o.hops, push.rounds_for(o.eps, p.delta), most=o.local_nodes, error=o.eps * p.delta)
        return h.select(F.col("node").alias("source"), F.col("target").alias("node"), ((F.col("lb") + F.col("ub")) / 2).alias("score"))
    ppr = push.power_iteration(graph, sources, o.rounds)
    return estimators.ratio(ppr, truth.all_self(graph))


def top(graph: Graph, sources: DataFrame, options: Options, walk_index: DataFrame | None = None) -> DataFrame:
    """source, rank, node, score: k best; push_walk, shared_dht and hub search with bounds, others rank their estimate."""
    k = options.k
    if options.algo == "push_walk" and walk_index is None:
        return search.ppr_search(graph, sources, k, options.eps, least_delta=options.delta, steps=options.steps, restart=options.restart)
    if options.algo == "hub":
        hub_index = index.hub_index(graph, index.hubs(graph, options.hubs), options.hub_levels, steps=options.steps) if walk_index is None else walk_index
        return search.hub_search(graph, sources, k, options.eps, cut(hub_index), steps=options.steps, restart=options.restart).select("source", "rank", "node", "score")
    if options.algo == "shared_dht":
        return search.hitting_search(graph, sources, k, options.eps, least_delta=options.delta, most_self_walks=options.walks, steps=options.steps, restart=options.restart)
    if options.algo == "ratio_dht":
        q = P.hitting(P.defaults(*graph.sizes, options.eps, options.delta), options.ratio)
        scores = estimators.hitting_raw(graph, sources.select("source").distinct(), q.rmax, options.walks or q.walks, q.rmax_self, options.walks or max(1, math.ceil(q.walks_self)), above=q.delta, best=k, steps=options.steps, restart=options.restart)
        return topk.top_k(scores, k)
    return topk.top_k(query(graph, sources, options, walk_index), k)


def batch_top(graph: Graph, sources: DataFrame, options: Options, parts: int = 5, walk_index: DataFrame | None = None) -> DataFrame:
    """k_asked, source, rank, node, score for k in k/parts, 2k/parts, ..., k, all from one search for the k best."""
    return topk.batch(cut(top(graph, sources, options, walk_index)), options.k, parts)


def build(graph: Graph, options: Options) -> DataFrame:
    """The walk index that push_walk at this accuracy needs."""
    n, m = graph.sizes
    q = P.push_walk(P.defaults(n, m, options.eps, options.delta), options.rmax_scale)
    return index.walk_index(graph, q.rmax, options.walks or q.walks, steps=options.steps)


def levels(k: int, parts: int = 5) -> list[int]:
    return sorted({max(1, k * i // parts) for i in range(1, parts + 1)})


def evaluate_top(found: DataFrame, exact: DataFrame, k: int, relevance: DataFrame | None = None) -> DataFrame:
    """source, k, precision, recall, ndcg for five values of k."""
    pr, ndcg = evaluate.precision_recall(found, exact, levels(k)), evaluate.ndcg(found, exact, levels(k), relevance)
    return pr.join(ndcg, ["source", "k"], "left")


def truth_of(graph: Graph, sources: DataFrame, options: Options, folder: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(exact k best of each source, exact self scores where the algorithm is of hitting scores), kept in folder if given.

    Tables in the folder are used for the sources they have; what is missing is computed and added.
    """
    k, spark = options.k, graph.spark
    hitting = options.algo in DHT
    # Of hitting scores, more is kept: the candidates among which the k best are.
    make, path = (truth.exact_candidates, files.truth_path(folder, "ppr-dht", k)) if hitting else (truth.exact_topk, files.truth_path(folder, "ppr", k))
    known = files.read_truth(spark, path) if folder else None
    missing = sources.select("source") if known is None else sources.select("source").join(known.select("source").distinct(), "source", "left_anti")
    if known is None or not missing.isEmpty():
        new = cut(make(graph, missing, k, options.rounds))
        known = new if known is None else cut(known.unionByName(new))
        if folder:
            files.write_truth(known, path)
    ppr = known.join(sources.select("source"), "source", "left_semi")
    if not hitting:
        return ppr, None
    old = files.read_truth(spark, files.truth_path(folder, "self")) if folder else None
    own = cut(truth.exact_self(graph, ppr, k, old))
    if folder:
        files.write_truth(own, files.truth_path(folder, "self"))
    return topk.top_k(estimators.ratio(ppr, own), k), own


def score_lists(graph: Graph, sources: DataFrame, found: DataFrame, options: Options, folder: str | None = None) -> DataFrame:
    """source, k, precision, recall, ndcg of lists found (source, rank, node, score), against truth made or read."""
    exact, own = truth_of(graph, sources, options, folder)
    exact = cut(exact)
    relevance = None
    if own is not None and not found.join(exact, ["source", "node"], "left_anti").isEmpty():
        relevance = cut(evaluate.hitting_pairs(graph, found, exact, push.power_iteration(graph, sources, options.rounds)))
    return evaluate_top(found, exact, options.k, relevance)


def run(graph: Graph, action: str, sources: DataFrame | None, options: Options, report_to: str | None = None, walk_index: DataFrame | None = None, truth_folder: str | None = None, metrics: bool = False) -> DataFrame:
    """An action by name, timed, with a report where a folder is given; with metrics, lists are held against the truth."""
    actions = {
        "query": lambda: query(graph, sources, options, walk_index),
        "topk": lambda: top(graph, sources, options, walk_index),
        "batch-topk": lambda: batch_top(graph, sources, options, walk_index=walk_index),
        "build": lambda: build(graph, options),
        "build-hubs": lambda: index.hub_index(graph, index.hubs(graph, options.hubs), options.hub_levels, steps=options.steps),
        "gen-exact-topk": lambda: truth_of(graph, sources, replace(options, algo="power"), truth_folder)[0],
        "gen-exact-self": lambda: truth_of(graph, sources, replace(options, algo="exact_dht"), truth_folder)[1],
        "gen-exact-dht": lambda: truth.exact_hitting(graph, sources, options.k, options.rounds),
        "statistic": lambda: graph_stats(graph),
    }
    if action not in actions:
        raise ValueError(f"no action {action!r}; there are {', '.join(actions)}")
    report = Report(action=action, **asdict(options))
    with report.phase("graph"):
        n, m = graph.sizes
    with report.phase(action):
        out = cut(actions[action]())
    report.found = {"rows": out.count(), "nodes": n, "edges": m}
    if walk_index is not None:
        report.add("indexed_walks", walk_index.count())
    if metrics and action in ("topk", "batch-topk"):
        with report.phase("evaluation"):
            lists = out.filter(F.col("k_asked") == options.k).drop("k_asked") if action == "batch-topk" else out
            table = cut(score_lists(graph, sources, lists, options, truth_folder))
            means = table.groupBy("k").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg"))).orderBy("k")
        report.found["metrics"] = [r.asDict() for r in means.collect()]  # a row for each of five k
        for r in report.found["metrics"]:
            log.info("k=%(k)s precision=%(precision)s recall=%(recall)s ndcg=%(ndcg)s", r)
    if report_to:
        report.save(report_to)
    return out


def graph_stats(graph: Graph) -> DataFrame:
    from ..operators.graph import stats

    return stats(graph)
