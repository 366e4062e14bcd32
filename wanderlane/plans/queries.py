"""The registered graph queries: a callable (spark, sf_dir) and, where SQL can express it, the same rows in DuckDB SQL.

Single-source queries run on the trade graph, all-target ones on the event graph (see sources.tables). Their query sets,
the nodes of greatest out-degree, and their accuracy are parameters, stated here. Exact scores take 100 rounds, or as many
as leave the error bound; self scores are pushed to 1e-10; a walk ends by force after 60 steps.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.rng import sql_draw
from ..operators import bounds, estimators, evaluate, graph, index, local, push, search, topk, truth, walks
from ..sources import tables
from . import oracles as O

SOURCES, FEW, ROUNDS, K = 20, 3, 100, 20  # FEW: on the trade graph, and of the searches
RMAX, OMEGA, STEPS = 0.00101, 400.0, 60  # of the event graph's estimators
RMAX_SELF, SELF_WALKS = 0.0501, 40
WALKS = 300
HUBS, LEVELS = 10, 5
SELF_FINE, SELF_ROUNDS = truth.EXACT, 110

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def trade(spark: SparkSession, sf_dir: str, walked: bool = False) -> graph.Graph:
    """walked: for steps of few walkers or power iterations; a graph that is too large for a worker's pushes is packed for them."""
    plain, holds, members = tables.trade_lists(spark, sf_dir)
    about = tables.trade_entries(spark, sf_dir) if walked else 0
    return graph.Graph(graph.clean_edges(tables.trade_edges(spark, sf_dir)), plain=graph.clean_edges(plain), holds=holds, members=members, once=True, about=about if about > local.MOST else 0)


def event(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.Graph(graph.clean_edges(tables.event_edges(spark, sf_dir)))


def top_sources(g: graph.Graph, count: int = SOURCES) -> DataFrame:
    return g.greatest(count).select(F.col("node").alias("source"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 9) for n in names})


def r9(*names: str) -> str:
    return ", ".join(f"round({n}, 9) as {n}" for n in names)


def targets_of(g: graph.Graph) -> DataFrame:
    return g.nodes.select(F.col("node").alias("target"))


T, E = O.graph("trade"), O.graph("event")
S, S_FEW = O.top_sources(SOURCES), O.top_sources(FEW)


# The graph and query sets


@query(O.query([T], "select src, dst from edges"))
def graph_edges(spark, d):
    return trade(spark, d).edges


@query(O.query([T], "select node, out_deg, in_deg from nodes"))
def graph_degrees(spark, d):
    return trade(spark, d).nodes


@query(O.query([E], "select src, dst from edges union all select dst, src from edges"))
def graph_symmetrized(spark, d):
    return graph.clean_edges(tables.event_edges(spark, d), undirected=True)


@query(O.query([T], "select node as src, deg as out_deg, array_to_string(nbrs, ',') as nbrs from adj"))
def graph_adjacency(spark, d):
    return graph.adjacency_lists(trade(spark, d))


@query(O.query([T], "select n, m, round(m / n, 9) as avg_deg, (select count(*) from nodes where out_deg = 0) as dangling, (select max(out_deg) from nodes) as max_out_deg from sizes"))
def graph_stats(spark, d):
    return graph.stats(trade(spark, d))


@query(O.query([E], """select 2::bigint as length, count(*) as cycles from edges a join edges b on a.dst = b.src and b.dst = a.src where a.src < a.dst
union all select 3, count(*) from edges a join edges b on a.dst = b.src join edges c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst"""))
def graph_cycles(spark, d):
    return graph.cycle_lengths(event(spark, d), 3)


@query(O.query([T], "select row_number() over (order by out_deg desc, node) - 1 as qno, node as source from nodes order by out_deg desc, node limit 50"))
def sources_high_degree(spark, d):
    from ..sources.graph_files import high_degree_nodes

    return high_degree_nodes(trade(spark, d), 50)


@query(O.query([T], f"""select qno, source from (select qno::bigint as qno, {sql_draw('query', 'qno')} % n as pick from range(50) t(qno), sizes)
join (select node as source, row_number() over (order by node % 64, node) - 1 as place from nodes) on pick = place"""))
def sources_random_hash(spark, d):
    from ..sources.graph_files import random_nodes

    return random_nodes(trade(spark, d), 50, seed="query")


# Exact scores


@query(O.query([T, S_FEW, O.power(ROUNDS)], f"select source, node, {r9('score')} from ppr"))
def ppr_power_iteration(spark, d):
    g = trade(spark, d, walked=True)
    return rounded(push.power_iteration(g, top_sources(g, FEW), ROUNDS), "score")


@query(O.query([T, S_FEW, O.power(ROUNDS)], f"select source, rank, node, {r9('score')} from ({O.top('(select source, node, round(score, 12) as score from ppr)', K)})"))
def ppr_exact_topk(spark, d):
    g = trade(spark, d, walked=True)
    scores = push.power_iteration(g, top_sources(g, FEW), ROUNDS).withColumn("score", F.round("score", 12))
    return rounded(topk.top_k(scores, K), "score")


# Walks


@query(O.query([T, S_FEW, O.walk(O.source_starts(WALKS), STEPS)], f"select origin as source, node, round(count(*) / {float(WALKS)}, 9) as score from w_ends group by 1, 2"))
def ppr_monte_carlo(spark, d):
    g = trade(spark, d, walked=True)
    return rounded(walks.monte_carlo(g, top_sources(g, FEW), WALKS, steps=STEPS), "score")


@query(O.query([T, S_FEW, O.walk(O.source_starts(WALKS), STEPS, salt="second", restart="start")], f"select origin as source, rank::int as rank, node, score from (select *, row_number() over (partition by origin order by score desc, node) as rank from (select origin, node, round(count(*) / {float(WALKS)}, 9) as score from w_ends group by 1, 2)) where rank <= {K}"))
def ppr_monte_carlo_topk(spark, d):
    g = trade(spark, d, walked=True)
    return topk.top_k(rounded(walks.monte_carlo(g, top_sources(g, FEW), WALKS, steps=STEPS, salt="second", restart="start"), "score"), K)


@query(O.query([E, S, O.walk(O.source_starts(WALKS), STEPS)], f"select origin as source, node, round(count(distinct walk_no) / {float(WALKS)}, 9) as score from w group by 1, 2"))
def dht_monte_carlo(spark, d):
    g = event(spark, d)
    return rounded(walks.monte_carlo_hitting(g, top_sources(g), WALKS, steps=STEPS), "score")


@query(O.query([E, O.walk(O.source_starts(5, "(select node as source from nodes)"), STEPS)], "select origin as source, node, round(count(*) / 5.0, 9) as score from w_ends group by 1, 2"))
def ppr_monte_carlo_all(spark, d):
    g = event(spark, d)
    return rounded(walks.monte_carlo(g, g.nodes.select(F.col("node").alias("source")), 5, steps=STEPS), "score")


# Pushes

ST = O.push(RMAX)


@query(O.query([E, S, ST], f"select source, node, {r9('reserve', 'residual')} from st"))
def ppr_forward_push(spark, d):
    g = event(spark, d)
    return rounded(push.forward_push(g, push.unit_state(top_sources(g)), RMAX), "reserve", "residual")


@query(O.query([T, S_FEW, O.push(0.000101)], f"select source, node, {r9('reserve', 'residual')} from st"))
def ppr_forward_push_trade(spark, d):
    g = trade(spark, d)
    return rounded(push.forward_push(g, push.unit_state(top_sources(g, FEW)), 0.000101), "reserve", "residual")


@query(O.query([E, S, O.push(RMAX * 10, absolute=True)], f"select source, node, {r9('reserve', 'residual')} from st"))
def ppr_forward_push_absolute(spark, d):
    g = event(spark, d)
    return rounded(push.forward_push(g, push.unit_state(top_sources(g)), RMAX * 10, criterion="absolute"), "reserve", "residual")


@query(O.query([E, S, ST], f"select source, rank, node, score from ({O.top('(select source, node, round(reserve, 9) as score from st where reserve <> 0)', K)})"))
def ppr_push_topk(spark, d):
    g = event(spark, d)
    return topk.top_k(rounded(estimators.push_only(g, top_sources(g), RMAX), "score"), K)


@query(O.query([E, S, O.push(RMAX * 20, name="s1"), O.push(RMAX, begin="select 0, source, node, reserve, residual from s1")], f"select source, node, {r9('reserve', 'residual')} from st"))
def ppr_push_incremental(spark, d):
    g = event(spark, d)
    coarse = push.forward_push(g, push.unit_state(top_sources(g)), RMAX * 20)
    return rounded(push.forward_push(g, coarse, RMAX), "reserve", "residual")


RV = O.reverse(RMAX * 20)


@query(O.query([E, RV], f"select target, node, {r9('reserve', 'residual')} from rv"))
def reverse_push(spark, d):
    g = event(spark, d)
    return rounded(push.reverse_push(g, push.unit_state(targets_of(g), "target"), RMAX * 20), "reserve", "residual")


@query(O.query([E, O.reverse(RMAX * 20, name="r1"), O.reverse(RMAX * 4).replace("select 0, target, target, 0.0::double, 1.0::double from (select node as target from nodes)", "select 0, target, node, reserve, residual from r1")], f"select target, node, {r9('reserve', 'residual')} from rv"))
def reverse_push_incremental(spark, d):
    g = event(spark, d)
    coarse = push.reverse_push(g, push.unit_state(targets_of(g), "target"), RMAX * 20)
    return rounded(push.reverse_push(g, coarse, RMAX * 4), "reserve", "residual")


SELF = O.reverse(0.00101, name="sf")
OWN = "own as (select node, reserve as self_ppr from sf where target = node)"


@query(O.query([E, SELF, OWN], f"select node, {r9('self_ppr')} from own"))
def self_ppr(spark, d):
    g = event(spark, d)
    return rounded(push.self_scores(g, targets_of(g), 0.00101), "self_ppr")


# Combined estimators

PUSH_WALK = O.push_walk(RMAX, OMEGA, STEPS)


@query(O.query([E, S, PUSH_WALK], f"select source, node, {r9('score')} from push_walk"))
def ppr_push_walk(spark, d):
    g = event(spark, d)
    return rounded(estimators.push_walk(g, top_sources(g), RMAX, OMEGA, steps=STEPS), "score")


@query(O.query([T, S_FEW, O.push_walk(0.000501, OMEGA, STEPS)], f"select source, node, {r9('score')} from push_walk"))
def ppr_push_walk_trade(spark, d):
    g = trade(spark, d)
    return rounded(estimators.push_walk(g, top_sources(g, FEW), 0.000501, OMEGA, steps=STEPS), "score")


INDEX_OMEGA = OMEGA
INDEX = O.walk(f"select node as origin, node as start, unnest(range(1, ceil(out_deg * {RMAX * INDEX_OMEGA} - 1e-9)::bigint + 1)) as walk_no from nodes where out_deg > 0", STEPS, restart="start", name="ix")


@query(O.query([E, INDEX], "select start as src, walk_no, node as dst from ix_ends"))
def walk_index(spark, d):
    return index.walk_index(event(spark, d), RMAX, INDEX_OMEGA, steps=STEPS)


@query(O.query([E, S, PUSH_WALK], f"select source, node, {r9('score')} from push_walk"))
def ppr_push_walk_indexed(spark, d):
    g = event(spark, d)
    ix = index.walk_index(g, RMAX, INDEX_OMEGA, steps=STEPS)
    return rounded(estimators.push_walk_indexed(g, top_sources(g), RMAX, OMEGA, ix), "score")


@query(O.query([E, S, PUSH_WALK], f"select source, node, {r9('score')} from push_walk"))
def ppr_push_walk_cached(spark, d):
    g = event(spark, d)
    half = index.walk_index(g, RMAX, INDEX_OMEGA / 4, steps=STEPS)
    return rounded(estimators.push_walk_cached(g, top_sources(g), RMAX, OMEGA, half, steps=STEPS)[0], "score")


@query(O.query([E, S, ST, f"""cum as (select source, node, sum(residual) over (partition by source order by node) as upto from st where residual > 0),
dr as (select source, draw, {sql_draw('sample', 'source', 'draw')} / 4294967296.0 * rsum as at from (select source, max(upto) as rsum from cum group by source), range(1, 201) t(draw))"""],
    "select dr.source, draw::bigint as draw, min(node) as node from dr join cum on cum.source = dr.source and cum.upto > dr.at group by 1, 2"))
def residual_sampling(spark, d):
    g = event(spark, d)
    return estimators.push_walk_sampled(push.forward_push(g, push.unit_state(top_sources(g)), RMAX), 200)


@query(O.query([E, S, ST], "select s.source, (select count(*) from nodes where out_deg > 0) - count(n.node) as nodes from sources s left join st on st.source = s.source and residual > 0 left join nodes n on n.node = st.node and out_deg > 0 group by 1"))
def push_walk_unresolved(spark, d):
    g = event(spark, d)
    return estimators.unresolved(g, push.forward_push(g, push.unit_state(top_sources(g)), RMAX))


BIPPR = [RV, O.walk(O.source_starts(WALKS), STEPS), "wc as (select origin as source, node, count(*) as cnt from w_ends group by 1, 2)",
    f"""bi as (select source, node, sum(score) as score from (select s.source, target as node, reserve as score from rv join sources s on s.source = rv.node where reserve > 0
 union all select wc.source, target, residual * cnt / {float(WALKS)} from rv join wc on wc.node = rv.node where residual > 0) group by 1, 2)"""]  # fmt: skip


@query(O.query([E, S, *BIPPR], f"select source, node, {r9('score')} from bi"))
def ppr_bippr(spark, d):
    g = event(spark, d)
    return rounded(estimators.bippr(g, top_sources(g), targets_of(g), RMAX * 20, WALKS, steps=STEPS), "score")


@query(O.query([E, S, *BIPPR], f"select s.source, t.source as node, round(coalesce(score, 0), 9) as score from sources s cross join sources t left join bi on bi.source = s.source and bi.node = t.source"))
def ppr_pairwise(spark, d):
    g = event(spark, d)
    s = top_sources(g)
    pairs = s.join(s.select(F.col("source").alias("node")))  # the stated pairs: each of the sources with each
    return rounded(estimators.pairwise(g, pairs, RMAX * 20, WALKS, steps=STEPS), "score")


# Hitting scores

PPR = O.power(ROUNDS)
FINE = O.reverse(SELF_FINE, SELF_ROUNDS, name="sf")


@query(O.query([E, S, PPR, FINE, OWN], f"select source, node, round(least(score / self_ppr, 1.0), 9) as score from ppr join own using (node)"))
def dht_exact(spark, d):
    g = event(spark, d)
    ppr = push.power_iteration(g, top_sources(g), ROUNDS)
    return rounded(estimators.ratio(ppr, truth.all_self(g)), "score")


@query(O.query([E, S, PPR, FINE, OWN], f"select source, rank, node, score from ({O.top('(select source, node, round(least(score / self_ppr, 1.0), 9) as score from ppr join own using (node))', K)})"))
def dht_exact_topk(spark, d):
    g = event(spark, d)
    ppr = push.power_iteration(g, top_sources(g), ROUNDS)
    return topk.top_k(rounded(estimators.ratio(ppr, truth.exact_self(g, ppr, K, ties=1e-8)), "score"), K)  # ranked as rounded


RAW = O.self_by_walks(RMAX_SELF, SELF_WALKS, STEPS, "select distinct node as target from push_walk")


@query(O.query([E, S, PUSH_WALK, RAW], "select source, node, round(least(score / self_ppr, 1.0), 9) as score from push_walk join own using (node)"))
def dht_ratio(spark, d):
    g = event(spark, d)
    return rounded(estimators.hitting_raw(g, top_sources(g), RMAX, OMEGA, RMAX_SELF, SELF_WALKS, steps=STEPS), "score")


@query(O.query([E, S, PUSH_WALK, RAW], "select source, node, round(least(score / self_ppr, 1.0), 9) as score from push_walk join own using (node)"))
def dht_shared(spark, d):
    g = event(spark, d)
    return rounded(estimators.hitting_shared(g, top_sources(g), RMAX, OMEGA, RMAX_SELF, SELF_WALKS, steps=STEPS), "score")


@query(O.query([E, S, f"rn as (select ceil(ln(0.5 / n * {P.ALPHA}) / ln({1 - P.ALPHA}) - 1e-9)::bigint as rounds from sizes)", """h(it, target, node, score) as (select 0, source, source, 1.0::double from sources union all
 select it + 1, target, node, sum(score) from (select it, target, e.src as node, 0.8 * h.score / n.out_deg as score from h join edges e on e.dst = h.node join nodes n on n.node = e.src, rn where it < rounds and e.src <> target
 union all select it, target, target, score from h, rn where it < rounds and node = target) group by it + 1, target, node)"""], "select target, node, round(score, 9) as score from h join rn on it = rounds"))
def dht_global_iteration(spark, d):
    g = event(spark, d)
    return rounded(push.hitting_iteration(g, top_sources(g).select(F.col("source").alias("target")), push.rounds_for(0.5, 1 / g.sizes[0])), "score")


HOPS = 1
LOCAL = [f"reach as (select distinct target, node from (select source as target, source as node from sources union all select s.source, e.src from sources s join edges e on e.dst = s.source))",
    f"""loc as (select r.target, r.node, n.out_deg as deg, i.node as dst from reach r join nodes n on n.node = r.node join edges e on e.src = r.node left join reach i on i.target = r.target and i.node = e.dst where r.node <> r.target),
l(it, target, node, lb, ub) as (select 0, target, node, case when target = node then 1.0 else 0.0 end::double, 1.0::double from reach union all
 select it + 1, target, node, sum(lb), sum(ub) from (select l.it, loc.target, loc.node, 0.8 / deg * l.lb as lb, 0.8 / deg * l.ub as ub from loc join l on l.target = loc.target and l.node = loc.dst where l.it < 10
 union all select t.it, loc.target, loc.node, 0.0, 0.8 / deg * {0.8 ** (HOPS + 1)} from loc join (select distinct it from l) t on t.it < 10 where loc.dst is null
 union all select it, target, node, 1.0, 1.0 from l where node = target and it < 10) group by 1, 2, 3)"""]  # fmt: skip


@query(O.query([E, S, *LOCAL], "select target, node, round(lb, 9) as lb, round(ub, 9) as ub from l where it = 10"))
def dht_local_expansion(spark, d):
    g = event(spark, d)
    return rounded(push.hitting_local(g, top_sources(g).select(F.col("source").alias("target")), HOPS, 10), "lb", "ub")


# Bounds and searches

PF = 1e-4
TERM = math.log(2 / PF)


def _estimates(g):
    state = push.forward_push(g, push.unit_state(top_sources(g)), RMAX)
    return search._round(g, state, OMEGA, steps=STEPS)


def _dev(rsum: str, upper: str, n: str) -> str:
    return f"({rsum} * {TERM}::double / (3 * {n}) + sqrt({4 / 9 * TERM**2}::double * {rsum} * {rsum} + 8 * {n} * {TERM}::double * {rsum} * {upper}) / (2 * {n}))"


BOUNDS = [PUSH_WALK, """es as (select f.source, f.node, f.score, coalesce(st.reserve, 0) as reserve, rsum, walks from push_walk f left join st using (source, node)
 join (select source, first(rsum) as rsum, sum(n) as walks from cn group by source) using (source))""",
    f"""ev as (select *, {_dev('rsum', 'greatest(1 - reserve, 0)', 'walks')} as ea, sqrt(2.67 * rsum * {TERM} / walks) / sqrt(case when reserve > 1 / n then reserve else 1 / n end) as er from es, (select n::double as n from sizes)),
bd as (select source, node, score, greatest(score - ea, coalesce(case when er < 1 then score / (1 + er) end, 0), reserve, 0) as lb, least(score + ea, coalesce(case when er < 1 then score / (1 - er) end, 9), 1) as ub from ev)"""]  # fmt: skip


@query(O.query([E, S, *BOUNDS], f"select source, node, {r9('score', 'lb', 'ub')} from bd"))
def ppr_bounds_round(spark, d):
    g = event(spark, d)
    return rounded(bounds.ppr_bounds(_estimates(g), g.sizes[0], PF), "score", "lb", "ub")


SELF_BOUNDS = [SELF, f"""sb0 as (select node, reserve as self_ppr, reserve, {math.sqrt((2 + 2 / 3 * 0.5) * 0.00101 * TERM / 400.0)} / sqrt(greatest(reserve, 0.2)) as er from sf where target = node),
sb as (select node, self_ppr, greatest(self_ppr - {_dev('0.00101::double', '1.0::double', '400.0::double')}, coalesce(case when er < 1 then self_ppr / (1 + er) end, 0), reserve, 0.2) as lb,
 least(self_ppr + {_dev('0.00101::double', '1.0::double', '400.0::double')}, coalesce(case when er < 1 then self_ppr / (1 - er) end, 9), 1) as ub from sb0)"""]


def _self(g):
    own = push.self_scores(g, targets_of(g), 0.00101)
    return bounds.self_bounds(own.withColumn("reserve", F.col("self_ppr")), PF, 0.5, 0.00101, 400.0)


@query(O.query([E, *SELF_BOUNDS], f"select node, {r9('self_ppr', 'lb', 'ub')} from sb"))
def self_bounds_round(spark, d):
    return rounded(_self(event(spark, d)), "self_ppr", "lb", "ub")


HB = "hb as (select source, bd.node, bd.score / self_ppr as score, bd.lb / sb.ub as lb, least(bd.ub / sb.lb, 1) as ub from bd join sb using (node))"


@query(O.query([E, S, *BOUNDS, *SELF_BOUNDS, HB], f"select source, node, {r9('score', 'lb', 'ub')} from hb"))
def dht_bounds_round(spark, d):
    g = event(spark, d)
    return rounded(bounds.hitting_bounds(bounds.ppr_bounds(_estimates(g), g.sizes[0], PF), _self(g)), "score", "lb", "ub")


@query(O.query([E, S, *BOUNDS, *SELF_BOUNDS, HB], f"select hb.source, node, round(lb, 9) as lb, round(ub, 9) as ub from hb join (select source, min(score) as kth from ({O.top('hb', K, 'lb')}) group by source) using (source) where ub >= kth"))
def dht_candidates(spark, d):
    g = event(spark, d)
    both = bounds.hitting_bounds(bounds.ppr_bounds(_estimates(g), g.sizes[0], PF), _self(g))
    return rounded(bounds.candidates(both, K).select("source", "node", "lb", "ub"), "lb", "ub")


_MT = math.log(1 / PF)


@query(O.query([E, S, *BIPPR, f"m as (select bi.*, coalesce(reserve, 0) as reserve, {RMAX * 20 * _MT / (3 * WALKS)} + sqrt({(RMAX * 20 * _MT / (3 * WALKS)) ** 2} + {2 * RMAX * 20 * _MT / WALKS} * greatest(score, 0.001)) as slack from bi left join rv on rv.target = bi.node and rv.node = bi.source)"],
    f"select source, node, {r9('score')}, round(greatest(score - least(slack, 0.05), reserve), 9) as lb, round(least(score + slack, 1), 9) as ub from m"))
def martingale_bounds(spark, d):
    g = event(spark, d)
    s = top_sources(g)
    scores = estimators.bippr(g, s, targets_of(g), RMAX * 20, WALKS, steps=STEPS)
    reserve = push.reverse_push(g, push.unit_state(targets_of(g), "target"), RMAX * 20).select(F.col("node").alias("source"), F.col("target").alias("node"), "reserve")
    est = scores.join(reserve, ["source", "node"], "left").withColumn("reserve", F.coalesce("reserve", F.lit(0.0)))
    return rounded(bounds.martingale(est, 0.05, PF, RMAX * 20, WALKS, 0.001), "score", "lb", "ub")


@query(O.query([E, S, *BOUNDS, f"bt as ({O.top('bd', K, 'lb')})"], f"""select b.source, min(score) > 0.001 and max(case when ub > 1.5 * score then 1 else 0 end) = 0 and max(coalesce(rival, 0)) = 0 as stop
from (select bt.source, bt.node, bt.score, bd.ub from bt join bd on bd.source = bt.source and bd.node = bt.node) b left join (select bd.source, max(case when ub > kth * 1.5 and ub <= 1.5 / 0.5 * lb then 1 else 0 end) as rival
from bd join (select source, min(score) as kth from bt group by source) q on q.source = bd.source left join bt on bt.source = bd.source and bt.node = bd.node where bt.node is null group by 1) r on r.source = b.source group by 1"""))
def stop_test(spark, d):
    g = event(spark, d)
    return bounds.stops(bounds.ppr_bounds(_estimates(g), g.sizes[0], PF), K, 0.5, 0.001)


@query()
def ppr_topk_loop(spark, d):
    g = event(spark, d)
    found = search.ppr_search(g, top_sources(g, FEW), 5, 0.5)
    return rounded(found, "score")


@query()
def dht_topk_loop(spark, d):
    g = event(spark, d)
    found = search.hitting_search(g, top_sources(g, FEW), 5, 0.5)
    return rounded(found, "score")


# Hubs

HUB = [f"hubs as (select node as hub from nodes order by out_deg desc, node limit {HUBS})", O.walk(f"select hub as origin, hub as start, walk_no from hubs, range(1, {1 << LEVELS}) t(walk_no)", STEPS, salt="hub", restart="start", name="hw"),
    "hx as (select start as hub, floor(log2(walk_no) + 1e-12)::bigint as block, node as dst, count(*) as cnt from hw_ends group by 1, 2, 3)"]


@query(O.query([E, *HUB], "select hub, block, dst, cnt from hx"))
def hub_index(spark, d):
    g = event(spark, d)
    return index.hub_index(g, index.hubs(g, HUBS), LEVELS, steps=STEPS)


@query(O.query([E, *HUB], "select hub, sum(cnt)::bigint as size, floor(log2(sum(cnt) + 1) + 1e-12)::bigint as levels, (pow(2, floor(log2(sum(cnt) + 1) + 1e-12)) - 1)::bigint as budget from hx group by hub"))
def hub_sizes(spark, d):
    g = event(spark, d)
    return index.hub_sizes(index.hub_index(g, index.hubs(g, HUBS), LEVELS, steps=STEPS))


@query(O.query([E, *HUB], "select 0::bigint as source, hub, dst, sum(cnt)::bigint as cnt from hx where (21 & (1 << block::int)) <> 0 group by 1, 2, 3"))
def hub_spend(spark, d):
    g = event(spark, d)
    hubs = index.hubs(g, HUBS)
    used = hubs.select(F.lit(0).cast("long").alias("source"), "hub", F.lit(21).cast("long").alias("used"))
    return index.spend(used, index.hub_index(g, hubs, LEVELS, steps=STEPS))


HUB_WALKS = [*HUB, O.walk(O.source_starts(WALKS), STEPS), f"""hf as (select origin, walk_no, hub, row_number() over (partition by origin, hub order by walk_no) as turn from (select origin, walk_no, node as hub, row_number() over (partition by origin, walk_no order by k) as f from w where k > 0 and node in (select hub from hubs)) where f = 1),
hc as (select * from hf where turn <= {(1 << LEVELS) - 1}),
wc as (select source, node, sum(cnt)::bigint as cnt from (select e.origin as source, e.node, count(*) as cnt from w_ends e left join hc using (origin, walk_no) where hc.hub is null group by 1, 2
 union all select u.origin, dst, sum(cnt) from (select origin, hub, count(*) as used from hc group by 1, 2) u join hx on hx.hub = u.hub where (used & (1 << block::int)) <> 0 group by 1, 2) group by 1, 2)"""]  # fmt: skip


@query(O.query([E, S, *HUB_WALKS], "select source, node, cnt from wc"))
def hub_walk_counts(spark, d):
    g = event(spark, d)
    return index.hub_walks(g, top_sources(g), WALKS, index.hub_index(g, index.hubs(g, HUBS), LEVELS, steps=STEPS), steps=STEPS)


@query(O.query([E, S, *HUB_WALKS, RV, BIPPR[3]], f"select source, node, {r9('score')} from bi"))
def ppr_hub(spark, d):
    g = event(spark, d)
    counts = index.hub_walks(g, top_sources(g), WALKS, index.hub_index(g, index.hubs(g, HUBS), LEVELS, steps=STEPS), steps=STEPS)
    return rounded(estimators.bippr(g, top_sources(g), targets_of(g), RMAX * 20, WALKS, counts=counts), "score")


@query(O.query([E, S, O.walk(f"select source as origin, a.nbrs[1 + walk_no % a.deg] as start, walk_no from sources join adj a on a.node = source, range(1, {WALKS + 1}) t(walk_no)", STEPS)],
    f"select source, node, round(sum(score), 9) as score from (select origin as source, node, {0.8 / WALKS} as score from w_ends union all select source, source, 0.2 from sources) group by 1, 2"))
def ppr_one_hop_walks(spark, d):
    g = event(spark, d)
    return rounded(index.one_hop_walks(g, top_sources(g), WALKS, steps=STEPS), "score")


# Ground truth and evaluation


@query(O.query([E, FINE, OWN], f"select node, {r9('self_ppr')} from own"))
def truth_self(spark, d):
    return rounded(truth.all_self(event(spark, d)), "self_ppr")


CANDIDATES = [PPR, f"bp as ({O.top('ppr', truth.self_candidates(K))})", O.reverse(truth.COARSE, name="rf", targets="select distinct node as target from bp"),
    f"rg as (select node, greatest(reserve, {P.ALPHA}) as lo, least(reserve + {truth.COARSE / P.ALPHA}, 1.0) as hi from rf where target = node)",
    "cb as (select source, node, score / hi as lb, score / lo as ub from bp join rg using (node))",
    f"wanted as (select distinct node from cb join (select source, min(score) as kth from ({O.top('cb', K, 'lb')}) group by source) using (source) where ub >= kth)"]


@query(O.query([E, S, *CANDIDATES, FINE, OWN], f"select node, {r9('self_ppr')} from own join wanted using (node)"))
def truth_self_candidates(spark, d):
    g = event(spark, d)
    ppr = push.power_iteration(g, top_sources(g), ROUNDS)
    return rounded(truth.exact_self(g, ppr, K, among=topk.top_k(ppr, truth.self_candidates(K))), "self_ppr")  # of these by definition


@query(O.query([E, S, PPR, FINE, OWN], f"select source, rank, node, round(score, 9) as score from ({O.top('(select source, node, least(score / self_ppr, 1.0) as score from ppr join own using (node))', K)})"))
def truth_hitting(spark, d):
    g = event(spark, d)
    return rounded(truth.exact_hitting(g, top_sources(g), K, ROUNDS), "score")


EVAL = [E, S, O.power(ROUNDS), O.walk(O.source_starts(WALKS), STEPS),
    f"mc as (select origin as source, node, round(count(*) / {float(WALKS)}, 9) as score from w_ends group by 1, 2)",
    "tr as (select source, node, round(score, 12) as score from ppr)", f"ft as ({O.top('mc', K)})", f"tt as ({O.top('tr', K)})", f"ks as (select unnest([{K // 5}, {2 * K // 5}, {K}]) as k)"]


def _lists(spark, d):
    g = event(spark, d)
    s = top_sources(g)
    found = rounded(walks.monte_carlo(g, s, WALKS, steps=STEPS), "score")
    exact = push.power_iteration(g, s, ROUNDS).withColumn("score", F.round("score", 12))
    return found, exact


KS = [K // 5, 2 * K // 5, K]


@query(O.query(EVAL, """select t.source, t.k, round(coalesce(h.hits, 0) / f.c, 9) as precision, round(coalesce(h.hits, 0) / t.c, 9) as recall
from (select source, k, count(*) as c from tt, ks where rank <= k and score > 0 group by 1, 2) t left join (select source, k, count(*) as c from ft, ks where rank <= k group by 1, 2) f using (source, k)
left join (select ft.source, k, count(*) as hits from ks join ft on ft.rank <= k join tt on tt.source = ft.source and tt.node = ft.node and tt.rank <= k group by 1, 2) h using (source, k)"""))
def eval_precision_recall(spark, d):
    found, exact = _lists(spark, d)
    return evaluate.precision_recall(topk.top_k(found, K), topk.top_k(exact, K), KS)


@query(O.query(EVAL, """select b.source, b.k, round(coalesce(got, 0) / best, 9) as ndcg from (select source, k, sum((pow(2.0, score) - 1) / log2(rank + 1.0)) as best from tt, ks where rank <= k group by 1, 2) b
left join (select ft.source, k, sum((pow(2.0, coalesce(tr.score, 0)) - 1) / log2(rank + 1.0)) as got from ks join ft on rank <= k left join tr on tr.source = ft.source and tr.node = ft.node group by 1, 2) g using (source, k)"""))
def eval_ndcg(spark, d):
    found, exact = _lists(spark, d)
    return evaluate.ndcg(topk.top_k(found, K), topk.top_k(exact, K), KS, relevance=exact)


@query(O.query(EVAL, """select source, round(max(a), 9) as max_abs_err, round(avg(a), 9) as avg_abs_err, round(max(r), 9) as max_rel_err, round(avg(r), 9) as avg_rel_err
from (select tr.source, abs(tr.score - coalesce(mc.score, 0)) as a, abs(tr.score - coalesce(mc.score, 0)) / tr.score as r from tr left join mc on mc.source = tr.source and mc.node = tr.node) group by 1"""))
def eval_errors(spark, d):
    return evaluate.errors(*_lists(spark, d))


EVAL_DHT = [E, S, PPR, FINE, OWN, O.walk(O.source_starts(WALKS), STEPS),
    f"mh as (select origin as source, node, round(count(distinct walk_no) / {float(WALKS)}, 9) as score from w group by 1, 2)",
    "tr as (select source, node, round(least(score / self_ppr, 1.0), 9) as score from ppr join own using (node))", f"ft as ({O.top('mh', K)})", f"tt as ({O.top('tr', K)})", EVAL[-1]]


@query(O.query(EVAL_DHT, """select b.source, b.k, round(coalesce(got, 0) / best, 9) as ndcg from (select source, k, sum((pow(2.0, score) - 1) / log2(rank + 1.0)) as best from tt, ks where rank <= k group by 1, 2) b
left join (select ft.source, k, sum((pow(2.0, coalesce(tr.score, 0)) - 1) / log2(rank + 1.0)) as got from ks join ft on rank <= k left join tr on tr.source = ft.source and tr.node = ft.node group by 1, 2) g using (source, k)"""))
def eval_ndcg_dht(spark, d):
    g = event(spark, d)
    s = top_sources(g)
    found = topk.top_k(rounded(walks.monte_carlo_hitting(g, s, WALKS, steps=STEPS), "score"), K)
    ppr = push.power_iteration(g, s, ROUNDS)
    exact = topk.top_k(rounded(truth.exact_hitting(g, s, K, ROUNDS, ppr=ppr), "score"), K)
    return evaluate.ndcg(found, exact, KS, relevance=rounded(evaluate.hitting_pairs(g, found, exact, ppr), "score"))


@query(O.query([E, S, ST, f"fp as (select source, node, round(reserve, 9) as score from st where reserve <> 0)", f"ft as ({O.top('fp', K)})"], f"select k as k_asked, source, rank, node, score from ft join (select unnest([{', '.join(str(K * i // 5) for i in range(1, 6))}]) as k) on rank <= k"))
def batch_topk(spark, d):
    g = event(spark, d)
    scores = rounded(estimators.push_only(g, top_sources(g), RMAX), "score")
    return topk.batch(topk.top_k(scores, K), K, 5)


DRAWS = 200


@query(O.query([E, S, ST, f"""cum as (select source, node, sum(residual) over (partition by source order by node) as upto from st where residual > 0),
rs as (select source, max(upto) as rsum from cum group by source),
dr as (select source, draw, rsum, {sql_draw('sample', 'source', 'draw')} / 4294967296.0 * rsum as at from rs, range(1, {DRAWS + 1}) t(draw)),
pk as (select dr.source, draw::bigint as draw, min(node) as node from dr join cum on cum.source = dr.source and cum.upto > dr.at group by 1, 2)""",
    O.walk("select source as origin, node as start, draw as walk_no from pk", STEPS, name="dw")],
    f"select source, node, round(sum(score), 9) as score from (select origin as source, node, rsum / {float(DRAWS)} as score from dw_ends join rs on rs.source = origin union all select source, node, reserve from st where reserve <> 0) group by 1, 2"))
def ppr_push_walk_drawn(spark, d):
    g = event(spark, d)
    return rounded(estimators.push_walk_drawn(g, top_sources(g), RMAX, DRAWS, steps=STEPS), "score")


# Parameters

_L = "ln(2 * n)"


@query(O.query([T], f"""select 'push_walk' as method, round(0.5 * sqrt(1.0 / n / (3 * m * {_L})), 9) as rmax, round(2.5 * {_L} * n / 0.25, 3) as walks from sizes
union all select 'bippr', round(0.5 * sqrt(m / n / (3 * {_L})), 9), round(3 * 0.5 * sqrt(m / n / (3 * {_L})) * {_L} * n / 0.25, 3) from sizes
union all select 'monte_carlo', 0, round(3 * {_L} * n / 0.25, 3) from sizes
union all select 'monte_carlo_all', 0, round(3 * {_L} / 0.25 / 0.2, 3) from sizes
union all select 'forward_push', round(1.0 / n * 0.5 * n / m, 9), 0 from sizes
union all select 'pairwise', round(0.5 * sqrt(m / n / (n * 2.5 * {_L})), 9), ceil(0.5 * sqrt(m / n / (n * 2.5 * {_L})) * 2.5 * {_L} * n / 0.25) from sizes"""))
def parameters(spark, d):
    n, m = trade(spark, d).sizes
    p = P.defaults(n, m, 0.5)
    rows = [(f.__name__, float(round(q.rmax, 9)), float(round(q.walks, 3))) for f in (P.push_walk, P.bippr, P.monte_carlo, P.monte_carlo_all, P.forward_push, P.pairwise) for q in [f(p)]]
    return spark.createDataFrame(rows, "method string, rmax double, walks double")
