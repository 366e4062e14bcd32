"""DuckDB SQL for the registered queries, put together from common table expressions.

Recursive parts run a fixed number of rounds, enough for the pushes to have settled; walks draw the same hashes.
"""

from __future__ import annotations

from ..functions.params import ALPHA
from ..functions.rng import below, sql_draw
from ..sources.tables import EVENT_SQL, TRADE_SQL

STAY, GO = ALPHA, 1 - ALPHA


def graph(which: str) -> str:
    return f"""edges as ({EVENT_SQL if which == 'event' else TRADE_SQL}),
nodes as (select node, sum(o)::bigint as out_deg, sum(i)::bigint as in_deg from (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by node),
adj as (select src as node, count(*) as deg, list_sort(list(dst)) as nbrs from edges group by src),
sizes as (select count(*) as n, sum(out_deg)::bigint as m from nodes)"""


def top_sources(count: int, name: str = "sources") -> str:
    return f"{name} as (select node as source from nodes order by out_deg desc, node limit {count})"


def power(rounds: int, name: str = "ppr") -> str:
    return f"""{name}_state(it, source, node, r) as (select 0, source, source, 1.0::double from sources union all
 select it + 1, source, t, sum(r) from (select s.it, s.source, case when n.out_deg = 0 then s.source else e.dst end as t, {GO} * s.r / greatest(n.out_deg, 1) as r
 from {name}_state s join nodes n on n.node = s.node left join edges e on e.src = s.node where s.it < {rounds - 1}) group by it + 1, source, t),
{name} as (select source, node, sum({STAY} * r) as score from {name}_state group by source, node)"""


def push(rmax: float, rounds: int = 60, name: str = "st", begin: str = "select 0, source, source, 0.0::double, 1.0::double from sources", absolute: bool = False) -> str:
    test = "residual" if absolute else "residual / greatest(deg, 1)"
    return f"""{name}_rel as (select node, out_deg as deg, 0 as k, null::bigint as dst from nodes union all select n.node, n.out_deg, 1, e.dst from nodes n left join edges e on e.src = n.node),
{name}_all(it, source, node, reserve, residual) as ({begin} union all
 select it + 1, s.source, case when k = 0 then s.node when deg = 0 then s.source else dst end,
 sum(case when k = 0 then reserve + case when {test} >= {rmax} then {STAY} * residual else 0 end else 0 end),
 sum(case when k = 0 then case when {test} >= {rmax} then 0 else residual end else {GO} * residual / greatest(deg, 1) end)
 from {name}_all s join {name}_rel r on r.node = s.node where it < {rounds} and (k = 0 or {test} >= {rmax}) group by it + 1, s.source, 3),
{name} as (select source, node, reserve, residual from {name}_all where it = {rounds})"""


def reverse(rmax: float, rounds: int = 60, name: str = "rv", targets: str = "select node as target from nodes") -> str:
    return f"""{name}_rel as (select node, 0 as k, null::bigint as src, 1 as deg from nodes union all select e.dst, 1, e.src, n.out_deg from edges e join nodes n on n.node = e.src),
{name}_all(it, target, node, reserve, residual) as (select 0, target, target, 0.0::double, 1.0::double from ({targets}) union all
 select it + 1, s.target, case when k = 0 then s.node else src end,
 sum(case when k = 0 then reserve + case when residual >= {rmax} then {STAY} * residual else 0 end else 0 end),
 sum(case when k = 0 then case when residual >= {rmax} then 0 else residual end else {GO} * residual / deg end)
 from {name}_all s join {name}_rel r on r.node = s.node where it < {rounds} and (k = 0 or residual >= {rmax}) group by it + 1, s.target, 3),
{name} as (select target, node, reserve, residual from {name}_all where it = {rounds})"""


def walk(starts: str, steps: int, salt: str = "walk", restart: str = "origin", name: str = "w") -> str:
    go = f"{sql_draw(salt, repr('stop'), 'w.start', 'w.walk_no', 'w.k')} >= {below(ALPHA)}"
    move = sql_draw(salt, repr("move"), "w.start", "w.walk_no", "w.k")
    stop = f"{sql_draw(salt, repr('stop'), 'start', 'walk_no', 'k')} < {below(ALPHA)}"
    return f"""{name}(origin, start, walk_no, k, node) as (select origin, start, walk_no, 0, start from ({starts}) union all
 select origin, start, walk_no, k + 1, case when a.deg is null then {restart} else a.nbrs[1 + {move} % a.deg] end
 from {name} w left join adj a on a.node = w.node where k < {steps} and {go}),
{name}_ends as (select origin, start, walk_no, node from {name} where k = {steps} or {stop})"""


def source_starts(count: int, sources: str = "sources") -> str:
    return f"select source as origin, source as start, walk_no from {sources}, range(1, {count + 1}) t(walk_no)"


def counts(omega: float, state: str = "st", name: str = "cn") -> str:
    return f"""{name} as (select s.source, s.node, s.residual, rsum, greatest(ceil(residual / rsum * floor({omega} * rsum + 1e-9) - 1e-9), 1)::bigint as n
 from {state} s join (select source, sum(residual) as rsum from {state} group by source) using (source) where residual > 0)"""


def push_walk(rmax: float, omega: float, steps: int, name: str = "push_walk", rounds: int = 60, state: str | None = None) -> str:
    starts = "select source as origin, node as start, unnest(range(1, n + 1)) as walk_no from cn"
    return f"""{state or push(rmax, rounds)},
{counts(omega)},
{walk(starts, steps, name='fw')},
{name} as (select source, node, sum(score) as score from (select f.origin as source, f.node, residual / n as score from fw_ends f join cn on cn.source = f.origin and cn.node = f.start
 union all select source, node, reserve from st where reserve <> 0) group by source, node)"""


def self_by_walks(rmax: float, count: int, steps: int, targets: str, name: str = "own") -> str:
    return f"""{name}_targets as ({targets}),
{reverse(rmax, name='rs', targets=f'select target from {name}_targets')},
{walk(source_starts(count, f'(select target as source from {name}_targets)'), steps, name='sw')},
sc as (select origin as target, node, count(*) as cnt from sw_ends group by 1, 2),
{name} as (select node, sum(self_ppr) as self_ppr from (select target as node, reserve as self_ppr from rs where target = node
 union all select rs.target, residual * cnt / {float(count)} from rs join sc on sc.target = rs.target and sc.node = rs.node where residual > 0) group by node)"""


def top(scores: str, k: int, by: str = "score") -> str:
    return f"select source, rank::int as rank, node, {by} as score from (select *, row_number() over (partition by source order by {by} desc, node) as rank from {scores}) where rank <= {k}"


def query(parts: list[str], select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select
