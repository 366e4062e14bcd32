"""Precomputed walks: an index of walk ends for every node, and one of hubs in blocks of powers of two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import ALPHA
from ..plans.iterate import cut
from .graph import Graph
from .walks import starts_from, walks


def walk_index(graph: Graph, rmax: float, omega: float, **options) -> DataFrame:
    """src, walk_no, dst: ceil(out-degree * rmax * omega) walks of each node, enough for any residual that a push leaves."""
    n = F.ceil(F.col("out_deg") * F.lit(rmax * omega) - 1e-9)
    starts = graph.nodes.filter("out_deg > 0").select(F.col("node").alias("origin"), F.col("node").alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("walk_no"))
    return walks(graph, starts, **({"restart": "start"} | options)).select(F.col("start").alias("src"), "walk_no", F.col("node").alias("dst"))


def hubs(graph: Graph, count: int) -> DataFrame:
    """hub: the nodes of greatest out-degree."""
    return graph.nodes.orderBy(F.col("out_deg").desc(), "node").limit(count).select(F.col("node").alias("hub"))


def hub_index(graph: Graph, hub_nodes: DataFrame, levels: int, **options) -> DataFrame:
    """hub, block, dst, cnt: walk ends of each hub; block b holds 2^b of its 2^levels - 1 walks."""
    ends = walks(graph, starts_from(hub_nodes.select(F.col("hub").alias("source")), (1 << levels) - 1), **({"salt": "hub", "restart": "start"} | options))
    block = F.floor(F.log2(F.col("walk_no").cast("double")) + 1e-12).cast("long")
    return ends.select(F.col("start").alias("hub"), block.alias("block"), F.col("node").alias("dst")).groupBy("hub", "block", "dst").agg(F.count("*").alias("cnt"))


def hub_sizes(index: DataFrame) -> DataFrame:
    """hub, size (walks held), levels (1 + whole binary logarithm), budget (2^levels - 1 walks can be spent)."""
    size = index.groupBy("hub").agg(F.sum("cnt").alias("size"))
    levels = (F.floor(F.log2(F.col("size").cast("double") + 1) + 1e-12)).cast("long")
    return size.select("hub", "size", levels.alias("levels"), (F.pow(F.lit(2.0), levels) - 1).cast("long").alias("budget"))


def spend(used: DataFrame, index: DataFrame) -> DataFrame:
    """source, hub, dst, cnt of used(source, hub, used) walks: the blocks of used's binary digits."""
    return used.join(index, "hub").filter(F.expr("(used & shiftleft(1L, cast(block as int))) <> 0")).groupBy("source", "hub", "dst").agg(F.sum("cnt").alias("cnt"))


def _spend_turns(seen: DataFrame, index: DataFrame) -> DataFrame:
    """seen(origin, walk_no, hub, ...), walks at their first hub, with spent: whether the hub has a walk left for it. A hub's
    budget is for each source; a walk's place among those that reach a hub decides, in the order of their numbers."""
    turn = Window.partitionBy("origin", "hub").orderBy("walk_no")
    return seen.join(hub_sizes(index).select("hub", "budget"), "hub").withColumn("spent", F.row_number().over(turn) <= F.col("budget")).drop("budget")


def _counted(direct: DataFrame, spent: DataFrame, index: DataFrame) -> DataFrame:
    used = spent.groupBy(F.col("origin").alias("source"), "hub").agg(F.count("*").alias("used"))
    taken = spend(used, index).select("source", F.col("dst").alias("node"), "cnt")
    own = direct.groupBy(F.col("origin").alias("source"), "node").agg(F.count("*").alias("cnt"))
    return own.unionByName(taken).groupBy("source", "node").agg(F.sum("cnt").alias("cnt"))


def hub_walks(graph: Graph, sources: DataFrame, count: int, index: DataFrame, **options) -> DataFrame:
    """source, node, cnt: walks that stop at the first hub on their way, and take one of its walks instead while it has some
    left; the others go on from there."""
    hub_nodes = index.select(F.col("hub").alias("node")).distinct()
    first = cut(walks(graph, starts_from(sources, count), halt=hub_nodes, **options))
    seen = cut(_spend_turns(first.filter("halted is not null").withColumnRenamed("node", "hub"), index))
    rest = seen.filter(~F.col("spent")).select("origin", "start", "walk_no", F.col("hub").alias("node"), "halted")
    ended = first.filter("halted is null").select("origin", "node")
    direct = ended if rest.isEmpty() else ended.unionByName(walks(graph, rest, **options).select("origin", "node"))
    return _counted(direct, seen.filter("spent"), index)


def hub_walks_traced(graph: Graph, sources: DataFrame, count: int, index: DataFrame, **options) -> DataFrame:
    """The same from whole paths: no step is saved. For tests."""
    path = cut(walks(graph, starts_from(sources, count), trace=True, **options))
    hub_nodes = index.select("hub").distinct()
    w = Window.partitionBy("origin", "walk_no")
    at = path.filter("step > 0").join(hub_nodes, F.col("node") == F.col("hub")).withColumn("first", F.min("step").over(w)).filter("step = first")
    spent = cut(_spend_turns(at.select("origin", "walk_no", "hub"), index).filter("spent"))
    last = path.groupBy("origin", "walk_no").agg(F.max_by("node", "step").alias("node"))
    return _counted(last.join(spent, ["origin", "walk_no"], "left_anti"), spent, index)


def one_hop_walks(graph: Graph, sources: DataFrame, count: int, alpha: float = ALPHA, **options) -> DataFrame:
    """source, node, score: alpha stays on the source exactly; the rest is spread by walks that begin one hop on, dealt to
    the out-neighbours in turn. A dangling source keeps everything."""
    begun = sources.select("source").join(graph.placed.withColumnRenamed("node", "source"), "source", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    numbers = begun.filter("deg > 0").withColumn("walk_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long"))))
    dealt = numbers.withColumn("at", F.pmod(F.col("walk_no"), F.col("deg"))).join(graph.numbered_edges.select(F.col("node").alias("list"), "at", "dst"), ["list", "at"])
    starts = dealt.select(F.col("source").alias("origin"), F.col("dst").alias("start"), "walk_no")
    ends = walks(graph, starts, alpha=alpha, **options)
    spread = ends.select(F.col("origin").alias("source"), "node", F.lit((1 - alpha) / count).alias("score"))
    own = begun.select("source", F.col("source").alias("node"), F.when(F.col("deg") == 0, 1.0).otherwise(alpha).alias("score"))
    return spread.unionByName(own).groupBy("source", "node").agg(F.sum("score").alias("score"))
