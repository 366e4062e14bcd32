"""A directed graph: edges(src, dst) without self loops; parallel edges are rows of their own and count in degrees.

Nodes with the same out-edges may share one list of them: work on lists costs their entries, not the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut
from . import local

FOLDER, FOLDERS = 1 << 18, 1 << 12  # entries of lists in a folder of packed lists, about; so many folders at most


def clean_edges(pairs: DataFrame, undirected: bool = False) -> DataFrame:
    """edges of (src, dst) pairs: self loops and nulls go; undirected adds each edge's reverse."""
    edges = pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst")
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else edges


@dataclass
class Graph:
    """Edges and the tables that walks and pushes join with, each written once and dealt by its join key.

    count: the number of nodes, 0..count-1, if known; without it the nodes are those that have an edge.
    plain, holds, members: where nodes share lists, the edges of the others, (node, list) of those that share one (they have
    no other out-edges), and (list, dst); a list has the id of one of its nodes. edges are then all of them, spelt out.
    once: pairs of plain may repeat, and count once.
    about: how many entries, if that is known beforehand and steps of few walkers are to come: lists are packed at once.
    """

    edges: DataFrame
    count: int | None = None
    _made: dict = field(default_factory=dict)
    plain: DataFrame | None = None
    holds: DataFrame | None = None
    members: DataFrame | None = None
    once: bool = False
    about: int = 0

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def spark(self):
        return self.edges.sparkSession

    @property
    def shared(self) -> bool:
        return self.holds is not None

    @property
    def own_lists(self) -> DataFrame:
        """list, dst of the nodes that have a list of their own: list is the node."""
        def make():
            own = (self.plain if self.shared else self.edges).select(F.col("src").alias("list"), "dst")
            if self.about:
                return self._once("packed", lambda: Packed(own, self.about, self.once)).lists
            return cut(own.distinct() if self.once else own)

        return self._once("own_lists", make)

    @property
    def shared_lists(self) -> DataFrame:
        return self._once("shared_lists", lambda: cut(self.members.select("list", "dst")))

    @property
    def holders(self) -> DataFrame:
        """node, list of the nodes that share a list."""
        return self._once("holders", lambda: cut(self.holds.select("node", "list")))

    @property
    def lists(self) -> DataFrame:
        """list, dst: the out-edges, each shared list once."""
        return self.own_lists.unionByName(self.shared_lists) if self.shared else self.own_lists

    @property
    def entries(self) -> int:
        def count():
            own = self.own_lists
            return (self._made["packed"].size if "packed" in self._made else own.count()) + (self.shared_lists.count() if self.shared else 0)

        return self._once("entries", count)

    @property
    def nodes(self) -> DataFrame:
        def make():
            zero = F.lit(0).cast("long")
            out = self.placed.select("node", F.col("deg").alias("out_deg"), zero.alias("in_deg"))
            into = self.own_lists.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_deg")).select("node", zero.alias("out_deg"), "in_deg")
            all_ = out.unionByName(into)
            if self.shared:
                times = self.shared_lists.join(self.holders.groupBy("list").agg(F.count("*").alias("in_deg")), "list").select(F.col("dst").alias("node"), zero.alias("out_deg"), "in_deg")
                all_ = all_.unionByName(times)
            if self.count is not None:
                all_ = all_.unionByName(self.spark.range(self.count).select(F.col("id").alias("node"), zero.alias("out_deg"), zero.alias("in_deg")))
            return cut(all_.groupBy("node").agg(F.sum("out_deg").alias("out_deg"), F.sum("in_deg").alias("in_deg")))

        return self._once("nodes", make)

    @property
    def placed(self) -> DataFrame:
        """node, deg, list: where the out-edges of each node that has any are."""
        def make():
            own = self.own_lists
            own = self._made["packed"].sizes if "packed" in self._made else own.groupBy("list").agg(F.count("*").alias("n"))
            own = own.select(F.col("list").alias("node"), F.col("n").alias("deg"), "list")
            if not self.shared:
                return cut(own)
            return cut(own.unionByName(self.holders.join(self.shared_lists.groupBy("list").agg(F.count("*").alias("deg")), "list").select("node", "deg", "list")))

        return self._once("placed", make)

    def greatest(self, count: int) -> DataFrame:
        """node, out_deg of the nodes of greatest out-degree; dangling nodes are looked up only if there are too few others."""
        out = self.placed.select("node", F.col("deg").alias("out_deg"))
        some = out if out.limit(count).count() == count else self.nodes.select("node", "out_deg")
        return some.orderBy(F.col("out_deg").desc(), "node").limit(count)

    @property
    def sizes(self) -> tuple[int, int]:
        """(nodes, edges)"""
        def sizes():
            row = self.nodes.agg(F.count("*").alias("n"), F.sum("out_deg").alias("m")).first()
            return int(row.n), int(row.m or 0)

        return self._once("sizes", sizes)

    @property
    def numbered_edges(self) -> DataFrame:
        """node, at, dst, dst_deg, dst_list: entries of each list (node: the list) numbered from 0 in the order of dst."""
        return self._once("numbered_edges", lambda: cut(self._led(numbered(self.lists))))

    def _led(self, e: DataFrame) -> DataFrame:
        to = self.placed.select(F.col("node").alias("dst"), F.col("deg").alias("dst_deg"), F.col("list").alias("dst_list"))
        return e.join(to, "dst", "left").select(F.col("list").alias("node"), "at", "dst", F.coalesce("dst_deg", F.lit(0)).alias("dst_deg"), F.coalesce("dst_list", "dst").alias("dst_list"))

    @property
    def packed(self) -> list[Packed]:
        """The lists in order, a row each: those of one node and, if there are any, the shared ones."""
        own = self.own_lists
        packed = [self._once("packed", lambda: Packed(own, self.entries))]
        if self.shared:
            packed.append(self._once("packed shared", lambda: Packed(self.shared_lists, self.shared_lists.count())))
        return packed

    def numbered_among(self, wanted: DataFrame) -> DataFrame:
        """The rows of numbered_edges that are wanted(list, at), for few of them, which pass through the driver: only the folders
        of their lists are read."""
        e = Packed.entries(wanted, self.packed)
        to = self.spark.createDataFrame(e.select(["dst"]).group_by("dst").aggregate([]))
        led = {r.node: (r.deg, r.list) for r in self.placed.join(F.broadcast(to), F.col("node") == F.col("dst")).select("node", "deg", "list").collect()}
        degs, lists = zip(*[led.get(d, (0, d)) for d in e["dst"].to_pylist()]) if len(e) else ((), ())
        columns = [e["list"], e["at"], e["dst"], pa.array(degs, pa.int64()), pa.array(lists, pa.int64())]
        return self.spark.createDataFrame(pa.table(columns, ["node", "at", "dst", "dst_deg", "dst_list"]))

    @property
    def out_edges(self) -> DataFrame:
        """node, deg, dst, dst_deg: a row for each out-edge; a dangling node has one with deg 0 and dst null."""
        def make():
            deg = self.nodes.select("node", F.col("out_deg").alias("deg"))
            # Where lists are shared, all edges are spelt out here.
            e = self.edges.join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("dst_deg")), "dst").select(F.col("src").alias("node"), "dst", "dst_deg")
            return cut(deg.join(e, "node", "left").select("node", "deg", "dst", "dst_deg"))

        return self._once("out_edges", make)

    @property
    def in_edges(self) -> DataFrame:
        """node, src, deg: a row for each in-edge of node, with the out-degree of its source."""
        def make():
            deg = self.nodes.select(F.col("node").alias("src"), F.col("out_deg").alias("deg"))
            return cut(self.edges.join(deg, "src").select(F.col("dst").alias("node"), "src", "deg"))

        return self._once("in_edges", make)


class Packed:
    """Lists, each with its entries in order in one row (one for each PART of ids that it has entries in), written in folders by
    the list: to look some of them up reads their folders, sorts nothing and moves nothing."""

    def __init__(self, entries: DataFrame, about: int, once: bool = False):
        """entries(list, dst); once: those that repeat count once."""
        self.folders = max(1, min(FOLDERS, about // FOLDER))
        rows = entries.select(F.col("list").cast("long"), F.col("dst").cast("long"))
        dealt = rows.repartition(self.folder, F.shiftright("dst", local.PART)).sortWithinPartitions("list", "dst")
        packed = dealt.mapInArrow(local.packing(once), "list long, part long, n long, dsts array<long>")
        self.rows = cut(packed.withColumn("folder", self.folder), by="folder")
        all_ = self.rows.agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("n").alias("n")).first()
        self.parted, self.size = all_.lo != all_.hi, all_.n or 0

    @property
    def folder(self) -> Column:
        return F.pmod(F.hash(F.col("list").cast("long")), F.lit(self.folders))

    @property
    def lists(self) -> DataFrame:
        """list, dst"""
        return self.rows.select("list", F.explode("dsts").alias("dst"))

    @property
    def sizes(self) -> DataFrame:
        """list, n"""
        return self.rows.groupBy("list").agg(F.sum("n").alias("n")) if self.parted else self.rows.select("list", "n")

    @staticmethod
    def entries(wanted: DataFrame, packed: list[Packed]) -> pa.Table:
        """list, at, dst of those that are wanted(list, at)."""
        spark = wanted.sparkSession
        asked = wanted.select(F.col("list").cast("long"), F.col("at").cast("long"), *[p.folder.alias(f"folder{k}") for k, p in enumerate(packed)]).toArrow()
        some = asked.select(["list", "at"]).group_by("list").aggregate([("at", "distinct")]).rename_columns({"at_distinct": "ats"}) if len(asked) else None
        if some is None:
            return pa.table({name: pa.array([], pa.int64()) for name in ("list", "at", "dst")})
        ats, out = F.broadcast(spark.createDataFrame(some.select(["list", "ats"]))), None
        for k, p in enumerate(packed):
            rows = p.rows.filter(F.col("folder").isin(asked[f"folder{k}"].unique().to_pylist())).drop("folder")
            if p.parted:
                before = Window.partitionBy("list").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
                base = rows.join(ats, "list", "left_semi").select("list", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
                rows = rows.join(base, ["list", "part"])
            else:
                rows = rows.withColumn("base", F.lit(0).cast("long"))
            here = F.filter("ats", lambda at: (at >= F.col("base")) & (at < F.col("base") + F.col("n")))
            got = F.transform(here, lambda at: F.struct(at.alias("at"), F.get("dsts", (at - F.col("base")).cast("int")).alias("dst")))
            found = rows.join(ats, "list").select("list", F.explode(got).alias("e")).select("list", "e.at", "e.dst")
            out = found if out is None else out.unionByName(found)
        return out.toArrow()


def numbered(entries: DataFrame) -> DataFrame:
    """list, at, dst: numbered from 0 in the order of dst. Numbers are those in a range of dst and the range's base, so that no
    task sorts a hub's edges together."""
    parts = entries.select("list", "dst", F.shiftright("dst", 16).alias("part"))
    before = Window.partitionBy("list").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("list", "part").agg(F.count("*").alias("n")).select("list", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("list", "part").orderBy("dst")
    e = parts.withColumn("in_part", F.row_number().over(within) - 1).join(base, ["list", "part"])
    return e.select("list", (F.col("base") + F.col("in_part")).alias("at"), "dst")


def adjacency_lists(graph: Graph) -> DataFrame:
    """src, out_deg, nbrs as comma-separated text. The text of a shared list is made once."""
    def texts(lists: DataFrame) -> DataFrame:
        nbrs = lists.groupBy("list").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        return nbrs.select("list", F.size("nbrs").cast("long").alias("out_deg"), F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"))

    own = texts(graph.own_lists).withColumnRenamed("list", "src")
    if not graph.shared:
        return own
    # Dealt to many tasks: few lists may have many nodes each.
    dealt = graph.holders.repartition(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), "node")
    return own.unionByName(dealt.join(cut(texts(graph.shared_lists)), "list").select(F.col("node").alias("src"), "out_deg", "nbrs"))


def sizes_only(spark, n: int, m: int) -> Graph:
    """A graph of which only the sizes are known, for parameters and reports: no edge is read."""
    return Graph(spark.createDataFrame([], "src long, dst long"), n, {"sizes": (n, m)})


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, mean degree, dangling nodes, largest out-degree."""
    return graph.nodes.agg(
        F.count("*").alias("n"), F.sum("out_deg").alias("m"), F.round(F.sum("out_deg") / F.count("*"), 9).alias("avg_deg"),
        F.sum((F.col("out_deg") == 0).cast("long")).alias("dangling"), F.max("out_deg").alias("max_out_deg"),
    )


def cycle_lengths(graph: Graph, longest: int = 3) -> DataFrame:
    """length, cycles: closed simple walks up to a length, each counted once from its least node. Bounded path joins."""
    path, out, e = graph.edges.select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")), None, graph.edges
    path = path.filter("last > first")
    for length in range(2, longest + 1):
        step = path.join(e, path["last"] == e["src"]).select("first", "path", F.col("dst").alias("next"))
        closed = step.filter("next = first").agg(F.count("*").alias("cycles")).select(F.lit(length).cast("long").alias("length"), "cycles")
        out = closed if out is None else out.unionByName(closed)
        path = step.filter(~F.array_contains("path", F.col("next")) & (F.col("next") > F.col("first"))).select("first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path"))
    return out
