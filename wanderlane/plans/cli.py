"""Command line: python -m wanderlane.plans.cli ACTION --graph FOLDER [options]; see --help."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from ..sources import graph_files as files
from . import engine

VERSION = "2"
ACTIONS = ["query", "topk", "batch-topk", "build", "build-hubs", "generate-ss-query", "gen-exact-topk", "gen-exact-self", "gen-exact-dht", "statistic"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wanderlane", description="Random-walk scores on a directed graph")
    p.add_argument("action", choices=ACTIONS)
    where = p.add_mutually_exclusive_group(required=True)
    where.add_argument("--graph", help="folder with graph.txt")
    where.add_argument("--dataset", help="name of such a folder under --prefix")
    p.add_argument("--prefix", default=".", help="folder of datasets")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--undirected", action="store_true")
    p.add_argument("--algo", default="push_walk", choices=engine.PPR + engine.DHT)
    p.add_argument("--epsilon", type=float, default=0.5)
    p.add_argument("--k", type=int, default=500)
    p.add_argument("--rounds", type=int, default=100, help="of exact scores")
    p.add_argument("--query_size", type=int, default=1000)
    p.add_argument("--query_high_degree", action="store_true")
    p.add_argument("--rmax_scale", type=float, default=1.0)
    p.add_argument("--rw_ratio", type=float, default=1.0)
    p.add_argument("--with_idx", action="store_true", help="take walks from the index that build made")
    p.add_argument("--hub_space", type=int, default=100, help="number of hubs")
    p.add_argument("--hub_levels", type=int, default=10, help="2^levels - 1 walks are kept for each hub")
    p.add_argument("--multithread", type=int, help="shuffle partitions; by default the session's")
    p.add_argument("--exact_ppr_path", help="folder of ground truth; by default the graph's")
    p.add_argument("--ndcg", action="store_true", help="hold found lists against the truth: precision, recall, NDCG")
    p.add_argument("--out", help="where to write the result as Parquet")
    p.add_argument("--result_dir", help="folder for reports")
    p.add_argument("--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    if a.multithread:
        spark.conf.set("spark.sql.shuffle.partitions", str(a.multithread))
    folder = a.graph or f"{a.prefix.rstrip('/')}/{a.dataset}"
    name = f"{folder}/{'high_degree_' if a.query_high_degree else ''}ssquery.txt"
    if a.action == "generate-ss-query" and not a.query_high_degree and files.has_sizes(spark, folder):
        files.write_query_set(files.random_nodes(files.read_sizes_only(spark, folder), a.query_size), name)
        return
    graph = files.read_graph(spark, folder, a.undirected)
    if a.action == "generate-ss-query":
        pick = files.high_degree_nodes if a.query_high_degree else files.random_nodes
        files.write_query_set(pick(graph, a.query_size), name)
        return
    options = engine.Options(algo=a.algo, eps=a.epsilon, k=a.k, rmax_scale=a.rmax_scale, ratio=a.rw_ratio, rounds=a.rounds, hubs=a.hub_space, hub_levels=a.hub_levels)
    sources = None if a.action in ("build", "build-hubs", "statistic") else files.read_query_set(spark, name, a.query_size).select("source")
    walk_index = None
    if a.with_idx:
        walk_index = files.read_index(spark, folder, "hubs" if a.algo == "hub" else "walks", scale=a.rmax_scale)
    out = engine.run(graph, a.action, sources, options, a.result_dir, walk_index, a.exact_ppr_path or folder, a.ndcg)
    if a.action in ("build", "build-hubs"):
        files.write_index(out, folder, "walks" if a.action == "build" else "hubs", scale=a.rmax_scale)
    elif a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
