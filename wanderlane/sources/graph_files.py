"""Graph folders and the tables that are kept beside them.

A folder holds `attribute.txt` (n=..., m=...) and `graph.txt` (a pair of node ids a line). Query sets are text files of one
id a line. Indexes and ground truth are Parquet tables; an accuracy parameter is part of an index's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import draw
from ..operators.graph import Graph, clean_edges, sizes_only

BUCKETS = 64


def read_sizes(spark: SparkSession, folder: str) -> tuple[int, int]:
    """(n, m) of attribute.txt: the numbers after the first two equal signs, whatever stands before them."""
    lines = spark.read.text(f"{folder}/attribute.txt", wholetext=True).first()
    found = [int(x.split("=", 1)[1]) for x in (lines.value if lines else "").split("\n") if "=" in x]
    if len(found) < 2:
        raise ValueError(f"{folder}/attribute.txt has no two sizes")
    return found[0], found[1]


def read_edges(spark: SparkSession, folder: str, undirected: bool = False) -> DataFrame:
    """Edges of graph.txt, in any white space; lines without two numbers are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = spark.read.text(f"{folder}/graph.txt").select(F.get(parts, F.lit(0)).try_cast("long").alias("src"), F.get(parts, F.lit(1)).try_cast("long").alias("dst"))
    return clean_edges(pairs.filter("src is not null and dst is not null"), undirected)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def has_sizes(spark: SparkSession, folder: str) -> bool:
    return _exists(spark, f"{folder}/attribute.txt")


def read_graph(spark: SparkSession, folder: str, undirected: bool = False) -> Graph:
    """The graph of a folder. Where attribute.txt names the number of nodes, they are 0..n-1, with edges or without; an edge
    to any other node is an error."""
    edges = read_edges(spark, folder, undirected)
    if not has_sizes(spark, folder):
        return Graph(edges)
    n, _ = read_sizes(spark, folder)
    if not edges.filter(f"src < 0 or dst < 0 or src >= {n} or dst >= {n}").isEmpty():
        raise ValueError(f"{folder}/graph.txt has nodes outside 0..{n - 1}")
    return Graph(edges, n)


def read_sizes_only(spark: SparkSession, folder: str) -> Graph:
    """The graph's sizes without its edges, for random query nodes and parameters."""
    return sizes_only(spark, *read_sizes(spark, folder))


def write_graph(graph: Graph, folder: str) -> None:
    """graph.txt and attribute.txt, as folders of text parts."""
    n, m = graph.sizes
    graph.edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(f"{folder}/graph.txt")
    graph.spark.range(1).select(F.lit(f"n={n}\nm={m}").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/attribute.txt")


def random_nodes(graph: Graph, count: int, seed: str = "query") -> DataFrame:
    """qno, source: nodes drawn uniformly, with replacement, by the place of a node in the order (bucket, node).

    Places are a bucket's base plus the place in the bucket, so no task numbers all nodes. Where the nodes are known to be
    0..n-1, a place is a node, and no edge is read.
    """
    n, _ = graph.sizes
    if graph.count is not None:
        return graph.spark.range(count).select(F.col("id").alias("qno"), F.pmod(draw(seed, F.col("id")), F.lit(n)).alias("source"))
    nodes = graph.nodes.select("node", F.pmod("node", F.lit(BUCKETS)).alias("bucket"))
    totals = nodes.groupBy("bucket").agg(F.count("*").alias("n"))
    base = totals.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = nodes.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("node")) - 1).join(base, "bucket").select((F.col("at") + F.col("base")).alias("at"), F.col("node").alias("source"))
    picks = graph.spark.range(count).select(F.col("id").alias("qno"), F.pmod(draw(seed, F.col("id")), F.lit(n)).alias("at"))
    return picks.join(placed, "at").select("qno", "source")


def high_degree_nodes(graph: Graph, count: int) -> DataFrame:
    """qno, source: the nodes of greatest out-degree, ties by the lesser node."""
    top = graph.nodes.orderBy(F.col("out_deg").desc(), "node").limit(count)
    return top.select((F.row_number().over(Window.orderBy(F.col("out_deg").desc(), "node")) - 1).cast("long").alias("qno"), F.col("node").alias("source"))


def write_query_set(queries: DataFrame, path: str) -> None:
    queries.orderBy("qno").coalesce(1).select(F.col("source").cast("string").alias("value")).write.mode("overwrite").text(path)


def read_query_set(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """qno, source, in the order of the file; at most count. A missing file is an error."""
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").try_cast("long").alias("source")).filter("source is not null")
    numbered = lines.withColumn("place", F.monotonically_increasing_id())
    out = numbered.select((F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("qno"), "source")
    return out if count is None else out.filter(F.col("qno") < count)


def index_path(folder: str, kind: str, scale: float = 1.0) -> str:
    return f"{folder}/{kind}" + (f".{scale:g}" if scale != 1 else "") + ".parquet"


def write_index(index: DataFrame, folder: str, kind: str = "walks", scale: float = 1.0) -> str:
    """A table sorted by its first column inside files, so that reading some nodes skips most row groups."""
    path = index_path(folder, kind, scale)
    key = index.columns[0]
    index.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return path


def read_index(spark: SparkSession, folder: str, kind: str = "walks", scale: float = 1.0) -> DataFrame:
    return spark.read.parquet(index_path(folder, kind, scale))


def truth_path(folder: str, kind: str, k: int | None = None) -> str:
    return f"{folder}/truth-{kind}" + (f".{k}" if k else "") + ".parquet"


def write_truth(truth: DataFrame, path: str) -> None:
    """truth must not be read from path itself."""
    truth.write.mode("overwrite").parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame | None:
    """Ground truth, or None where there is none: it is optional."""
    return spark.read.parquet(path) if _exists(spark, path) else None
