"""Cutting lineage between the rounds of an iterative plan.

A state is written to the folder all machines share (spark.checkpoint.dir) and read back, so plans stay short and lost
executors cost one round.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir. Where it is unset, a temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='wanderlane-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """by: a column whose values have a folder each, so that a filter on it reads those folders only."""
    path = f"{shared_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete states that no plan reads any more."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextlib.contextmanager
def short_rounds(spark: SparkSession) -> Iterator[None]:
    """Inside a loop, small shuffle partitions are merged by size alone: a small state is one task and one file."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)
