"""A stream of edges: running degrees, and degrees by event-time window for edges that may come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """node, out_deg, in_deg of a streaming (src, dst); for output modes complete and update."""
    ends = edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_deg"), F.sum("e.i").alias("in_deg"))


def windowed_degrees(edges: DataFrame, time_col: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, node, out_deg of a streaming (ts, src, dst) in tumbling windows; rows later than the watermark are dropped."""
    d = edges.filter("src <> dst").withWatermark(time_col, late)
    return d.groupBy(F.window(time_col, window), F.col("src").alias("node")).agg(F.count("*").alias("out_deg")).select(F.col("window.start").alias("start"), "node", "out_deg")
