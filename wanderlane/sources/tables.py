"""Graphs derived from the star schema and the event stream.

Trade graph: customers 3k, parts 3k+1, suppliers 3k+2; customer -> part (bought), part -> supplier (of a line),
supplier -> customer (same nation).
Event graph: consecutive users of the purchases, in order of time; every node has out-edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRADE_SQL = """select distinct 3*o_custkey src, 3*l_partkey+1 dst from orders join lineitem on o_orderkey=l_orderkey
union all select distinct 3*l_partkey+1, 3*l_suppkey+2 from lineitem
union all select 3*s_suppkey+2, 3*c_custkey from supplier join customer on s_nationkey=c_nationkey"""
EVENT_SQL = """select distinct src, dst from (select user_id src, lead(user_id) over (order by ts, event_id) dst
from events where event_type='purchase') where dst is not null and src<>dst"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers and parts, some more than once."""
    t = lambda name: read(spark, sf_dir, name)
    bought = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((3 * F.col("o_custkey")).alias("src"), (3 * F.col("l_partkey") + 1).alias("dst"))
    made = t("lineitem").select((3 * F.col("l_partkey") + 1).alias("src"), (3 * F.col("l_suppkey") + 2).alias("dst"))
    return bought.unionByName(made)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    near = t("supplier").join(t("customer"), F.col("s_nationkey") == F.col("c_nationkey")).select((3 * F.col("s_suppkey") + 2).alias("src"), (3 * F.col("c_custkey")).alias("dst"))
    return _trade(spark, sf_dir).distinct().unionByName(near)


def trade_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trade graph in parts: edges from customers and parts, which may repeat and count once; (node, list) of suppliers; (list, dst). Suppliers of the same
    nations, as often in the table, have the same customers, suppliers times customers edges; each list has them once."""
    plain = _trade(spark, sf_dir)
    at = read(spark, sf_dir, "supplier").filter("s_suppkey is not null and s_nationkey is not null")
    of = at.groupBy((3 * F.col("s_suppkey") + 2).cast("long").alias("node")).agg(F.sort_array(F.collect_list("s_nationkey")).alias("nations"))
    groups = of.groupBy("nations").agg(F.min("node").alias("list"))
    customers = read(spark, sf_dir, "customer").filter("c_custkey is not null").select(F.col("c_nationkey").alias("nation"), (3 * F.col("c_custkey")).cast("long").alias("dst"))
    members = groups.select("list", F.explode("nations").alias("nation")).join(customers, "nation").select("list", "dst")
    return plain, of.join(groups, "nations").select("node", "list"), members


def trade_entries(spark: SparkSession, sf_dir: str) -> int:
    """So many entries the trade graph's own lists have at most; only footers are read."""
    return 2 * read(spark, sf_dir, "lineitem").count()


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next purchase in time is found within each day; a day's last is followed by the first of the next day that has one."""
    p = read(spark, sf_dir, "events").filter("event_type = 'purchase'").select("ts", "event_id", "user_id", F.to_date("ts").alias("day"))
    within = Window.partitionBy("day").orderBy("ts", "event_id")
    p = p.withColumn("next", F.lead("user_id").over(within))
    firsts = p.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("first"))  # a row a day
    follow = firsts.select("day", F.lead("first").over(Window.orderBy("day")).alias("follow"))
    pairs = p.join(follow, "day").select(F.col("user_id").alias("src"), F.coalesce("next", "follow").alias("dst"))
    return pairs.filter("dst is not null and src <> dst").distinct()
