"""Accuracy of ranked lists and scores against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import cut
from .graph import Graph
from .push import self_scores


def precision_recall(found: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """source, k, precision (of what was returned), recall (of the true ones) for each k; both are (source, rank, node, score)."""
    levels = F.explode(F.array(*[F.lit(k) for k in ks]))
    f = found.withColumn("k", levels).filter("rank <= k").select("source", "k", "node")
    t = truth.filter("score > 0").withColumn("k", levels).filter("rank <= k").select("source", "k", "node")
    hits = f.join(t, ["source", "k", "node"], "left_semi").groupBy("source", "k").agg(F.count("*").alias("hits"))
    returned, true = f.groupBy("source", "k").agg(F.count("*").alias("returned")), t.groupBy("source", "k").agg(F.count("*").alias("true"))
    d = true.join(returned, ["source", "k"], "left").join(hits, ["source", "k"], "left")
    return d.select("source", "k", F.round(F.coalesce("hits", F.lit(0)) / F.col("returned"), 9).alias("precision"), F.round(F.coalesce("hits", F.lit(0)) / F.col("true"), 9).alias("recall"))


def ndcg(found: DataFrame, truth: DataFrame, ks: list[int], relevance: DataFrame | None = None) -> DataFrame:
    """source, k, ndcg: gain 2^score - 1, discount log2(rank + 1); a node's score is the true one, from relevance
    (source, node, score) where the truth list does not have it."""
    levels = F.explode(F.array(*[F.lit(k) for k in ks]))
    known = truth.select("source", "node", F.col("score").alias("rel"))
    d = found.join(known, ["source", "node"], "left")
    if relevance is not None:
        d = d.join(relevance.select("source", "node", F.col("score").alias("rel2")), ["source", "node"], "left").withColumn("rel", F.coalesce("rel", "rel2"))
    gain = lambda s: (F.pow(F.lit(2.0), s) - 1) / F.log2(F.col("rank") + 1.0)
    got = d.withColumn("k", levels).filter("rank <= k").groupBy("source", "k").agg(F.sum(gain(F.coalesce("rel", F.lit(0.0)))).alias("got"))
    best = truth.withColumn("k", levels).filter("rank <= k").groupBy("source", "k").agg(F.sum(gain(F.col("score"))).alias("best"))
    return best.join(got, ["source", "k"], "left").select("source", "k", F.round(F.coalesce("got", F.lit(0.0)) / F.col("best"), 9).alias("ndcg"))


def hitting_pairs(graph: Graph, found: DataFrame, truth: DataFrame, ppr: DataFrame, fine: float = 1e-10) -> DataFrame:
    """source, node, score (dht) of the pairs in found that truth does not have: exact ppr over an exact self score, which is
    pushed for these nodes only. What no walk reaches has score 0."""
    missing = cut(found.select("source", "node").join(truth.select("source", "node"), ["source", "node"], "left_anti").distinct())
    own = self_scores(graph, missing.select(F.col("node").alias("target")).distinct(), fine)
    pairs = missing.join(ppr, ["source", "node"], "left").join(own, "node", "left")
    return pairs.select("source", "node", F.coalesce(F.least(F.col("score") / F.col("self_ppr"), F.lit(1.0)), F.lit(0.0)).alias("score"))


def errors(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """source, max_abs_err, avg_abs_err, max_rel_err, avg_rel_err over the nodes with a true score."""
    d = truth.select("source", "node", F.col("score").alias("t")).join(estimate.select("source", "node", F.col("score").alias("e")), ["source", "node"], "left")
    diff = F.abs(F.col("t") - F.coalesce("e", F.lit(0.0)))
    # A true score that was rounded to 0: as SQL divides doubles.
    r = F.when(F.col("t") != 0, diff / F.nullif(F.col("t"), F.lit(0.0))).when(diff == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    d = d.select("source", diff.alias("a"), r.alias("r"))
    return d.groupBy("source").agg(F.round(F.max("a"), 9).alias("max_abs_err"), F.round(F.avg("a"), 9).alias("avg_abs_err"), F.round(F.max("r"), 9).alias("max_rel_err"), F.round(F.avg("r"), 9).alias("avg_rel_err"))
