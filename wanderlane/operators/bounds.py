"""Confidence bounds of estimates, and the tests that end a top-k search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import ALPHA
from .topk import top_k


def deviation(rsum: Column, pfail: float, upper: Column, walks: Column) -> Column:
    term = math.log(2 / pfail)
    return rsum * term / (3 * walks) + F.sqrt(4 / 9 * term**2 * rsum * rsum + 8 * walks * term * rsum * upper) / (2 * walks)


def _bounds(p: Column, absolute: Column, relative: Column, floor: Column) -> tuple[Column, Column]:
    tight = relative < 1
    ub = F.least(p + absolute, F.when(tight, p / (1 - relative)), F.lit(1.0))
    lb = F.greatest(p - absolute, F.when(tight, p / (1 + relative)), floor)
    return lb, ub


def ppr_bounds(estimates: DataFrame, n: int, pfail: float, previous: DataFrame | None = None) -> DataFrame:
    """source, node, score, lb, ub from (source, node, score, reserve, rsum, walks), within earlier bounds where given."""
    d = estimates
    if previous is not None:
        d = d.join(previous.select("source", "node", F.col("lb").alias("lb0"), F.col("ub").alias("ub0")), ["source", "node"], "left")
    else:
        d = d.withColumns({"lb0": F.lit(None).cast("double"), "ub0": F.lit(None).cast("double")})
    term = math.log(2 / pfail)
    upper = F.greatest(F.coalesce("ub0", F.lit(1.0)) - F.col("reserve"), F.lit(0.0))
    x = F.when(F.col("reserve") > 1 / n, F.greatest(F.col("reserve"), F.coalesce("lb0", F.lit(0.0)))).when(F.col("lb0") > 0, F.col("lb0")).otherwise(1 / n)
    relative = F.sqrt(2.67 * F.col("rsum") * term / F.col("walks")) / F.sqrt(x)
    lb, ub = _bounds(F.col("score"), deviation(F.col("rsum"), pfail, upper, F.col("walks")), relative, F.col("reserve"))
    return d.select("source", "node", "score", F.greatest(lb, F.coalesce("lb0", F.lit(0.0))).alias("lb"), F.least(ub, F.coalesce("ub0", F.lit(1.0))).alias("ub"))


def self_bounds(estimates: DataFrame, pfail: float, eps: float, rmax: float, walks: float, previous: DataFrame | None = None, alpha: float = ALPHA) -> DataFrame:
    """node, self_ppr, lb, ub from (node, self_ppr, reserve); a score to itself starts between alpha and 1."""
    d = estimates
    if previous is not None:
        d = d.join(previous.select("node", F.col("lb").alias("lb0"), F.col("ub").alias("ub0")), "node", "left")
    else:
        d = d.withColumns({"lb0": F.lit(None).cast("double"), "ub0": F.lit(None).cast("double")})
    d = d.withColumns({"lb0": F.coalesce("lb0", F.lit(alpha)), "ub0": F.coalesce("ub0", F.lit(1.0))})
    term = math.log(2 / pfail)
    relative = F.lit(math.sqrt((2 + 2 / 3 * eps) * rmax * term / walks)) / F.sqrt(F.greatest("reserve", "lb0"))
    lb, ub = _bounds(F.col("self_ppr"), deviation(F.lit(rmax), pfail, F.col("ub0"), F.lit(walks)), relative, F.col("reserve"))
    return d.select("node", "self_ppr", F.greatest(lb, "lb0").alias("lb"), F.least(ub, "ub0").alias("ub"))


def hitting_bounds(ppr: DataFrame, own: DataFrame) -> DataFrame:
    """source, node, score, lb, ub of dht, from bounds of both parts."""
    o = own.select("node", F.col("self_ppr"), F.col("lb").alias("lb_self"), F.col("ub").alias("ub_self"))
    return ppr.join(o, "node").select("source", "node", (F.col("score") / F.col("self_ppr")).alias("score"), (F.col("lb") / F.col("ub_self")).alias("lb"), F.least(F.col("ub") / F.col("lb_self"), F.lit(1.0)).alias("ub"))


def candidates(bounds: DataFrame, k: int) -> DataFrame:
    """The rows that may be among the k best: upper bound not below the k-th greatest lower bound."""
    least = top_k(bounds, k, "lb").groupBy("source").agg(F.min("score").alias("kth"))
    return bounds.join(least, "source").filter("ub >= kth").drop("kth")


def martingale_slack(score: float, pfail: float, rmax: float, walks: float, least: float) -> float:
    """How far a score may be off: the deviation of a martingale with steps of at most rmax, for a score of at least `least`."""
    term = math.log(1 / pfail)
    return rmax * term / (3 * walks) + math.sqrt((rmax * term / (3 * walks)) ** 2 + 2 * rmax * term / walks * max(score, least))


def martingale(estimates: DataFrame, lam: float, pfail: float, rmax: float, walks: float, least: float) -> DataFrame:
    """source, node, score, lb, ub of reverse push met by walks, from (source, node, score, reserve): the walks' sum is a
    martingale with steps of at most rmax; lam is its deviation, least the smallest score of interest."""
    term = math.log(1 / pfail)
    slack = F.lit(rmax * term / (3 * walks)) + F.sqrt(F.lit((rmax * term / (3 * walks)) ** 2) + 2 * rmax * term / walks * F.greatest(F.col("score"), F.lit(least)))
    lb = F.greatest(F.col("score") - F.least(slack, F.lit(lam)), F.col("reserve"))
    return estimates.select("source", "node", "score", lb.alias("lb"), F.least(F.col("score") + slack, F.lit(1.0)).alias("ub"))


def stops(bounds: DataFrame, k: int, eps: float, delta: float, threshold: float | None = None) -> DataFrame:
    """source, stop: whether the k best are settled.

    With a threshold (ppr): yes if the k-th score is at least 2 delta; else no while delta is not below the threshold.
    The k best by lower bound must be tight (ub <= (1 + eps) lb) with the k-th above delta, and no other node may have an
    upper bound above (1 + eps) times the k-th lower bound with bounds close enough to count.
    """
    best = top_k(bounds, k, "lb", keep=("ub",)).select("source", "node", F.col("score").alias("lb"), "ub")
    settled = best.groupBy("source").agg(F.min("lb").alias("kth"), F.max((F.col("ub") > (1 + eps) * F.col("lb")).cast("int")).alias("loose"))
    others = bounds.join(best.select("source", "node"), ["source", "node"], "left_anti").join(settled, "source")
    rival = (F.col("ub") > F.col("kth") * (1 + eps)) & (F.col("ub") <= (1 + eps) / (1 - eps) * F.col("lb"))
    rivals = others.groupBy("source").agg(F.max(rival.cast("int")).alias("rival"))
    d = settled.join(rivals, "source", "left").select("source", ((F.col("loose") == 0) & (F.col("kth") > delta) & (F.coalesce("rival", F.lit(0)) == 0)).alias("stop"))
    if threshold is None:
        return d
    kth = top_k(bounds, k).groupBy("source").agg(F.min("score").alias("kth_score"), F.count("*").alias("found"))
    sure = (F.col("kth_score") >= 2 * delta) & (F.col("found") >= k)
    return d.join(kth, "source").select("source", (sure | (F.lit(delta < threshold) & F.col("stop"))).alias("stop"))
