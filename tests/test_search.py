"""A hitting search goes on until its lists are settled or both its errors are at their least."""

import math

import pytest
from pyspark.sql import functions as F

from wanderlane.functions import params as P
from wanderlane.operators import search
from wanderlane.operators.graph import Graph, clean_edges


def spied(monkeypatch, owner, name, note):
    f, seen = getattr(owner, name), []

    def run(*args, **options):
        seen.append(note(*args, **options))
        return f(*args, **options)

    monkeypatch.setattr(owner, name, run)
    return seen


def test_self_scores_are_refined_to_the_end_once_delta_is(spark, monkeypatch):
    n = 120
    g = Graph(clean_edges(spark.createDataFrame([(k, (k * j + j) % n) for k in range(n) for j in (1, 7)], "src long, dst long")))
    stops = search.B.stops
    monkeypatch.setattr(search.B, "stops", lambda *a, **o: stops(*a, **o).withColumn("stop", F.lit(False)))
    errors = spied(monkeypatch, search.B, "self_bounds", lambda d, pfail, eps, *rest: eps)
    search.hitting_search(g, spark.createDataFrame([(0,)], "source long"), 3, 0.5, least_delta=0.25, most_self_walks=20, steps=20).collect()
    assert errors == [0.5, 0.25, pytest.approx(math.sqrt(1 / (g.sizes[0] * P.ALPHA)))]


def test_a_round_starts_from_a_state_that_was_written(spark, monkeypatch):
    n = 120
    g = Graph(clean_edges(spark.createDataFrame([(k, (k * j + j) % n) for k in range(n) for j in (1, 7)], "src long, dst long")))
    stops = search.B.stops
    monkeypatch.setattr(search.B, "stops", lambda *a, **o: stops(*a, **o).withColumn("stop", F.lit(False)))
    states = spied(monkeypatch, search, "forward_push", lambda graph, state, rmax: state._jdf.queryExecution().logical().toString())
    search.ppr_search(g, spark.createDataFrame([(0,), (1,)], "source long"), 3, 0.5, least_delta=0.125, steps=20)
    assert len(states) == 2 and "Join" not in states[1] and "Union" not in states[1]


def test_self_scores_are_made_once_an_error(spark, monkeypatch):
    n = 120
    g = Graph(clean_edges(spark.createDataFrame([(k, (k * j + j) % n) for k in range(n) for j in (1, 7)], "src long, dst long")))
    stops = search.B.stops
    monkeypatch.setattr(search.B, "stops", lambda *a, **o: stops(*a, **o).withColumn("stop", F.lit(False)))
    monkeypatch.setattr(search.P, "cost_forward", lambda *a: 0.0)
    errors = spied(monkeypatch, search.B, "self_bounds", lambda d, pfail, eps, *rest: eps)
    counts = spied(monkeypatch, search, "self_by_walks", lambda g, targets, rmax, count, **o: count)
    search.hitting_search(g, spark.createDataFrame([(0,)], "source long"), 3, 0.5, least_delta=0.125, most_self_walks=20, steps=20)
    assert len(errors) == len(set(errors)) + 1 and len(counts) == len(set(errors))
