"""Closed-form graphs, invariants, and agreement of estimators with each other."""

import math

import pytest
from pyspark.sql import functions as F

from wanderlane.functions import params as P
from wanderlane.operators import bounds, estimators, evaluate, index, push, search, topk, truth, walks
from wanderlane.operators.graph import Graph, clean_edges
from wanderlane.plans import engine
from wanderlane.sources import graph_files as files
from wanderlane.streaming import edges as stream

G1 = [(0, 1), (0, 2), (1, 2), (2, 0)]


def graph(spark, pairs, undirected=False):
    return Graph(clean_edges(spark.createDataFrame(pairs, "src long, dst long"), undirected))


def sources(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "source long")


def scores(df, value="score"):
    return {(r.source, r.node): r[value] for r in df.collect()}


@pytest.mark.parametrize(
    ("pairs", "source", "expected"),
    [
        (G1, 0, {0: 0.471698113, 1: 0.188679245, 2: 0.339622642}),
        ([*G1, (2, 3)], 0, {0: 0.415282392, 1: 0.166112957, 2: 0.299003322, 3: 0.119601329}),
        ([(1, 0), (2, 0)], 0, {0: 1.0}),
        ([(0, 1), (0, 1), (0, 2)], 0, {0: 0.555555556, 1: 0.296296296, 2: 0.148148148}),
        ([(0, 0), (0, 1), (1, 0)], 0, {0: 0.555555556, 1: 0.444444444}),
    ],
)
def test_power_iteration_on_closed_forms(spark, pairs, source, expected):
    got = scores(push.power_iteration(graph(spark, pairs), sources(spark, source), 60))
    assert {n: pytest.approx(v, abs=2e-6) for n, v in expected.items()} == {n: v for (_, n), v in got.items()}


def test_undirected_edges_go_both_ways(spark):
    got = scores(push.power_iteration(graph(spark, [(0, 1)], undirected=True), sources(spark, 0), 60))
    assert got[0, 0] == pytest.approx(0.555555556, abs=2e-6)


def test_push_keeps_mass_and_ends_below_the_threshold(spark):
    g = graph(spark, [*G1, (2, 3), (3, 1)])
    state = push.forward_push(g, push.unit_state(sources(spark, 0, 1)), 0.01)
    for r in state.groupBy("source").agg(F.sum(F.col("reserve") + F.col("residual")).alias("mass")).collect():
        assert r.mass == pytest.approx(1)
    deg = g.nodes.select("node", "out_deg")
    assert state.join(deg, "node").filter(F.col("residual") / F.greatest("out_deg", F.lit(1)) >= 0.01).isEmpty()


def test_hitting_scores_agree(spark):
    g, s = graph(spark, G1), sources(spark, 0)
    exact = {(0, 0): 1.0, (0, 1): 0.588235294, (0, 2): 0.72}
    by_ratio = scores(estimators.ratio(push.power_iteration(g, s, 60), truth.all_self(g, 1e-6)))
    assert by_ratio == {k: pytest.approx(v, abs=1e-5) for k, v in exact.items()}
    t = g.nodes.select(F.col("node").alias("target"))
    h = {(r.node, r.target): r.score for r in push.hitting_iteration(g, t, 60).collect()}
    local = {(r.node, r.target): (r.lb, r.ub) for r in push.hitting_local(g, t, 2, 40).collect()}
    for (s_, t_), v in exact.items():
        assert h[s_, t_] == pytest.approx(v, abs=1e-5)
        assert local[s_, t_][0] - 1e-6 <= v <= local[s_, t_][1] + 1e-6


def test_walk_estimators_come_near_the_truth(spark):
    g, s = graph(spark, [*G1, (2, 3), (3, 1)]), sources(spark, 0)
    true = scores(push.power_iteration(g, s, 60))
    t = g.nodes.select(F.col("node").alias("target"))
    for got in (walks.monte_carlo(g, s, 4000, steps=24), estimators.push_walk(g, s, 0.05, 4000.0, steps=24), estimators.bippr(g, s, t, 0.1, 2000, steps=24), index.one_hop_walks(g, s, 4000, steps=24)):
        got = scores(got)
        assert sum(got.values()) == pytest.approx(1, abs=0.06)
        assert all(got[k] == pytest.approx(v, abs=0.03) for k, v in true.items())
    hitting = scores(walks.monte_carlo_hitting(g, s, 4000, steps=24))
    exact = scores(estimators.ratio(push.power_iteration(g, s, 60), truth.all_self(g, 1e-6)))
    assert all(hitting[k] == pytest.approx(v, abs=0.03) for k, v in exact.items())


def test_indexed_and_cached_walks_give_the_online_scores(spark):
    g, s = graph(spark, [*G1, (2, 3), (3, 1)]), sources(spark, 0, 3)
    online = scores(estimators.push_walk(g, s, 0.05, 200.0))
    ix = index.walk_index(g, 0.05, 200.0)
    assert scores(estimators.push_walk_indexed(g, s, 0.05, 200.0, ix)) == pytest.approx(online)
    got, cache = estimators.push_walk_cached(g, s, 0.05, 200.0, ix.filter("walk_no <= 2"))
    assert scores(got) == pytest.approx(online)
    assert cache.groupBy("src", "walk_no").count().filter("count > 1").isEmpty()


def test_incremental_push_reaches_the_same_truth(spark):
    g, s = graph(spark, G1), sources(spark, 0)
    coarse = push.forward_push(g, push.unit_state(s), 0.1)
    fine = push.forward_push(g, coarse, 0.0001)
    assert scores(fine, "reserve") == {k: pytest.approx(v, abs=1e-3) for k, v in scores(push.power_iteration(g, s, 60)).items()}


def test_bounds_hold_and_searches_find_the_best(spark):
    g, s = graph(spark, [*G1, (2, 3), (3, 1)]), sources(spark, 0)
    true = scores(push.power_iteration(g, s, 60))
    state = push.forward_push(g, push.unit_state(s), 0.05)
    found = bounds.ppr_bounds(search._round(g, state, 500.0), 4, 1e-3).collect()
    assert all(r.lb - 1e-9 <= true[0, r.node] <= r.ub + 1e-9 for r in found)
    best = [r.node for r in search.ppr_search(g, s, 2, 0.5, least_delta=0.05).orderBy("rank").collect()]
    assert set(best) == {n for (_, n), _ in sorted(true.items(), key=lambda x: -x[1])[:2]}
    hit = [r.node for r in search.hitting_search(g, s, 1, 0.5, least_delta=0.1, most_self_walks=100).collect()]
    assert hit == [0]


def test_top_k_breaks_ties_by_node_and_does_not_pad(spark):
    df = spark.createDataFrame([(0, 5, 0.5), (0, 3, 0.5), (0, 4, 0.1)], "source long, node long, score double")
    assert [(r["rank"], r.node) for r in topk.top_k(df, 9).orderBy("rank").collect()] == [(1, 3), (2, 5), (3, 4)]


def test_evaluation(spark):
    t = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 2, 0.3)], "source long, rank int, node long, score double")
    f = spark.createDataFrame([(0, 1, 1, 0.4), (0, 2, 9, 0.3), (0, 3, 8, 0.1)], "source long, rank int, node long, score double")
    assert [(r.k, r.precision, r.recall) for r in evaluate.precision_recall(f, t, [1, 3]).orderBy("k").collect()] == [(1, 1.0, 1.0), (3, pytest.approx(1 / 3), 0.5)]
    got = evaluate.ndcg(f, t, [2]).first().ndcg
    gain = [2**0.5 - 1, (2**0.3 - 1) / math.log2(3)]
    assert got == pytest.approx(gain[0] / sum(gain), abs=1e-8)
    e = evaluate.errors(f, t).first()
    assert (e.max_abs_err, e.max_rel_err) == (0.3, 1.0)


def test_hub_walks_spend_whole_budgets(spark):
    g, s = graph(spark, [*G1, (2, 3), (3, 1)]), sources(spark, 0)
    ix = index.hub_index(g, index.hubs(g, 1), 4)
    assert index.hub_sizes(ix).first().budget == 15
    counts = index.hub_walks(g, s, 50, ix)
    assert counts.agg(F.sum("cnt")).first()[0] == 50


def test_parameters():
    p = P.defaults(1000, 5000, 0.5)
    assert P.push_walk(p).walks == pytest.approx(2.5 * math.log(2000) * 1000 / 0.25)
    assert P.bound_threshold(281904) == pytest.approx(1.0715e-4, rel=1e-3)
    for bad in (0, -1):
        with pytest.raises(ValueError, match="eps"):
            P.defaults(10, 10, bad)


def test_files_round_trip(spark, tmp_path):
    g = graph(spark, G1)
    files.write_graph(g, str(tmp_path / "g"))
    assert files.read_sizes(spark, str(tmp_path / "g")) == (3, 4)
    again = files.read_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, again.edges.collect())) == sorted(G1)
    files.write_query_set(files.high_degree_nodes(g, 2), str(tmp_path / "q"))
    assert [r.source for r in files.read_query_set(spark, str(tmp_path / "q")).orderBy("qno").collect()] == [0, 1]
    assert {r.source for r in files.random_nodes(g, 30).collect()} <= {0, 1, 2}
    path = files.write_index(index.walk_index(g, 0.1, 20.0), str(tmp_path), scale=2)
    assert path.endswith("walks.2.parquet")
    assert files.read_truth(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("algo", [a for a in engine.PPR + engine.DHT if a not in ("power", "exact_dht", "hub", "montecarlo_all")])
def test_every_algorithm_runs_by_name(spark, algo):
    g = graph(spark, G1)
    o = engine.Options(algo=algo, k=2, walks=50, rounds=20, steps=20, hubs=1, hub_levels=3)
    got = engine.query(g, sources(spark, 0), o)
    assert got.columns == ["source", "node", "score"]
    assert got.count() > 0


def test_run_writes_a_report(spark, tmp_path):
    out = engine.run(graph(spark, G1), "gen-exact-topk", sources(spark, 0), engine.Options(k=2, rounds=10), str(tmp_path))
    assert out.count() == 2
    assert list(tmp_path.glob("run-*.json"))
    with pytest.raises(ValueError, match="no action"):
        engine.run(graph(spark, G1), "fly", sources(spark, 0), engine.Options())


def test_an_empty_query_set_gives_no_rows(spark):
    g = graph(spark, G1)
    assert push.power_iteration(g, sources(spark), 5).isEmpty()
    assert estimators.push_only(g, sources(spark, 77), 0.1).count() <= 1


def test_streamed_degrees(spark, tmp_path):
    spark.createDataFrame(G1, "src long, dst long").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "in"))
    q = stream.running_degrees(s).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.node, r.out_deg, r.in_deg) for r in spark.table("degrees").collect()} == {(0, 2, 1), (1, 1, 1), (2, 1, 2)}
