"""Runs end to end: the command line, truth kept and found again, lists held against it, lone sources, hubs that save steps."""

import json
import logging
import math

import pytest
from pyspark.sql import functions as F

from wanderlane.functions import params as P
from wanderlane.operators import estimators, evaluate, index, push, search, topk, truth, walks
from wanderlane.operators.graph import Graph, clean_edges
from wanderlane.plans import cli, engine
from wanderlane.sources import graph_files as files

G1 = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 1)]


def graph(spark, pairs=G1, count=None):
    return Graph(clean_edges(spark.createDataFrame(pairs, "src long, dst long")), count)


def sources(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "source long")


def scores(df):
    return {(r.source, r.node): r.score for r in df.collect()}


@pytest.fixture
def folder(spark, tmp_path):
    files.write_graph(graph(spark), f"{tmp_path}/net")
    return tmp_path


def test_command_line_from_queries_to_metrics(spark, folder, caplog):
    caplog.set_level(logging.INFO, logger="wanderlane")
    at = ["--prefix", str(folder), "--dataset", "net", "--query_size", "2", "--k", "3", "--rounds", "60"]
    cli.main(["generate-ss-query", *at, "--query_high_degree"])
    common = [*at, "--query_high_degree"]
    cli.main(["gen-exact-topk", *common, "--out", f"{folder}/exact"])
    assert {r.source for r in spark.read.parquet(f"{folder}/exact").collect()} == {0, 2}
    cli.main(["build", *at, "--epsilon", "0.9"])
    cli.main(["topk", *common, "--algo", "power", "--ndcg", "--result_dir", f"{folder}/reports", "--out", f"{folder}/top"])
    facts = json.loads(next((folder / "reports").glob("run-*.json")).read_text())
    assert [m["k"] for m in facts["found"]["metrics"]] == [1, 2, 3]
    assert all(m["precision"] == m["recall"] == m["ndcg"] == 1 for m in facts["found"]["metrics"])
    assert set(facts["phases"]) == {"graph", "topk", "evaluation"} and any("evaluation took" in r.message for r in caplog.records)
    cli.main(["query", *common, "--with_idx", "--epsilon", "0.9", "--out", f"{folder}/scores"])
    assert spark.read.parquet(f"{folder}/scores").columns == ["source", "node", "score"]


def test_random_query_nodes_need_no_edges(spark, folder):
    (folder / "only").mkdir()
    (folder / "only" / "attribute.txt").write_text("n=50\nm=99\n")
    cli.main(["generate-ss-query", "--graph", f"{folder}/only", "--query_size", "30"])
    got = [r.source for r in files.read_query_set(spark, f"{folder}/only/ssquery.txt").collect()]
    assert len(got) == 30 and all(0 <= x < 50 for x in got)


def test_options_are_checked():
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["topk"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--version"])


def test_truth_is_made_once_and_found_again(spark, folder, monkeypatch):
    g, o = graph(spark), engine.Options(algo="exact_dht", k=2, rounds=60)
    first, own = engine.truth_of(g, sources(spark, 0), o, str(folder))
    exact = scores(estimators.ratio(push.power_iteration(g, sources(spark, 0), 60), truth.all_self(g)))
    best = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [(r.node, pytest.approx(r.score, abs=1e-5)) for r in first.orderBy("rank").collect()] == [(n, v) for (_, n), v in best]
    before = {r.node for r in files.read_truth(spark, files.truth_path(str(folder), "self")).collect()}
    monkeypatch.setattr(truth, "exact_topk", lambda *a, **k: pytest.fail("known already"))
    again, _ = engine.truth_of(g, sources(spark, 0), o, str(folder))
    assert again.count() == 2 and before


def test_batches_are_parts_of_one_list(spark, monkeypatch):
    calls, top = [], engine.top
    monkeypatch.setattr(engine, "top", lambda *a, **k: calls.append(1) or top(*a, **k))
    got = engine.batch_top(graph(spark), sources(spark, 0), engine.Options(algo="power", k=4, rounds=20), parts=2)
    assert sorted((r.k_asked, r["rank"]) for r in got.collect()) == [(2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4)]
    assert len(calls) == 1


def test_hitting_lists_are_rated_with_exact_pairs(spark):
    g, s = graph(spark), sources(spark, 0)
    ppr = push.power_iteration(g, s, 60)
    exact = scores(estimators.ratio(ppr, truth.all_self(g)))
    found = spark.createDataFrame([(0, 1, 3, 0.9), (0, 2, 0, 0.8)], "source long, rank int, node long, score double")
    true = topk.top_k(truth.exact_hitting(g, s, 2, 60), 2)
    pairs = scores(evaluate.hitting_pairs(g, found, true, ppr))
    assert all(v == pytest.approx(exact[k], abs=1e-6) for k, v in pairs.items()) and (0, 3) in pairs
    gain = lambda v: 2**v - 1
    best = sorted(exact.values(), reverse=True)[:2]
    expected = (gain(exact[0, 3]) + gain(exact[0, 0]) / math.log2(3)) / (gain(best[0]) + gain(best[1]) / math.log2(3))
    got = engine.evaluate_top(found, true, 2, evaluate.hitting_pairs(g, found, true, ppr)).filter("k = 2").first()
    assert got.ndcg == pytest.approx(expected, abs=1e-5)


def test_estimators_agree_on_sources_without_edges(spark):
    for g in (graph(spark), graph(spark, count=9)):
        s = sources(spark, 7, 0)
        mine = lambda df: {n: v for (x, n), v in scores(df).items() if x == 7}
        assert mine(push.power_iteration(g, s, 60)) == {7: pytest.approx(1, abs=2e-6)}
        state = push.forward_push(g, push.unit_state(s), 1e-4).filter("source = 7").first()
        assert (state.reserve, state.residual) == (pytest.approx(1 - 0.8**42), pytest.approx(0.8**42))
        assert mine(walks.monte_carlo(g, s, 20)) == {7: 1.0}
        assert mine(estimators.push_walk(g, s, 1e-3, 50.0)) == {7: pytest.approx(1)}
        assert mine(index.one_hop_walks(g, s, 20)) == {7: 1.0}
    assert graph(spark, count=9).sizes == (9, 6)


def test_edges_outside_the_named_nodes_are_an_error(spark, folder):
    (folder / "bad").mkdir()
    (folder / "bad" / "attribute.txt").write_text("n=3\nm=1\n")
    (folder / "bad" / "graph.txt").write_text("0 5\n")
    with pytest.raises(ValueError, match="outside"):
        files.read_graph(spark, f"{folder}/bad")


def test_a_push_that_does_not_end_raises(spark):
    with pytest.raises(RuntimeError, match="above the threshold"):
        push.forward_push(graph(spark), push.unit_state(sources(spark, 0)), 1e-6, rounds=8)


def test_edges_are_numbered_in_order(spark):
    far = [(0, (7 * k) << 14) for k in range(1, 30)] + [(0, 7 << 14), (5, 0)]
    got = [(r.node, r["at"], r.dst) for r in graph(spark, far).numbered_edges.filter("node = 0").orderBy("at").collect()]
    assert got == [(0, k, d) for k, d in enumerate(sorted(d for s, d in far if s == 0))]


def test_drawn_walks_come_near_the_truth(spark):
    g, s = graph(spark), sources(spark, 0)
    true = scores(push.power_iteration(g, s, 60))
    got = scores(estimators.push_walk_drawn(g, s, 0.05, 3000))
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[k] == pytest.approx(v, abs=0.03) for k, v in true.items())


def test_hub_walks_stop_at_hubs_and_change_nothing(spark):
    g, s = graph(spark), sources(spark, 0, 1)
    ix = index.hub_index(g, index.hubs(g, 2), 4)
    whole, halted = (sorted(map(tuple, f(g, s, 60, ix).collect())) for f in (index.hub_walks_traced, index.hub_walks))
    assert whole == halted


def test_hub_search_finds_the_best(spark):
    g, s = graph(spark), sources(spark, 0, 1)
    true = scores(push.power_iteration(g, s, 80))
    ix = index.hub_index(g, index.hubs(g, 1), 6)
    found = search.hub_search(g, s, 2, 0.5, ix).collect()
    for x in (0, 1):
        best = sorted((v for (a, _), v in true.items() if a == x), reverse=True)
        mine = sorted((r for r in found if r.source == x), key=lambda r: r["rank"])
        assert len(mine) == 2
        assert all(true[x, r.node] >= 0.5 * best[k] and r.lb - 1e-9 <= true[x, r.node] <= r.ub + 1e-9 for k, r in enumerate(mine))


def test_blocks_of_targets_give_what_one_push_gives(spark):
    g = graph(spark)
    t = g.nodes.select(F.col("node").alias("target"))
    assert {r.node: r.self_ppr for r in push.self_scores(g, t, 1e-4, block=1).collect()} == pytest.approx({r.node: r.self_ppr for r in push.self_scores(g, t, 1e-4).collect()})


def test_pushes_count_the_edges_they_traverse(spark):
    g, seen = graph(spark), {}
    push.forward_push(g, push.unit_state(sources(spark, 0)), 0.3, counts=seen)
    # Per edge: 0 has 0.5; then 1 has 0.4 and 2 (two edges) has 0.2; then 2 has 0.72 / 2; then 0 and 3 have 0.288, and it ends.
    assert seen["edges"] == 2 + 1 + 2
    assert push.edge_visits(g, push.unit_state(sources(spark, 0)), 0.3) == 2


def test_local_expansion_stops_by_size_and_by_error(spark):
    g = graph(spark)
    t = g.nodes.select(F.col("node").alias("target"))
    exact = {(r.node, r.target): r.score for r in push.hitting_iteration(g, t, 60).collect()}
    small = push.hitting_local(g, t, 3, 40, most=2).collect()
    whole = push.hitting_local(g, t, 3, 60, error=1e-6).collect()
    assert len(small) < len(whole)
    for r in [*small, *whole]:
        assert r.lb - 1e-6 <= exact[r.node, r.target] <= r.ub + 1e-6
    assert max(r.ub - r.lb for r in whole) < 1e-4


def test_ratios_of_the_best_need_few_self_scores(spark, monkeypatch):
    g, s, seen = graph(spark), sources(spark, 0), []
    inner = estimators.self_by_walks
    monkeypatch.setattr(estimators, "self_by_walks", lambda g, t, *a, **k: seen.append(t.count()) or inner(g, t, *a, **k))
    all_ = scores(estimators.hitting_raw(g, s, 0.01, 2000.0, 0.05, 500))
    some = scores(estimators.hitting_raw(g, s, 0.01, 2000.0, 0.05, 500, best=1))
    assert seen[1] <= seen[0] and all(all_[k] == pytest.approx(v) for k, v in some.items())
    best = max(all_.values())
    assert {k for k, v in all_.items() if v == best} <= set(some)


def test_kth_scores_and_parameters_that_only_callers_use(spark):
    df = spark.createDataFrame([(0, 5, 0.5), (0, 3, 0.4), (1, 4, 0.1)], "source long, node long, score double")
    assert {r.source: r.kth for r in topk.kth_score(df, 2).collect()} == {0: 0.4, 1: 0.1}
    p = P.replace(P.defaults(100, 1000, 0.5), eps_self=0.25, delta_self=P.ALPHA)
    q = P.bippr_self(p)
    assert q.rmax_self == pytest.approx(0.25 * math.sqrt(1000 * 0.2 / (3 * 100 * p.log_term)))
    assert q.walks_self == pytest.approx(3 * q.rmax_self * p.log_term / (0.2 * 0.0625))
    assert P.multi_scale(8) == 3


def test_windowed_degrees_of_a_stream(spark, tmp_path):
    from wanderlane.streaming import edges as stream

    rows = [("2024-01-01 10:05:00", 0, 1), ("2024-01-01 10:50:00", 0, 2), ("2024-01-01 11:10:00", 0, 1), ("2024-01-01 11:11:00", 3, 3)]
    spark.createDataFrame(rows, "ts string, src long, dst long").select(F.to_timestamp("ts").alias("ts"), "src", "dst").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, src long, dst long").parquet(f"{tmp_path}/in")
    q = stream.windowed_degrees(s).writeStream.outputMode("update").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.start.hour, r.node, r.out_deg) for r in spark.table("windows").collect()) == [(10, 0, 2), (11, 0, 1)]


def crowded(spark):
    """From 0, pages 1, 2, .. that link back and forth with one of their own come before others by ppr, and after them by dht."""
    twins, ends = range(1, 13), range(31, 35)
    pairs = [(0, t) for t in twins for _ in range(5)] + [(0, e) for e in ends for _ in range(6)]
    pairs += [p for t in twins for p in ((t, 50 + t), (50 + t, t))] + [(e, 99) for e in ends] + [(99, 98)]
    return graph(spark, pairs)


def test_hitting_lists_have_nodes_that_many_precede_by_ppr(spark):
    g, s = crowded(spark), sources(spark, 0)
    exact = topk.top_k(estimators.ratio(push.power_iteration(g, s, 60), truth.all_self(g)), 4)
    by_ppr = {r.node for r in topk.top_k(push.power_iteration(g, s, 60), truth.self_candidates(4)).collect()}
    assert not {r.node for r in exact.collect()} <= by_ppr
    got = truth.exact_hitting(g, s, 4, 60)
    assert [(r["rank"], r.node, round(r.score, 9)) for r in got.orderBy("rank").collect()] == [(r["rank"], r.node, round(r.score, 9)) for r in exact.orderBy("rank").collect()]
