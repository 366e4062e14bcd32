"""The registered top-k searches run without a floor for delta; their lists are held against exact ones."""

from pathlib import Path

import pytest

from wanderlane.operators import estimators, push, search, truth
from wanderlane.plans import queries

DATA = "/root/testdata/sf0.01"


def spied(monkeypatch, owner, name, note):
    f, seen = getattr(owner, name), []

    def run(*args, **options):
        seen.append(note(*args, **options))
        return f(*args, **options)

    monkeypatch.setattr(owner, name, run)
    return seen


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_registered_ppr_search_finds_the_best(spark, monkeypatch):
    asked = spied(monkeypatch, search, "ppr_search", lambda *a, **o: o)
    g = queries.event(spark, DATA)
    true = {(r.source, r.node): r.score for r in push.power_iteration(g, queries.top_sources(g), 100).collect()}
    found = queries.ppr_topk_loop(spark, DATA).collect()
    assert asked == [{}]
    for s in {r.source for r in found}:
        mine, best = [r for r in found if r.source == s], sorted((v for (x, _), v in true.items() if x == s), reverse=True)
        assert len(mine) == 5
        for r in mine:
            assert abs(r.score - true[s, r.node]) <= 0.5 * true[s, r.node]
            assert true[s, r.node] >= best[r["rank"] - 1] * (1 - 0.5)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_registered_hitting_search_finds_the_best(spark, monkeypatch):
    asked = spied(monkeypatch, search, "hitting_search", lambda *a, **o: o)
    g = queries.event(spark, DATA)
    s = queries.top_sources(g)
    own = push.self_scores(g, queries.targets_of(g), truth.EXACT)
    true = {(r.source, r.node): r.score for r in estimators.ratio(push.power_iteration(g, s, 100), own).collect()}
    found = queries.dht_topk_loop(spark, DATA).collect()
    assert asked == [{}]
    for x in {r.source for r in found}:
        mine, best = [r for r in found if r.source == x], sorted((v for (y, _), v in true.items() if y == x), reverse=True)
        assert len(mine) == 5
        for r in mine:
            assert true[x, r.node] >= best[r["rank"] - 1] * (1 - 0.5)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_exact_scores_are_computed_once_for_the_evaluation_of_hitting_lists(spark, monkeypatch):
    small = str(Path(DATA).with_name("sf0.001"))
    asked = spied(monkeypatch, push, "power_iteration", lambda *a, **o: 1)
    monkeypatch.setattr(truth, "power_iteration", push.power_iteration)
    assert queries.eval_ndcg_dht(spark, small).count() > 0
    assert asked == [1]
