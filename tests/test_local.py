"""Pushes inside a worker give what joins give; shared lists give what the spelt-out edges give; large graphs still go by joins."""

import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from wanderlane.operators import graph, local, push, walks
from wanderlane.operators.graph import Graph, adjacency_lists, clean_edges

PAIRS = [(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (2, 3), (3, 1), (4, 0)]


def rows(df):
    return sorted((tuple(round(v, 12) if isinstance(v, float) else v for v in r)) for r in df.collect())


def test_pushes_in_a_worker_are_those_by_joins(spark, monkeypatch):
    g = Graph(clean_edges(spark.createDataFrame(PAIRS, "src long, dst long")))
    t = spark.createDataFrame([(k,) for k in (0, 2, 9)], "target long")
    s = t.withColumnRenamed("target", "source")
    jobs = [lambda: push.power_iteration(g, s, 20).select("source", "node", "score"), lambda: push.forward_push(g, push.unit_state(s), 0.01).select("source", "node", "reserve", "residual"),
        lambda: push.reverse_push(g, push.unit_state(t, "target"), 0.01).select("target", "node", "reserve", "residual"), lambda: push.hitting_iteration(g, t, 9).select("target", "node", "score")]
    assert local.fits(g)
    mine = [rows(j()) for j in jobs]
    monkeypatch.setattr(local, "MOST", -1)
    assert mine == [rows(j()) for j in jobs]


def test_shared_lists_are_the_same_graph(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plain, holds, members = [(0, 1), (1, 2), (1, 5), (3, 2)], [(2, 2), (5, 2)], [(2, 0), (2, 3), (2, 3)]
    pairs = plain + [(n, d) for n, _ in holds for _, d in members]
    flat = Graph(clean_edges(table(pairs, "src long, dst long")))
    g = Graph(flat.edges, plain=clean_edges(table(plain, "src long, dst long")), holds=table(holds, "node long, list long"), members=table(members, "list long, dst long"))
    assert g.entries == len(plain) + len(members) < flat.entries
    assert rows(g.nodes) == rows(flat.nodes) and rows(adjacency_lists(g)) == rows(adjacency_lists(flat))
    s = table([(0,), (5,)], "source long")
    assert rows(push.power_iteration(g, s, 20)) == rows(push.power_iteration(flat, s, 20))


def test_rounds_with_all_edges_are_those_of_a_frontier(spark, monkeypatch):
    pairs = [(k, (k * j + j) % 90) for k in range(90) for j in (1, 4, 7) if k % 9 and (k * j + j) % 90 != k] + [(k, 5) for k in range(6, 80)]
    g = Graph(clean_edges(spark.createDataFrame(pairs, "src long, dst long")))
    t = spark.createDataFrame([(k,) for k in range(0, 90, 4)], "target long")
    s = t.withColumnRenamed("target", "source")
    jobs = [lambda: push.power_iteration(g, s, 20).select("source", "node", "score"), lambda: push.forward_push(g, push.unit_state(s), 0.0001).select("source", "node", "reserve", "residual"),
        lambda: push.reverse_push(g, push.unit_state(t, "target"), 0.0001).select("target", "node", "reserve", "residual")]
    got = {}
    for dense in (0, 1 << 40):
        monkeypatch.setattr(local, "DENSE", dense)
        got[dense] = [rows(j()) for j in jobs]
    assert got[0] == got[1 << 40]


@pytest.mark.parametrize("restart", ["source", "start", "none"])
def test_walks_in_a_worker_are_those_by_joins(spark, monkeypatch, restart):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plain, holds, members = [(0, 1), (0, 1), (0, 5), (1, 2), (1, 7)], [(2, 2), (5, 2)], [(2, 0), (2, 3), (2, 3)]
    pairs = plain + [(n, d) for n, _ in holds for _, d in members]
    g = Graph(clean_edges(table(pairs, "src long, dst long")), plain=clean_edges(table(plain, "src long, dst long")), holds=table(holds, "node long, list long"), members=table(members, "list long, dst long"))
    starts = table([(o, s, w) for o, s in ((0, 0), (0, 7), (9, 2), (9, 9), (-4, 11), (8, 8)) for w in range(1, 9)], "origin long, start long, walk_no long")
    job = lambda: walks.walks(g, starts, steps=6, restart=restart, trace=restart != "start")
    mine = job().columns, rows(job())
    monkeypatch.setattr(local, "walk", None)
    monkeypatch.setattr(local, "MOST", -1)
    assert mine == (job().columns, rows(job()))


@pytest.mark.parametrize("about", [0, 120])  # packed when walkers come, or at once
def test_few_walkers_on_a_large_graph_read_their_lists_only(spark, monkeypatch, about):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plain = [(k, (7 * k + j) % 60) for k in range(60) if k % 10 not in (2, 5, 9) for j in (1, 3, 8)]
    holds, members = [(k, 2 if k % 10 == 2 else 5) for k in range(60) if k % 10 in (2, 5)], [(2, 1), (2, 13), (2, 13), (2, 44), (5, 3), (5, 57)]
    pairs = plain + [(n, d) for n, a in holds for b, d in members if a == b]
    made = lambda **more: Graph(clean_edges(table(pairs, "src long, dst long")), plain=clean_edges(table(plain + plain[::2], "src long, dst long")), holds=table(holds, "node long, list long"), members=table(members, "list long, dst long"), once=True, **more)
    starts = table([(o, s, w) for o, s in ((0, 0), (2, 9), (77, 77), (5, 5)) for w in range(1, 9)], "origin long, start long, walk_no long")
    jobs = [lambda g: walks.walks(g, starts, steps=4, trace=True), lambda g: g.nodes, lambda g: g.greatest(58), lambda g: g.lists]
    monkeypatch.setattr(local, "MOST", -1)
    true = [rows(j(made())) for j in jobs]
    monkeypatch.setattr(walks, "MANY_EDGES", 0)
    monkeypatch.setattr(graph, "FOLDER", 24)
    monkeypatch.setattr(local, "PART", 4)  # lists of several rows
    monkeypatch.setattr(local, "OUT_ROWS", 3)
    g = made(about=about)
    assert [rows(j(g)) for j in jobs] == true
    for part in (4, 22):
        monkeypatch.setattr(local, "PART", part)
        g = made(about=about)
        for list_, ats in ((8, [0, 2]), (2, [1, 2, 3])):  # all other folders may be gone
            want = table([(list_, at) for at in ats], "list long, at long")
            numbered = rows(g.numbered_edges.join(want.withColumnRenamed("list", "node"), ["node", "at"]))
            assert rows(g.numbered_among(want).select("node", "at", "dst", "dst_deg", "dst_list")) == numbered and len(numbered) == len(ats)
        packed = g._made["packed"]
        assert packed.parted == (part == 4) and packed.folders > 1
        at = table([(8,)], "list long").select(packed.folder).first()[0]
        for folder in Path(packed.rows.cut_path.removeprefix("file://")).glob("folder=*"):
            if folder.name != f"folder={at}":
                shutil.rmtree(folder)
        assert len(rows(g.numbered_among(table([(8, 0), (8, 2)], "list long, at long")))) == 2


def test_few_keys_on_shared_lists_run_rounds_with_all_edges(spark, monkeypatch):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plain = [(k, (7 * k + j) % 60) for k in range(60) if k % 10 not in (2, 5) for j in (1, 3, 8)]
    holds, members = [(k, 2 if k % 10 == 2 else 5) for k in range(60) if k % 10 in (2, 5)], [(2, 1), (2, 13), (2, 13), (2, 44), (5, 3), (5, 57)]
    pairs = plain + [(n, d) for n, a in holds for b, d in members if a == b]
    g = Graph(clean_edges(table(pairs, "src long, dst long")), plain=clean_edges(table(plain, "src long, dst long")), holds=table(holds, "node long, list long"), members=table(members, "list long, dst long"))
    s = table([(2,), (5,), (31,), (99,)], "source long")
    jobs = [lambda: push.power_iteration(g, s, 30), lambda: push.forward_push(g, push.unit_state(s), 0.0001).select("source", "node", "reserve", "residual")]
    ran = []
    dense = local.Batch.dense
    monkeypatch.setattr(local.Batch, "dense", lambda *a: (ran.append(1), dense(*a))[1])
    edges, keys = np.array(plain + members).T, [2, 5, 31]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * edges.shape[1] + [2] * len(holds) + [1] * 3, pa.int32()), pa.array([*edges[0], *[n for n, _ in holds], *keys]), pa.array([*edges[1], *[a for _, a in holds], *keys]), pa.array([0.0] * (edges.shape[1] + len(holds) + 3)), pa.array([0.0] * (edges.shape[1] + len(holds)) + [1.0] * 3)], ["kind", "a", "b", "x", "y"])
    list(local._work("power", 0.0, 0.2, 30, None, False)(iter([batch])))
    assert ran
    monkeypatch.undo()
    mine = [rows(j()) for j in jobs]
    monkeypatch.setattr(local, "MOST", -1)
    assert mine == [rows(j()) for j in jobs]


def test_ids_far_apart_are_numbered_as_ids_close_together():
    far = np.array([5, -(1 << 40), 1 << 50, 5]), np.array([1 << 50, 5, -(1 << 40), 1 << 50])
    close = np.array([1, 0, 2, 1]), np.array([2, 1, 0, 2])
    none = np.empty((2, 0), np.int64)
    a, b = (local.Csr(np.stack(e), none, np.empty(0, np.int64), None) for e in (far, close))
    assert a.place is None and b.place is not None
    for name in ("owner", "dst", "first", "deg", "list_of"):
        assert getattr(a, name).tolist() == getattr(b, name).tolist()
    some = np.random.default_rng(1).integers(0, 1 << 18, 5000)
    assert (local.stable_order(some, 1 << 18) == np.argsort(some, kind="stable")).all()


def test_pushes_for_own_scores_are_held_to_what_can_come_back(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(int(a) + 40 * c, int(b) + 40 * c) for c in range(3) for a, b in rng.integers(0, 40, (90, 2)) if a != b} | {(3, 44), (44, 85), (7, 200), (201, 7)}
    g = local.Csr(np.array(sorted(pairs)).T, np.empty((2, 0), np.int64), np.array([300]), None)
    reach = np.eye(g.n, dtype=int)
    reach[g.owner, g.dst] = 1
    for _ in range(8):
        reach = (reach @ reach > 0).astype(int)
    part = local.strong(g.first, g.dst)
    assert ((part[:, None] == part) == (reach & reach.T > 0)).all()
    g.turn()
    many, sizes, batch = np.arange(g.n), [], local.Batch
    whole = batch(g, g.n)
    own = many * g.n + many
    whole.run(own, own, np.zeros(g.n), np.ones(g.n), "reverse", 1e-6, 0.2, 1000)
    monkeypatch.setattr(local, "SMALL", 1)
    monkeypatch.setattr(local, "Batch", lambda part, many: sizes.append(part.n) or batch(part, many))
    kept, left, late = local._own(g, g.ids, np.zeros(g.n), np.ones(g.n), 1e-6, 0.2, 1000)
    assert np.allclose(kept, whole.kept[own], atol=1e-14) and np.allclose(left, whole.left[own], atol=1e-14) and not late
    assert len(sizes) >= 3 and max(sizes) <= 40


@pytest.mark.parametrize("whole", [1 << 27, 4])
def test_power_iterations_on_packed_lists_spell_no_edge_out(spark, monkeypatch, whole):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    plain, holds, members = [(0, 1), (1, 2), (1, 2), (1, 5), (3, 2)], [(2, 2), (5, 2)], [(2, 0), (2, 3), (2, 3), (2, 8)]
    pairs = sorted(set(plain)) + [(n, d) for n, _ in holds for _, d in members]
    flat = Graph(clean_edges(table(pairs, "src long, dst long")))
    s = table([(0,), (5,), (9,)], "source long")
    expected = rows(push.power_iteration(flat, s, 20))
    g = Graph(flat.edges, plain=clean_edges(table(plain, "src long, dst long")), holds=table(holds, "node long, list long"), members=table(members, "list long, dst long"), once=True, about=len(plain))
    monkeypatch.setattr(local, "MOST", -1)
    monkeypatch.setattr(local, "WHOLE", whole)
    assert rows(push.power_iteration(g, s, 20)) == expected
    assert ("out_edges" in g._made) == (whole == 4)


@pytest.mark.parametrize("loop", [False, True])
def test_rounds_put_together_from_shared_lists_are_the_rounds(monkeypatch, loop):
    rng, lists = np.random.default_rng(3), {}
    lists |= {3 * c: sorted({3 * int(p) + 1 for p in rng.integers(0, 40, 4)}) for c in range(55)}
    lists |= {3 * p + 1: sorted({3 * int(x) + 2 for x in rng.integers(0, 12, 3)}) for p in range(40)}
    if loop:  # steps between shared lists have no end
        lists[1], lists[4] = sorted({*lists[1], 4}), sorted({*lists[4], 1})
    lists |= {3 * k + 2: [3 * c for c in range(60) if c % 3 == k] for k in range(3)}
    table = [(local.EDGE, k, 0, v) for k, v in lists.items()] + [(local.HOLDER, 3 * s + 2, 3 * (s % 3) + 2, None) for s in range(12)] + [(local.STATE, k, 0, None) for k in (2, 5, 1, 177, 900)]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table), types)], ["kind", "a", "b", "dsts"])
    monkeypatch.setattr(local, "CHUNK", 50)
    got = []
    for lags in (local.LAGS, 0):
        monkeypatch.setattr(local, "LAGS", lags)
        out = pa.Table.from_batches(list(local._power_work(sum(map(len, lists.values())), 100, 0.2)(iter([batch])))).to_pylist()
        got.append({(r["key"], r["node"]): r["score"] for r in out})
    assert got[0] == pytest.approx(got[1], abs=1e-15) and sum(got[0].values()) == pytest.approx(5, abs=1e-8)
