"""Pushes and walks of a batch of sources or targets over a graph that fits a worker.

Each task gets the edges once, as arrays, and a share of the keys; it runs the same synchronous rounds as push._run, some
keys at a time (as many as have PLACES nodes together), so that a round costs the edges of its frontier and no shuffle. A
task of walks gets a share of the walkers, after the edges, and moves a batch of them at a time. Edges travel through a
shuffle, not through the driver. MOST bounds the edges (16 bytes each while they are read); larger graphs go by joins.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import below
from ..plans.iterate import cut

# The functions of this module travel to the executors by value: they need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 1 << 23  # edges, or entries of shared lists, that a task holds
WHOLE = 1 << 27  # entries of packed lists that a task of power iterations holds, 4 bytes each; ids are below it too
CHUNK = 1 << 23  # entries that send together there
LAGS = 6  # steps from one shared list to the next, at most, where rounds are put together from those of the lists
TASKS, KEYS_A_TASK = 128, 256
SPARSE = 4  # a table of numbers has so many places for each end of an edge at most
WIDE = 1 << 21  # so many edges are held by numbers of 8 bytes, which index faster
SHIPPED = 1 << 22  # rows of edges that go to all tasks together, about, where one task for each core would do
PLACES = 1 << 22  # nodes times keys whose state a task holds at once
SMALL = 1 << 10  # nodes of small strongly connected parts that are held together
COLUMNS, FEW_ROWS = 64, 64  # keys of a block of dense rounds; so few receivers are added up one by one
DENSE = 16  # one edge of a frontier costs as much as so many in a round with all edges
OUT_ROWS = 1 << 16
PART = 22  # a packed row has entries of 2^22 ids at most
EDGE, STATE, HOLDER, WALKER = 0, 1, 2, 3  # EDGE: a list, where lists are packed


def stable_order(numbers: np.ndarray, n: int) -> np.ndarray:
    """np.argsort(numbers, kind="stable") of numbers below n, by 16 bits at a time, which numpy sorts by counting."""
    order = np.argsort(numbers.astype(np.uint16), kind="stable")
    for shift in range(16, max(n - 1, 0).bit_length(), 16):
        order = order[np.argsort((numbers >> shift).astype(np.uint16)[order], kind="stable")]
    return order


class Csr:
    """Out- and in-edges by node number. A node's out-edges are the list it has; lists may be shared."""

    def __init__(self, edges: np.ndarray, holders: np.ndarray, extra: np.ndarray, count: int | None):
        ends = [edges.ravel(), holders.ravel(), extra]
        self.base, self.place, some = 0, None, [a for a in ends if len(a)]
        lo, hi = min((int(a.min()) for a in some), default=0), max((int(a.max()) for a in some), default=-1)
        if some and hi - lo < SPARSE * sum(map(len, some)):  # ids lie close: a table tells their numbers
            has = np.zeros(hi - lo + 1, bool)
            for a in some:
                has[a - lo] = True
            self.ids = np.flatnonzero(has) + lo
            self.base, self.place = lo, np.cumsum(has, dtype=np.int64) - 1
        else:
            self.ids = np.unique(np.concatenate(ends))
        n = self.n = len(self.ids)
        small = np.int64 if edges.shape[1] <= WIDE else np.int32
        owner, self.dst = self.at(edges[0]).astype(small), self.at(edges[1]).astype(small)
        order = stable_order(owner, n)
        self.owner, self.dst = owner[order], self.dst[order]
        sizes = np.bincount(self.owner, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.list_of = np.arange(n)
        self.list_of[self.at(holders[0])] = self.at(holders[1])
        self.shared = bool(holders.size)
        self.deg = sizes[self.list_of]
        known = self.deg > 0
        known[self.dst] = True
        if count is not None:
            known |= (self.ids >= 0) & (self.ids < count)
        self.known, self.width = known, np.maximum(self.deg, 1).astype(float)

    def at(self, ids: np.ndarray) -> np.ndarray:
        """The numbers of ids that the graph has; of others, some number."""
        return np.searchsorted(self.ids, ids) if self.place is None else self.place[np.clip(ids - self.base, 0, len(self.place) - 1)]

    def among(self, ids: np.ndarray) -> Csr:
        """The graph with these ids too; those that it does not have are dangling nodes."""
        ids = np.unique(ids)
        new = np.setdiff1d(ids, self.ids, assume_unique=True)
        return self if not len(new) else With(self, new)

    def turn(self) -> None:
        """From out-edges to in-edges: first and dst lead from a node to the sources of its in-edges."""
        order = stable_order(self.dst, self.n)
        self.owner, self.dst = self.dst[order], self.owner[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=self.n))])
        self.weight = 1 / self.width[self.dst]


def strong(first: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """A number for each node, the same for nodes that reach each other: Tarjan's algorithm, its stack spelt out."""
    n, first, dst = len(first) - 1, memoryview(first), memoryview(np.ascontiguousarray(dst))
    turn, low, part, next_ = [0] * n, [0] * n, [-1] * n, first.tolist()
    turns = parts = 0
    open_ = []
    for root in range(n):
        if turn[root]:
            continue
        turns += 1
        turn[root] = low[root] = turns
        open_.append(root)
        path = [root]
        while path:
            v = path[-1]
            if (e := next_[v]) < first[v + 1]:
                next_[v] = e + 1
                w = dst[e]
                if not turn[w]:
                    turns += 1
                    turn[w] = low[w] = turns
                    open_.append(w)
                    path.append(w)
                elif part[w] < 0 and turn[w] < low[v]:
                    low[v] = turn[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == turn[v]:
                w = -1
                while w != v:
                    w = open_.pop()
                    part[w] = parts
                parts += 1
    return np.array(part, np.int64)


class Within:
    """Some nodes of a graph and the edges among them; degrees are those of the graph. number: room for a table of its nodes."""

    def __init__(self, g: Csr, nodes: np.ndarray, edges: np.ndarray, number: np.ndarray):
        n = self.n = len(nodes)
        number[nodes] = np.arange(n)
        owner = number[g.owner[edges]]
        order = stable_order(owner, n)
        self.owner, self.dst = owner[order], number[g.dst[edges]][order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        self.deg, self.width, self.weight, self.list_of, self.shared = g.deg[nodes], g.width[nodes], g.weight[edges][order], np.arange(n), False


class With:
    """A graph and dangling nodes that it does not have, numbered after its own."""

    def __init__(self, g: Csr, new: np.ndarray):
        self.g, self.new, self.first, self.dst = g, new, g.first, g.dst
        self.ids = np.concatenate([g.ids, new])
        self.deg, self.list_of = (np.concatenate([a, np.zeros(len(new), a.dtype)]) for a in (g.deg, g.list_of))

    def at(self, ids: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.new, ids)
        is_new = self.new[np.minimum(place, len(self.new) - 1)] == ids
        return np.where(is_new, self.g.n + place, self.g.at(ids))


class Inflow:
    """What arrives at all nodes at once, for some keys side by side: a row a node, in the order of falling numbers of edges
    that lead there, so that the j-th edges of all that have one are a slice."""

    def __init__(self, g: Csr):
        n = g.n
        many = np.bincount(g.dst, minlength=n)
        self.order = np.argsort(-many, kind="stable")
        rank = np.empty(n, np.int64)
        rank[self.order] = np.arange(n)
        self.rank, many = rank, many[self.order]
        source = rank[g.owner[stable_order(rank[g.dst], n)]]
        first = np.cumsum(many) - many
        self.slots, self.rest = [], []
        while (c := np.searchsorted(-many, -len(self.slots))) >= FEW_ROWS:
            self.slots.append(source[first[:c] + len(self.slots)])
        for k in range(c):
            self.rest.append(source[first[k] + len(self.slots) : first[k] + many[k]])

    def into(self, sent: np.ndarray, got: np.ndarray, room: np.ndarray) -> None:
        got[:] = 0
        for source in self.slots:
            c = len(source)
            np.take(sent, source, axis=0, out=room[:c], mode="clip")
            got[:c] += room[:c]
        for k, source in enumerate(self.rest):
            got[k] += sent[source].sum(axis=0)


class Batch:
    """The state of some keys: the place of a key's node is the key's number times n, plus the node's."""

    def __init__(self, g: Csr, many: int):
        self.g, self.inflow, size = g, None, many * g.n
        self.kept, self.left, self.full = np.zeros(size), np.zeros(size), np.zeros(size)
        self.seen, self.last = np.zeros(size, bool), np.zeros(size, np.int64)

    def once(self, at: np.ndarray) -> np.ndarray:
        """Each place that at has, once."""
        turn = np.arange(len(at))
        self.last[at] = turn
        return at[self.last[at] == turn]

    def clear(self, at: np.ndarray) -> None:
        self.kept[at] = self.left[at] = 0
        self.seen[at] = False

    def send(self, at: np.ndarray, value: np.ndarray, reverse: bool) -> np.ndarray:
        """Sends values along all edges of nodes; the places where something arrives, some more than once."""
        g, n = self.g, self.g.n
        node = at % n
        if g.shared:
            at, where = np.unique(at - node + g.list_of[node], return_inverse=True)
            node, value = at % n, np.bincount(where, value)
        many = g.first[node + 1] - g.first[node]
        key = at // n
        dense = np.flatnonzero(4 * np.bincount(key, many) > len(g.dst)) if g.shared else []
        parts = []
        if len(dense):
            self.full[at] = value
            for k in dense:
                lo, hi = k * n, (k + 1) * n
                got = np.bincount(g.dst, self.full[lo:hi][g.owner], n)
                self.left[lo:hi] += got
                parts.append(np.flatnonzero(got) + lo)
            self.full[at] = 0
            rest = np.isin(key, dense, invert=True)
            at, node, value, many = at[rest], node[rest], value[rest], many[rest]
        if len(at):
            edge = np.repeat(g.first[node] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            to, sent = np.repeat(at - node, many) + g.dst[edge], np.repeat(value, many)
            np.add.at(self.left, to, sent * g.weight[edge] if reverse else sent)
            parts.append(to)
        return np.concatenate(parts) if parts else at

    def run(self, own: np.ndarray, at: np.ndarray, reserve: np.ndarray, residual: np.ndarray, how: str, rmax: float, alpha: float, rounds: int) -> np.ndarray:
        """Runs the rounds; own: the place of each key's own node. Places that are above the threshold still."""
        g, n, left = self.g, self.g.n, self.left
        np.add.at(self.kept, at, reserve)
        np.add.at(left, at, residual)

        def active(at: np.ndarray) -> np.ndarray:
            r = left[at]
            return self.once(at[r > 0 if how == "power" else r / g.width[at % n] >= rmax if how == "per_edge" else r >= rmax])

        self.seen[at] = True
        now = active(at)
        for done in range(rounds):
            if not len(now):
                break
            node = now % n
            lists = np.unique(now - node + g.list_of[node]) % n if g.shared else node
            if DENSE * int((g.first[lists + 1] - g.first[lists]).sum()) > len(own) * (len(g.dst) + 2 * n):
                return self.dense(own, how, rmax, alpha, rounds - done)
            value = left[now]
            self.kept[now] += alpha * value
            left[now] = 0
            value = (1 - alpha) * value
            if how == "reverse":
                next_ = self.send(now, value, True)
            else:
                some = g.deg[node] > 0
                next_ = self.send(now[some], value[some] / g.width[node[some]], False)
                if not some.all():
                    back = own[now[~some] // n]
                    np.add.at(left, back, value[~some])
                    next_ = np.concatenate([next_, back])
            self.seen[next_] = True
            now = active(next_)
        return now


    def dense(self, own: np.ndarray, how: str, rmax: float, alpha: float, rounds: int) -> np.ndarray:
        """The rest of the rounds, with all edges in each. The same places as of run."""
        g, n = self.g, self.g.n
        if self.inflow is None:
            self.inflow = Inflow(g)
        order, over = self.inflow.order, []
        width = g.width[order][:, None]
        dangling = np.flatnonzero(g.deg[order] == 0)
        holds = np.flatnonzero(g.list_of != np.arange(n)) if g.shared else []
        holder, shared = self.inflow.rank[holds], self.inflow.rank[g.list_of[holds]]
        for lo in range(0, len(own), COLUMNS):
            home = own[lo : lo + COLUMNS]
            c = len(home)
            rows = slice(lo * n, (lo + c) * n)
            kept, left = (np.ascontiguousarray(a[rows].reshape(c, n).T[order]) for a in (self.kept, self.left))
            sent, got, room, mine = np.empty_like(left), np.empty_like(left), np.empty_like(left), self.inflow.rank[home % n]
            for done in range(rounds + 1):
                on = left > 0 if how == "power" else left / width >= rmax if how == "per_edge" else left >= rmax
                if done == rounds or not on.any():
                    break
                np.multiply(left, on, out=sent)
                left -= sent
                kept += np.multiply(sent, alpha, out=room)
                sent *= 1 - alpha
                if how != "reverse":
                    back = sent[dangling].sum(axis=0)
                    sent /= width
                if g.shared:  # what holders send leaves from their list
                    lent = sent[holder]
                    sent[holder] = 0
                    np.add.at(sent, shared, lent)
                self.inflow.into(sent, got, room)
                if how == "reverse":
                    got /= width
                left += got
                if how != "reverse":
                    left[mine, np.arange(c)] += back
            for mine_, theirs in ((self.kept, kept), (self.left, left)):
                out = np.empty((n, c))
                out[order] = theirs
                mine_[rows] = out.T.ravel()
            self.seen[rows] |= (self.kept[rows] != 0) | (self.left[rows] != 0)
            at = np.empty((n, c), bool)
            at[order] = on
            over.append(np.flatnonzero(at.T.ravel()) + lo * n)
        return np.concatenate(over)


def _own(g: Csr, key: np.ndarray, reserve: np.ndarray, residual: np.ndarray, rmax: float, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """What reverse pushes from keys leave on the keys' own nodes, and whether one had not ended. What comes back to a node goes
    along edges among nodes that reach each other, so a push is held to these; the numbers are those of a push over all."""
    part, node = strong(g.first, g.dst), g.at(key)
    kept, left, late = reserve.copy(), residual.copy(), False
    size = np.bincount(part)
    nodes, inside = np.argsort(part, kind="stable"), np.flatnonzero(part[g.owner] == part[g.dst])
    inside = inside[np.argsort(part[g.owner[inside]], kind="stable")]
    first_node, first_edge = (np.concatenate([[0], np.cumsum(c)]) for c in (size, np.bincount(part[g.owner[inside]], minlength=len(size))))
    alone = size[part[node]] == 1
    once = alone & (left >= rmax)
    kept[once] += alpha * left[once]
    left[once] = 0
    rows = np.flatnonzero(~alone)
    rows = rows[np.argsort(part[node[rows]], kind="stable")]
    wanted = np.unique(part[node[rows]])
    group = np.cumsum(size[wanted]) // SMALL
    number = np.empty(g.n, np.int64)
    for parts in np.split(wanted, np.flatnonzero(np.diff(group)) + 1) if len(wanted) else []:
        some = Within(g, *(np.concatenate([a[f[p] : f[p + 1]] for p in parts]) for a, f in ((nodes, first_node), (inside, first_edge))), number)
        lo, hi = np.searchsorted(part[node[rows]], [parts[0], parts[-1] + 1])
        together = max(1, min(hi - lo, PLACES // some.n))
        state = Batch(some, together)
        for at in range(lo, hi, together):
            these = rows[at : min(at + together, hi)]
            own = number[node[these]] + np.arange(len(these)) * some.n
            late |= bool(len(state.run(own, own, reserve[these], residual[these], "reverse", rmax, alpha, rounds)))
            kept[these], left[these] = state.kept[own], state.left[own]
            state.clear(np.flatnonzero(state.seen))
    return kept, left, late


def _hitting(g: Csr, key: int, alpha: float, rounds: int) -> np.ndarray:
    h, w = np.zeros(g.n), (1 - alpha) * g.weight
    h[key] = 1
    for _ in range(rounds):
        h = np.bincount(g.dst, h[g.owner] * w, g.n)
        h[key] = 1
    return h


def _work(how: str, rmax: float, alpha: float, rounds: int, count: int | None, own: bool):
    reverse = how in ("reverse", "hitting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {EDGE: [np.empty((2, 0), np.int64)], HOLDER: [np.empty((2, 0), np.int64)]}
        states = [np.empty((4, 0))]
        keys = [np.empty((2, 0), np.int64)]
        for batch in batches:
            kind, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b"))
            for k, held in parts.items():
                rows = kind == k
                if rows.any():
                    held.append(np.stack([a[rows], b[rows]]))
            rows = kind == STATE
            if rows.any():
                keys.append(np.stack([a[rows], b[rows]]))
                states.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("x", "y")]))
        states[0] = np.empty((2, 0))
        key, value = np.concatenate(keys, 1), np.concatenate(states, 1)
        if not key.shape[1]:
            return
        g = Csr(np.concatenate(parts.pop(EDGE), 1), np.concatenate(parts.pop(HOLDER), 1), key.ravel(), count)
        if reverse:
            g.turn()
        order = np.argsort(key[0], kind="stable")
        key, value = key[:, order], value[:, order]
        starts = np.append(np.flatnonzero(np.diff(key[0], prepend=key[0][0] - 1)), key.shape[1])
        held, size = [], 0

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["key", "node", "reserve", "residual"])

        many = len(starts) - 1
        if own and reverse and len(key[0]) == many and (key[0] == key[1]).all():  # each starts at its own node
            kept, left, late = _own(g, key[0], *value, rmax, alpha, rounds)
            if late:
                yield batch_of([([0], [0], [0.0], [0.0])]).set_column(0, "key", pa.array([None], pa.int64()))
            for lo in range(0, many, OUT_ROWS):
                yield batch_of([(key[0][lo : lo + OUT_ROWS], key[0][lo : lo + OUT_ROWS], kept[lo : lo + OUT_ROWS], left[lo : lo + OUT_ROWS])])
            return
        together = 1 if how == "hitting" else max(1, min(many, PLACES // g.n))
        state = None if how == "hitting" else Batch(g, together)
        for first in range(0, many, together):
            bounds = starts[first : first + together + 1]
            lo, hi = bounds[0], bounds[-1]
            ids = key[0][bounds[:-1]]
            own_node = g.at(ids)
            if how == "hitting":
                kept = _hitting(g, int(own_node[0]), alpha, rounds)
                at, late = np.flatnonzero(kept), False
                kept, left = kept[at], np.zeros(len(at))
            else:
                base = np.arange(len(ids)) * g.n
                nodes = g.at(key[1][lo:hi])
                here = g.known[nodes] | reverse  # a push from a node that the graph does not have is closed by the caller
                places = (nodes + np.repeat(base, np.diff(bounds)))[here]
                late = bool(len(state.run(base + own_node, places, value[0][lo:hi][here], value[1][lo:hi][here], how, rmax, alpha, rounds)))
                seen = np.flatnonzero(state.seen)
                at = seen[seen % g.n == own_node[seen // g.n]] if own else seen
                kept, left = state.kept[at], state.left[at]
                state.clear(seen)
            held.append((ids[at // g.n], g.ids[at % g.n], kept, left))
            size += len(at)
            if late:  # a row that tells so
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([0.0]), pa.array([0.0])], ["key", "node", "reserve", "residual"])
            if size >= OUT_ROWS:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return run


def packing(once: bool):
    """Rows (list, dst) in order -> (list, part, n, dsts), a row for each list and part of ids. once: rows that repeat count once."""
    names = ["list", "part", "n", "dsts"]

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        list_, dst = rows
        if once:
            new = np.append(True, (list_[1:] != list_[:-1]) | (dst[1:] != dst[:-1]))
            list_, dst = list_[new], dst[new]
        first = np.append(0, ends(list_, dst))
        offsets = np.append(first, len(dst))
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dst))
        return pa.RecordBatch.from_arrays([pa.array(list_[first]), pa.array(dst[first] >> PART), pa.array(np.diff(offsets)), column], names)

    def ends(list_: np.ndarray, dst: np.ndarray) -> np.ndarray:
        part = dst >> PART
        return np.flatnonzero((list_[1:] != list_[:-1]) | (part[1:] != part[:-1])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False)for c in ("list", "dst")])
            row = (rows[0, 0], rows[1, 0] >> PART)
            at = ends(rows[0], rows[1])
            # What is held ends with an open row, which this batch may go on with.
            if size >= OUT_ROWS and (row != last or len(at)):
                go_on = 0 if row != last else int(at[0])
                yield packed(np.concatenate([*held, rows[:, :go_on]], 1))
                held, size, rows = [], 0, rows[:, go_on:]
            held.append(rows)
            size += rows.shape[1]
            last = (rows[0, -1], rows[1, -1] >> PART)
        if held:
            yield packed(np.concatenate(held, 1))

    return run


def _labels(graph, tasks: int) -> Column:
    """A number for each task, that Spark's hash deals to it."""
    label = graph._once(f"labels {tasks}", lambda: {int(r.p): int(r.id) for r in graph.spark.range(64 * tasks + 64).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).collect()})
    return F.array(*[F.lit(label[t]).cast("long") for t in range(tasks)])


def _dealt_edges(graph, tasks: int) -> tuple[Column, DataFrame]:
    """The tasks' labels, and the edges, for each task."""
    labels = _labels(graph, tasks)
    none = [F.lit(0.0).alias("x"), F.lit(0.0).alias("y")]
    rows = graph.lists.select(F.lit(EDGE).alias("kind"), F.col("list").alias("a"), F.col("dst").alias("b"), *none)
    if graph.shared:
        rows = rows.unionByName(graph.holders.filter("node <> list").select(F.lit(HOLDER).alias("kind"), F.col("node").alias("a"), F.col("list").alias("b"), *none))
    return labels, rows.select(F.explode(labels).alias("task"), "*")


def fits(graph, reverse: bool = False) -> bool:
    return graph.entries <= MOST and not (reverse and graph.shared)


def push(graph, state: DataFrame, key: str, how: str, rmax: float, alpha: float, rounds: int, whole: bool = True, own: bool = False) -> DataFrame:
    """key, node, reserve, residual after the rounds. how: "per_edge", "absolute", "power" or "reverse", as push's functions
    say, or "hitting". own: only the row of each key's own node. whole: as in push._run."""
    spark = graph.spark
    state = state.select(key, "node", "reserve", "residual")
    n = state.select(key).distinct().count()
    cores = spark.sparkContext.defaultParallelism
    more = min(-(-n // KEYS_A_TASK), -(-SHIPPED // max(1, graph.entries)))
    tasks = max(1, min(TASKS, max(min(n, cores), -(-more // cores) * cores if more > cores else 0)))
    labels, rows = _dealt_edges(graph, tasks)
    dealt = F.element_at(labels, (F.pmod(F.xxhash64(key), F.lit(tasks)) + 1).cast("int"))
    rows = rows.unionByName(state.select(dealt.alias("task"), F.lit(STATE).alias("kind"), F.col(key).cast("long").alias("a"), F.col("node").cast("long").alias("b"), F.col("reserve").alias("x"), F.col("residual").alias("y")))
    count = graph.count
    out = cut(rows.repartition(tasks, "task").select("kind", "a", "b", "x", "y").mapInArrow(_work(how, rmax, alpha, rounds, count, own), "key long, node long, reserve double, residual double"))
    if whole and not out.filter("key is null").isEmpty():
        raise RuntimeError(f"nodes are above the threshold after {rounds} rounds")
    return out.filter("key is not null").select(F.col("key").alias(key), "node", "reserve", "residual")


def _power_work(total: int, rounds: int, alpha: float):
    """Rows (kind, a, b, dsts) of packed lists, holders and sources -> key, node, score. total: the entries of all lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dst, end = np.empty(total, np.int32), 0
        lists, many, held, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((2, 0), np.int64)], []
        for batch in batches:
            kind, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b"))
            keys += a[kind == STATE].tolist()
            held.append(np.stack([a, b])[:, kind == HOLDER])
            some = batch.column("dsts").filter(pa.array(kind == EDGE))
            here = some.flatten().to_numpy(zero_copy_only=False)
            dst[end : end + len(here)] = here
            end += len(here)
            lists.append(a[kind == EDGE])
            many.append(some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        if not keys:
            return
        list_, many, (holder, shared), dst = np.concatenate(lists), np.concatenate(many), np.concatenate(held, 1), dst[:end]
        n = 1 + max([int(a.max()) for a in (dst, list_, holder) if len(a)], default=-1)
        deg = np.zeros(n)
        np.add.at(deg, list_, many)
        deg[holder] = deg[shared]
        dangling, width, first = deg == 0, np.maximum(deg, 1), np.concatenate([[0], np.cumsum(many)])
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, end, CHUNK)), len(many)))
        del deg

        def send(sent: np.ndarray) -> np.ndarray:
            got, value = np.zeros(n), sent[list_]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                on, m, to = value[lo:hi] > 0, many[lo:hi], dst[first[lo] : first[hi]]
                if not on.all():
                    to = to[np.repeat(on, m)]
                if len(to):
                    got += np.bincount(to, np.repeat(value[lo:hi][on], m[on]), n)
            return got

        own_lists, of = np.unique(shared, return_inverse=True)

        def step(at: np.ndarray) -> np.ndarray:
            sent = (1 - alpha) * at / width
            lent = sent[holder]
            sent[holder] = 0
            np.add.at(sent, shared, lent)
            return send(sent)

        def stop(at: np.ndarray) -> np.ndarray:
            at[holder] = 0
            at[dangling] = 0
            return at

        def reached(start: int) -> np.ndarray | None:
            """By steps, what arrives at nodes of each list, and at dangling ones, from 1 at start, where that is the end."""
            at, out = np.zeros(n), []
            at[start] = 1
            while len(out) < LAGS:
                at = step(at)
                out.append(np.append(np.bincount(of, at[holder], len(own_lists)), at[dangling].sum()))
                if not stop(at).any():
                    return np.array(out + [np.zeros(len(own_lists) + 1)] * (LAGS - len(out)))
            return None

        starts = [*own_lists.tolist(), *sorted({k for k in keys if 0 <= k < n and not dangling[k]} - set(holder.tolist()))] if len(own_lists) else []
        moves = []
        for start in starts:
            moves.append(reached(start))
            if moves[-1] is None:
                starts = []
                break
        place = dict(zip(starts, range(len(starts)))) | (dict(zip(holder.tolist(), of.tolist())) if starts else {})
        moves = np.array(moves) if starts else None  # from, steps, to

        def together(key: int) -> np.ndarray:
            """The sum of all rounds, from the masses that each round has at nodes of shared lists and at the key."""
            mass, back, lost = np.zeros((rounds, len(starts))), np.zeros(rounds), np.zeros(rounds)
            for t in range(rounds):
                for j in range(1, min(t, LAGS) + 1):
                    came = mass[t - j] @ moves[:, j - 1]
                    mass[t, : len(own_lists)] += came[:-1]
                    lost[t] += came[-1]
                back[t] = (1 - alpha) * lost[t - 1] if t else 1
                mass[t, place[key]] += back[t]
            kept = np.zeros(n)
            for j in range(1, min(rounds - 1, LAGS) + 1):  # what is j steps from there
                at = np.zeros(n)
                at[starts] = mass[: rounds - j].sum(axis=0)
                for i in range(j):
                    at = step(at if i == 0 else stop(at))
                if not at.any():
                    break
                kept += alpha * at
            kept[key] += alpha * back.sum()
            return kept

        for key in keys:
            kept, left = np.zeros(n), np.zeros(n)
            if key in place:
                kept = together(key)
                ids = np.flatnonzero(kept)
                kept = kept[ids]
            elif 0 <= key < n:
                left[key] = 1
                for _ in range(rounds):
                    kept += alpha * left
                    left *= 1 - alpha
                    back = left[dangling].sum()
                    left /= width
                    lent = left[holder]
                    left[holder] = 0
                    np.add.at(left, shared, lent)
                    left = send(left)
                    left[key] += back
                ids = np.flatnonzero(kept)
                kept = kept[ids]
            else:  # not of the graph: all comes back to it
                ids, kept = np.array([key]), np.array([1 - (1 - alpha) ** rounds])
            for lo in range(0, len(ids), OUT_ROWS):
                rows = ids[lo : lo + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key)), pa.array(rows), pa.array(kept[lo : lo + OUT_ROWS])], ["key", "node", "score"])

    return run


def power(graph, sources: DataFrame, rounds: int, alpha: float) -> DataFrame | None:
    """source, node, score as push.power_iteration, on a graph of up to WHOLE entries, sent as packed lists; of larger ones None."""
    if not graph.about or graph.entries > WHOLE:
        return None
    packed = graph.packed
    for p in packed:
        r = p.rows.agg(F.min("list").alias("a"), F.min("part").alias("b"), F.max("list").alias("c"), F.max("part").alias("d")).first()
        if r.a is not None and (min(r.a, r.b) < 0 or max(r.c, (r.d << PART) + (1 << PART) - 1) >= WHOLE):
            return None
    none = F.lit(None).cast("array<int>").alias("dsts")
    # Where lists are shared, sources have most of the work in common.
    tasks = 1 if graph.shared else max(1, min(sources.select("source").distinct().count(), graph.spark.sparkContext.defaultParallelism))
    labels = _labels(graph, tasks)
    zero = F.lit(0).cast("long").alias("b")
    rows = None
    for p in packed:
        some = p.rows.select(F.lit(EDGE).alias("kind"), F.col("list").alias("a"), zero, F.col("dsts").cast("array<int>").alias("dsts"))
        rows = some if rows is None else rows.unionByName(some)
    if graph.shared:
        rows = rows.unionByName(graph.holders.select(F.lit(HOLDER).alias("kind"), F.col("node").alias("a"), F.col("list").alias("b"), none))
    rows = rows.select(F.explode(labels).alias("task"), "*")
    dealt = F.element_at(labels, (F.pmod(F.row_number().over(Window.orderBy("source")), F.lit(tasks)) + 1).cast("int"))
    keys = sources.select(F.col("source").cast("long")).distinct().withColumn("task", dealt)  # few: each is a table of all nodes
    rows = rows.unionByName(keys.select("task", F.lit(STATE).alias("kind"), F.col("source").alias("a"), zero, none))
    out = rows.repartition(tasks, "task").select("kind", "a", "b", "dsts").mapInArrow(_power_work(graph.entries, rounds, alpha), "key long, node long, score double")
    return cut(out).select(F.col("key").alias("source"), "node", "score")


def _walked(g: Csr, origin: np.ndarray, start: np.ndarray, number: np.ndarray, salt: str, limit: int, steps: int, restart: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(walkers, the numbers of their nodes) before the first step and after each, of those that made it. The draws are those of
    functions.rng: a walker stops below the limit."""
    stop, move = f"{salt}|stop|".encode(), f"{salt}|move|".encode()
    names = [b"%d|%d|" % w for w in zip(start.tolist(), number.tolist())]
    home = {"source": g.at(origin), "start": g.at(start), "none": None}[restart]
    walkers, at = np.arange(len(start)), g.at(start)
    yield walkers, at

    def drawn(salt: bytes, k: int) -> np.ndarray:
        end = b"%d" % k
        return np.frombuffer(b"".join([md5(salt + names[w] + end).digest()[:4] for w in walkers.tolist()]), ">u4").astype(np.int64)

    for k in range(steps):
        on = drawn(stop, k) >= limit
        walkers, at = walkers[on], at[on]
        if not len(walkers):
            return
        deg = g.deg[at]
        some = deg > 0
        entry = g.first[g.list_of[at]] + drawn(move, k) % np.maximum(deg, 1)
        back = at if home is None else home[walkers]
        at = back.copy() if not some.any() else np.where(some, g.dst[np.where(some, entry, 0)], back)
        yield walkers, at


def _walk_work(salt: str, limit: int, steps: int, restart: str, trace: bool):
    names = ["origin", "start", "walk_no", *(["step"] if trace else []), "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, g = {EDGE: [np.empty((2, 0), np.int64)], HOLDER: [np.empty((2, 0), np.int64)]}, None
        for batch in batches:
            kind, a, b, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b", "x"))
            for k, held in parts.items():
                rows = kind == k
                if rows.any():
                    held.append(np.stack([a[rows], b[rows]]))
            rows = kind == WALKER
            if not rows.any():
                continue
            start, origin, number = a[rows], b[rows], x[rows].astype(np.int64)
            if g is None:  # all edges are here: they come first
                edges, holders = (np.concatenate(parts[k], 1) for k in (EDGE, HOLDER))
                parts = {}
                edges = edges[:, np.argsort(edges[1], kind="stable")]  # a list's entries in the order of dst
                g = Csr(edges, holders, np.empty(0, np.int64), None)
                del edges, holders
            known = g.among(np.concatenate([start, origin]))
            ends, paths = known.at(start), []
            for k, (walkers, at) in enumerate(_walked(known, origin, start, number, salt, limit, steps, restart)):
                if trace:
                    paths.append((origin[walkers], start[walkers], number[walkers], np.full(len(walkers), k, np.int32), known.ids[at]))
                else:
                    ends[walkers] = at
            out = [np.concatenate(c) for c in zip(*paths)] if trace else [origin, start, number, known.ids[ends]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    return run


def walk(graph, starts: DataFrame, salt: str, alpha: float, steps: int, restart: str, trace: bool) -> DataFrame:
    """The rows of walks.walks, and as traced there: each task moves the walkers that come to it, after the edges."""
    tasks = max(1, min(TASKS, graph.spark.sparkContext.defaultParallelism))
    labels, rows = _dealt_edges(graph, tasks)
    dealt = F.element_at(labels, (F.pmod(F.xxhash64("origin", "start", "walk_no"), F.lit(tasks)) + 1).cast("int"))
    walkers = starts.select(dealt.alias("task"), F.lit(WALKER).alias("kind"), F.col("start").cast("long").alias("a"), F.col("origin").cast("long").alias("b"), F.col("walk_no").cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows = rows.unionByName(walkers).repartition(tasks, "task").sortWithinPartitions("kind").select("kind", "a", "b", "x")
    step = "step int, " if trace else ""
    return cut(rows.mapInArrow(_walk_work(salt, below(alpha), steps, restart, trace), f"origin long, start long, walk_no long, {step}node long"))
