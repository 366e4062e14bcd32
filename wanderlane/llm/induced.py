"""External induced sorting of suffixes with their common prefixes.

The suffixes of a text are split into types L and S by whether the next suffix is smaller or larger. The leftmost S
suffixes of each run (S*) cut the text into pieces; pieces are ranked, and the text of ranks is sorted by the same method,
recursively, until ranks are distinct. From the sorted S* suffixes the L suffixes are induced in one ascending scan, and
from these the S suffixes in one descending scan: a suffix read in order puts the suffix one to its left into the bucket
of that one's first symbol.

Buckets are a priority queue of tuples (symbol, position, common prefix with the entry before in its bucket), which holds
a bounded number of tuples in memory and the others in sorted runs on disk; equal symbols leave it in the order in which
they came. The common prefix of an induced tuple is one more than the least common prefix met since the last tuple for
the same bucket. Common prefixes are cut off at a limit, which is all that finding repeats of that length needs. Text,
order and ranks are files in memory maps where they are large.

Symbols of the first level are bytes; a bucket is read at a time, so the scans are vectorised. Deeper levels have large
alphabets; there a range of buckets is read at a time and the tuples that fall back into the range are ranked with it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

ROWS = 1 << 20  # tuples in memory, for each of the few arrays in use at a time
DEEP = 4096  # waves of tuples that fall back into a range, before it is read a bucket at a time


class Store:
    """A folder for the files of one sort; removed on exit, also when the sort fails."""

    def __init__(self, rows: int = ROWS):
        self.rows = rows
        self._dir = tempfile.TemporaryDirectory(prefix="induced-")
        self._n = 0

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self._dir.cleanup()

    def path(self) -> str:
        self._n += 1
        return os.path.join(self._dir.name, str(self._n))

    def empty(self, n: int, dtype) -> np.ndarray:
        """An array, in a file if it has more than rows entries."""
        return np.empty(n, dtype) if n <= self.rows else np.memmap(self.path(), dtype, "w+", shape=(n,))


class Queue:
    """Tuples by ascending key, first in first out among equal keys; sorted runs on disk beyond store.rows tuples."""

    def __init__(self, store: Store, dtype):
        self.store, self.dtype = store, np.dtype(dtype)
        self.fresh: list[np.ndarray] = []
        self.n_fresh = 0
        self.runs: list[np.ndarray] = []  # sorted; what is left of each
        self.paths: list[str] = []

    def push(self, items: np.ndarray) -> None:
        if len(items):
            self.fresh.append(items)
            self.n_fresh += len(items)
            if self.n_fresh > self.store.rows:
                self._add_run(self._sorted())

    def _add_run(self, items: np.ndarray) -> None:
        path = self.store.path()
        items.tofile(path)
        self.runs.append(np.memmap(path, self.dtype, "r"))
        self.paths.append(path)

    def _drop_read(self) -> None:
        for k in [k for k, run in enumerate(self.runs) if not len(run)][::-1]:
            del self.runs[k]
            os.unlink(self.paths.pop(k))

    def _sorted(self) -> np.ndarray:
        items = np.concatenate(self.fresh) if self.fresh else np.empty(0, self.dtype)
        self.fresh, self.n_fresh = [], 0
        return items[np.argsort(items["key"], kind="stable")]

    def pop_through(self, key: int) -> np.ndarray:
        """All tuples with keys up to key, in order."""
        taken = []
        for k, run in enumerate(self.runs):
            cut = int(np.searchsorted(run["key"], key, "right"))
            taken.append(np.array(run[:cut]))
            self.runs[k] = run[cut:]
        self._drop_read()
        last = self._sorted()
        cut = int(np.searchsorted(last["key"], key, "right"))
        taken.append(last[:cut])
        if cut < len(last):
            self.fresh, self.n_fresh = [last[cut:]], len(last) - cut
        out = np.concatenate(taken)
        return out[np.argsort(out["key"], kind="stable")] if len(taken) > 1 else out


class ByteQueue(Queue):
    """A queue of byte keys: a list for each key in memory, so that reading a bucket touches no other."""

    def __init__(self, store: Store, dtype):
        super().__init__(store, dtype)
        self.lists: list[list[np.ndarray]] = [[] for _ in range(256)]

    def push(self, items: np.ndarray) -> None:
        """items: by ascending key."""
        if not len(items):
            return
        cuts = np.append(np.flatnonzero(np.append(True, items["key"][1:] != items["key"][:-1])), len(items))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            self.lists[int(items["key"][lo])].append(items[lo:hi])
        self.n_fresh += len(items)
        if self.n_fresh > self.store.rows:
            self._add_run(np.concatenate([x for key in self.lists for x in key]))
            self.lists, self.n_fresh = [[] for _ in range(256)], 0

    def pop_through(self, key: int) -> np.ndarray:
        taken = []
        for k, run in enumerate(self.runs):
            cut = int(np.searchsorted(run["key"], key, "right"))
            taken.append(np.array(run[:cut]))
            self.runs[k] = run[cut:]
        self._drop_read()
        for k in range(key + 1):
            taken += self.lists[k]
            self.n_fresh -= sum(map(len, self.lists[k]))
            self.lists[k] = []
        out = np.concatenate([np.empty(0, self.dtype), *taken])
        return out[np.argsort(out["key"], kind="stable")] if (out["key"][1:] < out["key"][:-1]).any() else out


def types(text: np.ndarray, store: Store) -> np.ndarray:
    """True for S. The end of the text is less than any symbol, so the last suffix is L."""
    n = len(text)
    out, after = store.empty(n, bool), False
    for hi in range(n, 0, -store.rows):
        lo = max(0, hi - store.rows)
        part = np.array(text[lo : min(hi + 1, n)])
        if hi == n:
            less, same = np.append(part[:-1] < part[1:], False), np.append(part[:-1] == part[1:], False)
        else:
            less, same = part[:-1] < part[1:], part[:-1] == part[1:]
        # An equal neighbour has the type of the next unequal one.
        at = np.where(same, hi - lo, np.arange(hi - lo))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        full = np.append(less, after)
        out[lo:hi] = full[nxt]
        after = bool(out[lo])
    return out


def stars(kind: np.ndarray, store: Store) -> np.ndarray:
    """Positions of S suffixes whose left neighbour is L."""
    found = []
    for lo in range(1, len(kind), store.rows):
        hi = min(lo + store.rows, len(kind))
        found.append(np.flatnonzero(kind[lo:hi] & ~kind[lo - 1 : hi - 1]) + lo)
    count = sum(map(len, found))
    out, at = store.empty(count, np.int64), 0
    for f in found:
        out[at : at + len(f)] = f
        at += len(f)
    return out


def _runs(new: np.ndarray, m: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, sizes) of the runs of more than one, where new tells that one begins; some `rows` members at a time, but a run whole."""
    open_ = np.empty(0, np.int64)
    for lo in range(0, m, rows):
        at = np.append(open_, np.flatnonzero(new[lo : lo + rows]) + lo)
        if lo + rows >= m:
            at = np.append(at, m)
        starts, sizes = at[:-1], np.diff(at)
        use = sizes > 1
        if use.any():
            yield starts[use], sizes[use]
        open_ = at[-1:]


def _counts(text: np.ndarray, top: int, flip: int, store: Store) -> np.ndarray:
    """How many symbols of the (flipped) text are up to each one: in memory, or in a file where there are many symbols."""
    size = max(top, flip) + 1
    if size <= store.rows:
        count = np.zeros(top + 1, np.int64)
        for lo in range(0, len(text), store.rows):
            count += np.bincount(text[lo : lo + store.rows], minlength=top + 1)
        return np.cumsum(np.append(np.zeros(size - top - 1, np.int64), count[::-1]) if flip else count)
    count = store.empty(size, np.int64)
    for lo in range(0, size, store.rows):
        count[lo : lo + store.rows] = 0
    for lo in range(0, len(text), store.rows):
        found, n = np.unique(_lookup(text, slice(lo, lo + store.rows), flip), return_counts=True)
        count[found] += n
    before = 0
    for lo in range(0, size, store.rows):
        part = np.cumsum(count[lo : lo + store.rows]) + before
        count[lo : lo + store.rows], before = part, int(part[-1])
    return count


def rank_pieces(text: np.ndarray, kind: np.ndarray, star: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, rank of each piece in text order, number of ranks) of the pieces from each S* to the next, both included.

    Symbols are compared with their type as the last bit; so no piece is a proper prefix of another. A piece's first
    symbols are sorted through a disk-backed queue; only equal ones are compared further.
    """
    n, m = len(text), len(star)
    top = max((int(np.max(text[lo : lo + store.rows])) for lo in range(0, n, store.rows)), default=0)
    bits = (2 * top + 3).bit_length()
    per = 63 // bits

    def packed(which: np.ndarray, skip: int) -> np.ndarray:
        begin, last = star[which] + skip, np.where(which + 1 < m, star[np.minimum(which + 1, m - 1)], n)
        out = np.zeros(len(which), np.uint64)
        for k in range(per):
            at = begin + k
            inside = (at <= last) & (at < n)
            safe = np.where(inside, at, 0)
            symbol = np.where(inside, 2 * text[safe].astype(np.int64) + kind[safe] + 1, 0)
            out = (out << np.uint64(bits)) | symbol.astype(np.uint64)
        return out

    queue = Queue(store, [("key", "<u8"), ("which", "<i8")])
    for lo in range(0, m, store.rows):
        which = np.arange(lo, min(m, lo + store.rows))
        items = np.empty(len(which), queue.dtype)
        items["key"], items["which"] = packed(which, 0), which
        queue.push(items)
    order, new, at, last_key = store.empty(m, np.int64), store.empty(m, bool), 0, None
    step = 1 << max(0, bits * per - max(0, (max(1, m // store.rows)).bit_length()))
    bound = step - 1
    while at < m:
        got = queue.pop_through(min(bound, (1 << 64) - 1))
        bound += step
        if len(got):
            order[at : at + len(got)] = got["which"]
            fresh = np.append(True, got["key"][1:] != got["key"][:-1])
            fresh[0] = last_key is None or got["key"][0] != last_key
            new[at : at + len(got)] = fresh
            last_key = got["key"][-1]
            at += len(got)
    # Refine runs of equal beginnings, some whole runs at a time.
    for starts, sizes in _runs(new, m, store.rows):
        slot = np.repeat(starts, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group, which, skip = np.repeat(starts, sizes), np.array(order[slot]), per
        while len(which):
            last = np.where(which + 1 < m, star[np.minimum(which + 1, m - 1)], n)
            more = star[which] + skip <= last  # pieces of a group end together
            slot, group, which = slot[more], group[more], which[more]
            if not len(which):
                break
            key = packed(which, skip)
            by = np.lexsort((key, group))
            key, which, g = key[by], which[by], group[by]
            order[slot] = which
            head = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
            new[slot[head]] = True
            first = np.flatnonzero(head)
            count = np.diff(np.append(first, len(which)))
            group = np.repeat(slot[first], count)
            again = np.repeat(count > 1, count)
            slot, group, which = slot[again], group[again], which[again]
            skip += per
    rank, ranks = store.empty(m, np.int64), 0
    for lo in range(0, m, store.rows):
        r = np.cumsum(new[lo : lo + store.rows]) + ranks - 1
        rank[order[lo : lo + store.rows]] = r
        ranks = int(r[-1]) + 1
    return order, rank, ranks


def _lookup(text: np.ndarray, at: np.ndarray, flip: int) -> np.ndarray:
    c = text[at].astype(np.int64)
    return flip - c if flip else c


def induce_order(text: np.ndarray, seeds: np.ndarray, flip: int, begin: bool, store: Store) -> np.ndarray:
    """The suffixes induced from sorted seeds, in the order of their (flipped) symbols. begin: the end of the text is a seed."""
    n = len(text)
    queue = Queue(store, [("key", "<u8"), ("pos", "<i8")])

    def push(pos: np.ndarray, chars: np.ndarray) -> None:
        items = np.empty(len(pos), queue.dtype)
        items["key"], items["pos"] = chars, pos
        queue.push(items)

    if begin and n:
        push(np.array([n - 1]), _lookup(text, np.array([n - 1]), flip))
    top = max((int(np.max(text[lo : lo + store.rows])) for lo in range(0, n, store.rows)), default=0)
    total = _counts(text, top, flip, store)
    seed_at = low = 0
    result, filled = store.empty(n, np.int64), 0
    while low < len(total):
        high = max(low, int(np.searchsorted(total, (total[low - 1] if low else 0) + store.rows // 4, "right")) - 1)
        while True:
            old_q = queue.pop_through(high)
            pos, char = old_q["pos"], old_q["key"].astype(np.int64)
            stop = seed_at
            while stop < len(seeds):
                block = _lookup(text, seeds[stop : stop + store.rows], flip)
                k = int(np.searchsorted(block, high, "right"))
                stop += k
                if k < len(block):
                    break
            s_pos = np.array(seeds[seed_at:stop])
            s_char = _lookup(text, s_pos, flip)
            # Items: old ones, seeds, then children within the range, wave by wave.
            P, C = [pos, s_pos], [char, s_char]
            kind = [np.zeros(len(pos), np.int64), np.full(len(s_pos), 2)]
            val = [np.arange(len(pos)), np.arange(len(s_pos))]
            base, front_p, front_c, front_seed, size = 0, np.concatenate(P), np.concatenate(C), np.concatenate([np.zeros(len(pos), bool), np.ones(len(s_pos), bool)]), len(pos) + len(s_pos)
            deep = 0
            while len(front_p):
                has = front_p > 0
                left = _lookup(text, np.where(has, front_p - 1, 0), flip)
                child = has & (left <= high) & ((left > front_c) | ((left == front_c) & ~front_seed))
                idx = np.flatnonzero(child)
                parent = idx + base
                base, front_p, front_c = size, front_p[idx] - 1, left[idx]
                front_seed = np.zeros(len(idx), bool)
                P.append(front_p)
                C.append(front_c)
                kind.append(np.ones(len(idx), np.int64))
                val.append(parent)
                size += len(idx)
                deep += 1
                if deep > DEEP and high > low:
                    break
            if deep > DEEP and high > low and len(front_p):  # long runs: take one bucket, where waves need no ranking
                keep = char <= low
                push(pos[~keep], char[~keep])
                push(pos[keep], char[keep])
                high = low
                continue
            break
        if high == low:
            order = np.concatenate([P[0], *P[2:], P[1]])  # old, waves, seeds
            from_seed = np.append(np.zeros(size - len(s_pos), bool), np.ones(len(s_pos), bool))
        else:
            p, c, k, v = (np.concatenate(x) for x in (P, C, kind, val))
            # By symbol and kind, then by the parent's, and so on up to an old one or a seed: doubling along the parents.
            up = np.where(k == 1, v, np.arange(size))
            minor, major = np.where(k == 1, 0, v), 3 * c + k
            while True:
                by = np.lexsort((minor, major))
                step = (major[by][1:] != major[by][:-1]) | (minor[by][1:] != minor[by][:-1])
                major = np.empty(size, np.int64)
                major[by] = np.append(0, np.cumsum(step))
                if step.all():
                    break
                minor, up = major[up], up[up]
            order, from_seed = p[by], k[by] == 2
        has = order > 0
        left = _lookup(text, np.where(has, order - 1, 0), flip)
        away = has & (left > high)
        push(order[away] - 1, left[away])
        mine = order[~from_seed]
        result[filled : filled + len(mine)] = mine
        filled += len(mine)
        seed_at, low = stop, high + 1
    return result[:filled]


def suffix_order(text: np.ndarray, store: Store) -> np.ndarray:
    """Positions of all suffixes of a text of integers, in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    kind = types(text, store)
    sorted_stars = sort_stars(text, kind, store)
    larger = induce_order(text, sorted_stars, 0, True, store)  # L
    top = int(max(int(np.max(text[lo : lo + store.rows])) for lo in range(0, n, store.rows)))
    smaller = induce_order(text, larger[::-1], top + 1, False, store)  # S, in descending order
    # Buckets hold their L suffixes first.
    queue = Queue(store, [("key", "<u8"), ("pos", "<i8")])
    for part, s in ((larger, 0), (smaller[::-1], 1)):
        for lo in range(0, len(part), store.rows):
            pos = np.array(part[lo : lo + store.rows])
            items = np.empty(len(pos), queue.dtype)
            items["key"], items["pos"] = 2 * text[pos].astype(np.int64) + s, pos
            queue.push(items)
    out, at, step = store.empty(n, np.int64), 0, max(1, 2 * (top + 1) * store.rows // max(n, 1))
    bound = step - 1
    while at < n:
        got = queue.pop_through(bound)["pos"]
        out[at : at + len(got)] = got
        at += len(got)
        bound += step
    return out


def sort_stars(text: np.ndarray, kind: np.ndarray, store: Store) -> np.ndarray:
    """The S* suffixes in order: by rank if ranks are distinct, else by the order of the text of ranks."""
    star = stars(kind, store)
    if len(star) < 2:
        return star
    order, rank, ranks = rank_pieces(text, kind, star, store)
    if ranks < len(star):
        order = suffix_order(rank, store)
    out = store.empty(len(star), np.int64)
    for lo in range(0, len(star), store.rows):
        out[lo : lo + store.rows] = star[order[lo : lo + store.rows]]
    return out


class Prefixes:
    """Common prefixes of suffixes of a byte text, cut off at limit, by comparing eight bytes at a time."""

    def __init__(self, text: np.ndarray, limit: int):
        self.n, self.limit = len(text), limit
        self.buffer = np.concatenate([text, np.zeros(limit + 16, np.uint8)])
        self.words = np.ndarray((self.n + limit + 8,), "<u8", self.buffer.data, 0, (1,))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.minimum(self.limit, self.n - np.maximum(a, b))
        live = np.arange(len(a))
        for skip in range(0, self.limit, 8):
            live = live[out[live] > skip]
            if not len(live):
                break
            x = self.words[a[live] + skip] ^ self.words[b[live] + skip]
            off = x != 0
            if off.any():
                low = x[off] & (~x[off] + np.uint64(1))
                byte = np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
                out[live[off]] = np.minimum(out[live[off]], skip + byte)
                live = live[~off]
        return out


def _induce_with_prefixes(text: np.ndarray, seeds: Iterator, flip: int, begin: bool, prefixes: Prefixes, store: Store) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, positions, common prefix with the one before) of the induced suffixes. seeds(bucket): (positions, prefixes)."""
    limit, n = prefixes.limit, len(text)
    narrow = np.int16 if limit < 1 << 15 else np.int32
    queue = ByteQueue(store, [("key", "u1"), ("pos", "<u4" if n < 1 << 32 else "<i8"), ("lcp", narrow)])
    least = np.full(256, -1, np.int64)  # since the last tuple for each bucket; -1: none yet

    def scan(pos: np.ndarray, lcp: np.ndarray, bucket: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
        """Push what these suffixes, in order, induce; return what falls into the same bucket."""
        inside_pos, inside_lcp = [], []
        for lo in range(0, len(pos), store.rows):
            p, l = pos[lo : lo + store.rows], lcp[lo : lo + store.rows].astype(np.int64)  # noqa: E741
            has = p > 0
            left = _lookup(text, np.where(has, p - 1, 0), flip)
            idx = np.flatnonzero(has & ((left > bucket) if strict else (left >= bucket)))
            to = left[idx]
            by = np.argsort(to, kind="stable")
            idx, to = idx[by], to[by]
            head = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
            tail = np.append(head[1:], len(to)) - 1 if len(to) else head
            since = np.empty(len(to), np.int64)
            since[1:] = idx[:-1] + 1
            since[head] = 0
            levels = [l.astype(narrow)]
            while 2 << (len(levels) - 1) <= len(l):
                half = 1 << (len(levels) - 1)
                levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
            width = idx - since + 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            low = np.empty(len(to), np.int64)
            for k in np.unique(level):
                use = level == k
                low[use] = np.minimum(levels[k][since[use]], levels[k][idx[use] - (1 << int(k)) + 1])
            before = least[to[head]]
            low[head] = np.where(before < 0, -1, np.minimum(before, low[head]))
            found = np.minimum(low + 1, limit)
            least[:] = np.where(least < 0, -1, np.minimum(least, l.min()))
            after = np.minimum.accumulate(np.append(l, limit)[::-1])[::-1]
            least[to[tail]] = after[idx[tail] + 1]
            child, here = p[idx] - 1, to == bucket
            inside_pos.append(child[here])
            inside_lcp.append(found[here])
            items = np.empty(int((~here).sum()), queue.dtype)
            items["key"], items["pos"], items["lcp"] = to[~here], child[~here], found[~here]
            queue.push(items)
        return (np.concatenate(inside_pos), np.concatenate(inside_lcp)) if inside_pos else (np.empty(0, np.int64), np.empty(0, np.int64))

    if begin and n:
        scan(np.array([n]), np.array([0]), -1, True)
    for bucket in range(256):
        got = queue.pop_through(bucket)
        pos, lcp, last = got["pos"].astype(np.int64), got["lcp"].astype(np.int64), None
        while len(pos):
            yield bucket, pos, lcp
            last = pos[-1:]
            pos, lcp = scan(pos, lcp, bucket, False)
        for s_pos, s_lcp in seeds(bucket):
            if last is not None and len(s_pos):
                s_lcp = s_lcp.copy()
                s_lcp[:1] = prefixes.of(last, s_pos[:1])
            last = None
            scan(s_pos, s_lcp, bucket, True)


class _Lists:
    """(positions, prefixes) by bucket, in files; readable forwards and backwards."""

    def __init__(self, store: Store, n: int, limit: int):
        self.store, self.parts, self.held = store, [[] for _ in range(256)], 0
        self.dtype = np.dtype([("pos", "<u4" if n < 1 << 32 else "<i8"), ("lcp", "<i2" if limit < 1 << 15 else "<i4")])

    def add(self, bucket: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        """In memory up to the store's number of rows, then in files, but for short ones."""
        both = np.empty(len(pos), self.dtype)
        both["pos"], both["lcp"] = pos, lcp
        self.held += len(pos)
        if self.held > self.store.rows and len(pos) > 4096:
            self.held -= len(pos)
            path = self.store.path()
            both.tofile(path)
            self.parts[bucket].append(path)
        else:
            self.parts[bucket].append(both)

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        both = np.fromfile(part, self.dtype) if isinstance(part, str) else part
        return both["pos"].astype(np.int64), both["lcp"].astype(np.int64)

    def read(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in self.parts[bucket]:
            yield self._load(part)

    def read_back(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Backwards: a prefix belongs to the pair with the one after, which now comes before."""
        carry = 0
        for part in reversed(self.parts[bucket]):
            pos, lcp = self._load(part)
            yield pos[::-1], np.append(carry, lcp[:0:-1])
            carry = int(lcp[0]) if len(lcp) else carry


def sorted_suffixes(text: np.ndarray, limit: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of a byte text in order, in blocks: (positions, common prefix with the suffix before, at most limit)."""
    if not len(text):
        return
    with Store(rows) as store:
        kind = types(text, store)
        star = sort_stars(text, kind, store)
        prefixes = Prefixes(text, limit)

        def of_stars(bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            lo, hi = bounds[bucket], bounds[bucket + 1]
            for at in range(lo, hi, rows):
                p = np.array(star[at : min(hi, at + rows)])
                before = star[at - 1 : at] if at > lo else p[:1]
                l = prefixes.of(np.append(before, p[:-1]), p)  # noqa: E741
                if at == lo:
                    l[0] = 0
                yield p, l

        counts = np.zeros(256, np.int64)
        for at in range(0, len(star), rows):
            counts += np.bincount(text[star[at : at + rows]], minlength=256)
        bounds = np.append(0, np.cumsum(counts))
        larger = _Lists(store, len(text), limit)
        for bucket, pos, lcp in _induce_with_prefixes(text, of_stars, 0, True, prefixes, store):
            larger.add(bucket, pos, lcp)
        smaller = _Lists(store, len(text), limit)
        for bucket, pos, lcp in _induce_with_prefixes(text, lambda b: larger.read_back(255 - b), 255, False, prefixes, store):
            smaller.add(255 - bucket, pos, lcp)
        for bucket in range(256):
            last = None
            for pos, lcp in larger.read(bucket):
                yield pos, lcp
                last = pos[-1:]
            # S suffixes were induced in descending order; turn them round.
            for pos, lcp in smaller.read_back(bucket):
                if last is not None:
                    lcp = lcp.copy()
                    lcp[0] = prefixes.of(last, pos[:1])[0]
                    last = None
                yield pos, lcp
