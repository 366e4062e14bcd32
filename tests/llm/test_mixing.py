"""Mixing against a plain one: draws slot by slot, takes words block by block. And what the mixed corpus looks like."""

import collections
import math
import re
import struct

import pytest
from pyspark.sql import functions as F

from wanderlane.llm import mixing

xxhash = pytest.importorskip("xxhash")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, taken int"


def spark_hash(*values):
    """xxhash64 of int (4 bytes), ("long", v) and text, one after the other; null changes nothing."""
    out = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[1]) if isinstance(v, tuple) else struct.pack("<i", v)
            out = xxhash.xxh64_intdigest(raw, out)
    return out


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def permuted(at, n, *key):
    for r in range(mixing.ROUNDS):
        partner = (signed(spark_hash(*key, r)) % n - at) % n
        if spark_hash(*key, r, ("long", max(at, partner)), "swap") >> 17 & 1:
            at = partner
    return at


def brute(rows, seed=17, block=8, shard_slots=64, cap=2, tolerance=mixing.TOLERANCE, weights=(3, 1, 2), draw=None):
    """taken of each row (doc_id, text, source), and the drawn number of slots of each source."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * total[s]}
        target |= {s: float(cap * total[s]) for s in over} if over else share
        left -= sum(cap * total[s] for s in over)
        open_ = open_ - over if over else set()
    wanted = {s: min(math.floor(target[s] + 0.5), cap * total[s]) for s in order}
    slack = {s: 0 if wanted[s] == cap * total[s] else math.floor(target[s] * tolerance) for s in order}
    all_ = sum(wanted.values())
    drawn = collections.Counter()
    for slot in range(-(-all_ // block)):
        at, upto = (draw or (lambda i: signed(spark_hash(("long", i), seed, "draw")) % all_))(slot), 0
        for s in order:
            upto += wanted[s]
            if at < upto:
                drawn[s] += 1
                break
    taken = [0] * len(rows)
    for number, s in enumerate(order, 1):
        stream = sorted((spark_hash(t or "", seed, ("long", d) if d is not None else None), d if d is not None else -1, n, k) for k, ((d, t, x), n) in enumerate(zip(rows, size)) if x == s and n)
        words = [k for *_, n, k in stream for _ in range(n)]
        n_blocks = -(-len(words) // block)
        if not n_blocks:
            continue
        blocks = [words[permuted(k % n_blocks, n_blocks, seed, number, ("long", k // n_blocks)) * block :][:block] for k in range(cap * n_blocks)]
        mine = sum(map(len, blocks[: drawn[s]]))
        goal = min(max(mine, wanted[s] - slack[s]), min(wanted[s] + slack[s], cap * total[s]))
        for k in [k for b in blocks for k in b][:goal]:
            taken[k] += 1
    return taken, drawn


@pytest.fixture(scope="module")
def rows():
    text = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    sizes = [(k, 3 + k * 7 % 90, f"s{k % 5}" if k % 5 else None) for k in range(120)]
    out = [(k, text(k, n), s) for k, n, s in sizes]
    return [*out, out[3], out[3], (3, "another text with that id", "s3"), (None, "no id here", "s1"), (None, None, None), (130, None, "t"), (131, "  \n ", "s2"), (132, text(132, 5000), "s4"), (133, "one", "u")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None, 7, 7, 7) for d, t, s in rows], DOC).repartition(3)


def counted(rows, taken):
    return collections.Counter((d, s, len(WORDS.findall(t or "")), n) for (d, t, s), n in zip(rows, taken))


def test_mix_equals_a_plain_mix(docs, rows):
    for options in ({"block": 8, "shard_slots": 64}, {"block": 5, "shard_slots": 16, "seed": 3}, {"block": 256}):
        got = collections.Counter((r.doc_id, r.source, r["size"], r.taken) for r in mixing.mix(docs, **options)[0].collect())
        assert got == counted(rows, brute(rows, **{"block": 256} | options)[0])


def test_the_draws_decide_within_the_tolerance(docs, rows, monkeypatch):
    options = {"block": 8, "shard_slots": 64, "tolerance": 0.5}
    by_draw = mixing.mix(docs, **options)[0]
    words = {r.source: r.words for r in by_draw.groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    expected, drawn = brute(rows, block=8, tolerance=0.5)
    assert collections.Counter((r.doc_id, r.source, r["size"], r.taken) for r in by_draw.collect()) == counted(rows, expected)
    assert any(0 < 8 * drawn[s] - words[s] < 8 * 2 or words[s] == 8 * drawn[s] for s in words)  # as many as its blocks hold
    other = lambda goal, n_slots, total, *rest: goal.sparkSession.createDataFrame([(0, 1, n_slots)], "shard long, s int, n long")
    monkeypatch.setattr(mixing, "draw_counts", other)
    changed = {r.source: r.words for r in mixing.mix(docs, **options)[0].groupBy("source").agg(F.sum("taken").alias("words")).collect()}
    assert changed != words


def test_pieces_keep_their_slots(docs):
    by_row, pieces = mixing.mix(docs, block=8, shard_slots=64)
    assert pieces.filter("shard is not null").select("shard").distinct().count() > 1
    assert pieces.filter("shard is null").agg(F.sum(F.col("to") - F.col("from"))).first()[0] < 0.2 * by_row.agg(F.sum("taken")).first()[0]


def test_the_mixed_corpus_is_text_as_it_was(spark):
    rows = [(k, f"  line {k}\n\n\tindented {k} " + " ".join(f"w{j}" for j in range(40)) + "\n", "a" if k % 2 else "b", 9) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, origin string, key int")
    names = {"text_col": "body", "id_col": "doc_id", "source_col": "origin"}
    got = mixing.apply_mix(docs, block=8, **names)
    assert got.columns == docs.columns
    text = {k: t for k, t, *_ in rows}
    n = collections.Counter()
    for r in got.collect():
        n[r.doc_id] += len(WORDS.findall(r.body))
        if len(WORDS.findall(r.body)) == len(WORDS.findall(text[r.doc_id])):
            assert r.body == text[r.doc_id]
        assert all(x in text[r.doc_id] for x in re.findall(r"\s*\S+", r.body)[:1])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=8, **names)[0].collect()}
    assert n == collections.Counter({k: v for k, v in taken.items() if v})
    assert any(r.body == text[r.doc_id] for r in got.collect())


def test_nothing_to_mix(spark, docs):
    assert mixing.mix(docs.limit(0))[0].isEmpty()
    assert mixing.apply_mix(docs.limit(0)).isEmpty()
    blank = docs.filter("text is null")
    assert {r.taken for r in mixing.mix(blank)[0].collect()} == {0}
    assert mixing.apply_mix(blank).isEmpty()
