"""Learned operators against plain versions of the same rules: votes of neighbours, duels of languages, interpolation."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from wanderlane.llm import language, language_model, quality_classifier, token_counts
from wanderlane.llm.common import fold

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SYLLABLES = "the an re on thou ing er st ha of zu ein der que les ado".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n))


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


# Quality by neighbours


def terms(text):
    raw, x = (text or "").encode(), np.zeros(quality_classifier.WIDTH + 2)
    for a, b in zip(raw, raw[1:]):
        x[quality_classifier._COLUMN[a << 8 | b]] += 1
    x = np.sqrt(x)
    words, size = [w.decode().translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(raw)], np.linalg.norm(np.sqrt(x * x))
    if words:
        seen, twice = set(), 0
        for i in range(len(words) - 7):
            w = tuple(words[i : i + 8])
            twice += w in seen
            seen.add(w)
        x[-2] = size * math.sqrt(sum(a == b for a, b in zip(words, words[1:])) / len(words))
        x[-1] = size * math.sqrt(twice / len(words))
    return x / max(np.linalg.norm(x), 1e-12)


def test_scores_equal_a_plain_vote_of_neighbours(spark):
    rng = np.random.default_rng(11)
    data = [(k, (prose(rng, 50) if k % 3 else " ".join([prose(rng, 4)] * 12)) + f" {k}") for k in range(150)]
    data += [(200, None), (201, ""), (202, "x"), (203, prose(rng, 3000)), (None, prose(rng, 30)), (7, data[7][1])]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 120)] + [(3, 1), (None, 1), (900, 0), (5, None)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in data], "doc_id long, text string, score int").repartition(3)
    model = quality_classifier.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in quality_classifier.score(docs, model).collect())
    known = {k: max(q for i, q in labels if i == k and q is not None) for k in range(120) if not held(k, 5, 0)}
    ids = sorted(known)
    x, y = np.stack([terms(dict(data)[k]) for k in ids]), np.array([known[k] for k in ids], float)
    mean = x.mean(0)
    basis = np.linalg.svd(x - mean, full_matrices=False)[2][: quality_classifier.RANK].T
    unit = lambda v: v / np.linalg.norm(v)
    z = [unit((v - mean) @ basis) for v in x]
    expected = []
    for k, t in data:
        if len((t or "").encode()) < 2:
            expected.append((k, None if t == "x" else y.mean()))
            continue
        sims = [float(unit((terms(t) - mean) @ basis) @ v) for v in z]
        near = sorted(range(len(sims)), key=lambda i: -sims[i])[: quality_classifier.NEIGHBOURS]
        w = [max(sims[i], 0) ** 4 + 1e-9 for i in near]
        expected.append((k, sum(a * y[i] for a, i in zip(w, near)) / sum(w)))
    expected = sorted((k if k is not None else -1, s) for k, s in expected if k != 202)
    got = [g for g in got if g[0] != 202]
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], abs=2e-3)


def test_kept_rows_are_those_at_the_threshold_or_above(spark):
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(k, prose(rng, 40), 2, "x") for k in range(60)], "doc_id long, text string, score int, _score string")
    model = quality_classifier.fit(docs.select("doc_id", "text"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    kept = quality_classifier.keep(docs, model, threshold=0.5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, s in scores.items() if s >= 0.5}


# Languages


def trigrams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    raw = bytes(0x20 if b < 128 and not chr(b).isalpha() else b for b in raw)
    x = np.zeros(language.WIDTH)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        if (a, b) != (32, 32):
            x[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 16 & language.WIDTH - 1] += 1
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-12)


def test_languages_equal_a_plain_family_and_duels(spark):
    rng = np.random.default_rng(3)
    stems = {"en": ["the", "ing", "tion"], "de": ["der", "ung", "sch"], "nl": ["het", "ijk", "oor"], "fr": ["eau", "les", "oux"], "es": ["ado", "los", "ción"], "xx": ["qqz", "zzq", "xyx"]}
    data = [(k, " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(rng.integers(2, 30))), lang) for k, lang in enumerate(list(stems) * 25)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(docs.filter("doc_id < 110"))
    assert sorted(model["families"]) == ["germanic", "romance", "xx"]
    assert set(model["pairs"]) == {("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    sure = lambda m: 1 / (1 + math.exp(-4 * m))
    for k, text, _ in data:
        x = trigrams(text)
        margins = {f: float(x @ w + b) for f, (w, b) in zip(model["families"], model["family"])}
        family = max(margins, key=margins.get)
        members, wins, least = model["members"][family], collections.Counter(), {m: math.inf for m in model["members"][family]}
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                w, bias = model["pairs"][a, b]
                m = float(x @ w + bias)
                wins[a if m > 0 else b] += 1
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(members, key=lambda m: (wins[m], least[m]))
        score = sure(margins[family]) * (1 if math.isinf(least[best]) else sure(least[best]))
        assert got[k][0] == best
        assert got[k][1] == pytest.approx(score, abs=1e-4)


def test_one_language_may_fill_the_sample(spark):
    docs = spark.createDataFrame([(k, f"w{k} text", "en") for k in range(1500)], "doc_id long, text string, lang string")
    assert language.sample(docs, 1400).count() == 1400


# Deleted interpolation


def plain_scores(rows):
    """Scores by counting, held-out weights per bucket of the context's count, all in plain Python."""
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [[w.decode().translate(lower) for w in WORDS.findall((t or "").encode())] + ["\0"] for _, t in rows]
    train = [not held(i, 7, 2) for i, _ in rows]
    one, two = collections.Counter(), collections.Counter()
    for t, use in zip(texts, train):
        if use:
            one.update(t)
            two.update(zip(["\1", *t], t))
    n, v, begins = one.total(), len(one), sum(train)
    context = lambda w: begins if w == "\1" else one[w]
    bucket = lambda c: c.bit_length()
    cell = lambda p: 1 + math.floor(-language_model.FINE * math.log2(p)) if p > 0 else 0
    cells = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for t, use in zip(texts, train):
        if use:
            for a, b in zip(["\1", *t], t):
                c = context(a)
                p2, p1 = ((two[a, b] - 1) / (c - 1) if c > 1 else 0.0), (one[b] - 1) / (n - 1)
                at = cells[bucket(c - 1), cell(p2), cell(p1)]
                at[0], at[1], at[2] = at[0] + 1, at[1] + p1, at[2] + p2
    weights = {}
    for k in {b for b, *_ in cells}:
        mine, w = [(m, s1 / m, s2 / m) for (b, *_), (m, s1, s2) in cells.items() if b == k], [1 / 3] * 3
        for _ in range(60):
            new = [0.0] * 3
            for m, p1, p2 in mine:
                parts = [w[0] / (v + 1), w[1] * p1, w[2] * p2]
                new = [x + m * p / sum(parts) for x, p in zip(new, parts)]
            new = [x / sum(m for m, *_ in mine) for x in new]
            new[0] = max(new[0], language_model.LEAST)
            w = [x / sum(new) for x in new]
        weights[k] = w
    default = [language_model.LEAST, 0.5, 0.5]
    zero = weights.get(0, [0.1, 0.9, 0.0])
    weights[0] = [x / (zero[0] + zero[1]) for x in (zero[0], zero[1], 0.0)]
    out = []
    for t in texts:
        score = 0.0
        for a, b in zip(["\1", *t], t):
            w, c = weights.get(bucket(context(a)), default), context(a)
            score += math.log10(w[0] / (v + 1) + w[1] * one[b] / n + w[2] * two[a, b] / max(c, 1))
        out.append(score)
    return out


def test_scores_equal_plain_interpolation(spark):
    rng = np.random.default_rng(21)
    rows = [(k, prose(rng, int(m))) for k, m in enumerate(rng.integers(1, 150, 60))]
    rows += [(100, None), (101, ""), (102, "never seen words here"), (None, prose(rng, 20)), (5, rows[5][1]), (103, prose(rng, 4000))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, train int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in language_model.score(docs, ~fold("doc_id", 7, 2)).collect())
    expected = sorted((k if k is not None else -1, s) for (k, _), s in zip(rows, plain_scores(rows)))
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], rel=1e-6)


# Batches over one cache


def test_the_second_batch_finds_what_the_first_stored(spark, tmp_path, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    path, cache = public.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(k, f"text number {k % 10}") for k in range(100)], "doc_id long, text string")
    sizes, fill = [], token_counts.fill_cache

    def spied(*args):
        fill(*args)
        sizes.append(spark.read.parquet(cache).count())

    monkeypatch.setattr(token_counts, "fill_cache", spied)
    got = token_counts.count_tokens(docs, path, cache, batches=2)
    assert got.count() == 100
    assert sizes == [10, 10]  # all ten texts are in the first batch, the second has nothing to add
