"""Text operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderlane.llm import components, embeddings, induced, language, language_model, mixing, pieces, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts
from wanderlane.llm.common import fold

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the an re on thou ing er st ha of".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long"
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = [prose(rng, int(n)) for n in rng.integers(30, 200, 30)]
    texts = [*base, *base[:4], base[5] + " tail", "Head " + base[6], base[7][:700] + " middle " + base[8], None, "", "   \n\t", "é" * 700, "aB" * 3000, "a\nb\na\n\na", prose(rng, 8000), "<|endoftext|> x", "日本 語"]
    return [(k, t, ("en", "fr", None)[k % 3], None if k % 7 == 3 else f"s{k % 4}", None, 1, 2) for k, t in enumerate(texts)] + [(2, base[2], "en", "s2", 3, 1, 2), (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_row(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# 1


def test_embeddings_link_what_brute_force_links(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 16))
    near = [x[k] + 0.1 * rng.standard_normal(16) for k in range(12)]
    vectors = [*x.tolist(), *(v.tolist() for v in near), x[0].tolist(), (2 * x[1]).tolist(), None, [], [0.0] * 16, [math.nan] * 16, [None] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, 1, 7) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df.unionByName(df.filter("vec_id = 3"))).collect()}
    good = [k for k in range(len(vectors)) if vectors[k] and len(vectors[k]) == 16 and None not in vectors[k] and np.isfinite(vectors[k]).all() and any(vectors[k])]
    u = {k: np.array(vectors[k]) / np.linalg.norm(vectors[k]) for k in good}
    links = {k: {j for j in good if j != k and u[k] @ u[j] >= 0.9} for k in good}
    found = sum(got[k].n_links for k in good if k != 3 and 3 not in links[k])
    true = sum(len(links[k]) for k in good if k != 3 and 3 not in links[k])
    assert true * 0.9 <= found <= true
    assert got[3].n_links >= 1  # its copy
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in set(got) - set(good))
    assert embeddings.near_duplicates(df.limit(0)).isEmpty()


# 2


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    got = pieces.encode(docs, pieces.model_path())
    for r in got.join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).collect():
        assert r.ids == model.encode(r.text or "")
        assert r.round_trip
    back = pieces.decode(got, pieces.model_path())
    assert by_row(back, "doc_id", "text") == by_row(docs.fillna("", ["text"]), "doc_id", "text")
    assert pieces.encode(none, pieces.model_path()).isEmpty()


# 3


def test_quality_rules_count_as_brute_force(docs, rows, none):
    def brute(text):
        words = WORDS.findall(text or "")
        windows = collections.defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        n = len(words)
        return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n

    got = by_row(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert quality_rules.judge(none).isEmpty()
    again = " ".join(f"w{k}" for k in range(60))
    assert brute(f"{again} x {again}")[4] == 120


# 4


def test_language_learns_and_marks_the_unknown(spark, docs, none):
    rng = np.random.default_rng(1)
    stems = {"en": ["the", "ing", "tion", "and"], "de": ["der", "ung", "sch", "ein"], "fr": ["eau", "les", "oux", "que"], "es": ["ado", "los", "ción", "que"]}
    data = [(k, " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(40)), lang) for k, lang in enumerate(list(stems) * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit(df.filter("doc_id < 80"))
    got = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert sum(got[k].lang_pred == lang for k, _, lang in data if k >= 80) >= 38
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !"), (4, "日本")], "doc_id long, text string")
    marked = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert [marked[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert marked[4][0] in stems and 0 <= marked[4][1] <= 1
    assert language.fit(none) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(docs, model).count() == docs.count()


# 5


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(lower))
    if not words:
        return 0
    import xxhash

    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_simhash_components_equal_brute_force(docs, rows, none):
    prints = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(rows))]
    least = {c: min(r[0] for r, x in zip(rows, label) if x == c and r[0] is not None) if any(r[0] is not None for r, x in zip(rows, label) if x == c) else None for c in set(label)}
    expected = collections.Counter((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label))
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.near_duplicates(none).isEmpty()


def test_simhash_finds_every_link_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4, 5)]
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    got = {r.node: r.component for r in components.components(simhash.link(df)).collect()}
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    label = np.arange(len(fps))
    for _ in range(10):
        label = np.array([label[row].min() for row in near])
    mine = np.array([got.get(int(v), int(v)) for v in fps.view(np.int64)])
    assert len(set(zip(label.tolist(), mine.tolist()))) == len(set(label.tolist())) == len(set(mine.tolist()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 6


def test_mixing_meets_its_targets(docs, rows, none):
    by_doc, _ = mixing.mix(docs, block=8, shard_slots=64)
    got = by_doc.collect()
    size = collections.Counter()
    for r in rows:
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) for r in got)
    for s in order:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(target[s], abs=1, rel=0.001)
    assert by_row(mixing.mix(docs.repartition(5), block=8, shard_slots=64)[0], "doc_id", "size", "taken") == by_row(by_doc, "doc_id", "size", "taken")
    assert mixing.mix(none)[0].isEmpty()


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("x")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_the_mixed_corpus_holds_the_taken_words(docs):
    options = {"block": 8, "shard_slots": 64}
    taken = collections.Counter()
    for r in mixing.mix(docs, **options)[0].collect():
        taken[r.doc_id] += r.taken
    mixed, held = mixing.apply_mix(docs, **options), collections.Counter()
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        held[r.doc_id] += len(WORDS.findall(r.text))
    assert held == +taken


# 7


def brute_removal(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"length": 70, "part": 2, "shard_bytes": 500}])
def test_removed_bytes_equal_brute_force(docs, rows, none, options):
    expected = brute_removal([(r[1] or "").encode() for r in rows], options.get("length", 400))
    got = suffix_dedup.count_removed(docs, **options)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == collections.Counter((r[0], *e) for r, e in zip(rows, expected))
    assert suffix_dedup.count_removed(none, **options).isEmpty()


def test_removed_text_stays_text(docs, rows):
    got = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(docs).collect()}
    assert len(got[7]) < len(rows[7][1])
    assert all(t is None or t.encode().decode() == t for t in got.values())


def test_induced_sorting_equals_a_plain_sort():
    rng = np.random.default_rng(8)
    for trial in range(60):
        t = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 150)).astype(np.uint8)
        t = np.concatenate([t, t[: trial % 40], np.full(trial % 30, 97, np.uint8)])
        raw = t.tobytes()
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        for rows_ in (3, 1 << 20):  # 3: nearly everything goes through files
            got = list(induced.sorted_suffixes(t, 20, rows_))
            assert np.concatenate([p for p, _ in got]).tolist() == order
            for a, b, k in zip(order, order[1:], np.concatenate([x for _, x in got])[1:]):
                same = next((j for j in range(20) if raw[a + j : a + j + 1] != raw[b + j : b + j + 1] or b + j >= len(raw)), 20)
                assert k == same


def test_induced_sorting_through_files_equals_that_in_memory():
    """Tens of thousands of symbols with a few hundred tuples in memory: queues, ranks, order and counts go through files."""
    rng = np.random.default_rng(17)
    base = rng.integers(97, 101, 9000).astype(np.uint8)
    text = np.concatenate([base, base[2000:6000], rng.integers(97, 123, 9000).astype(np.uint8), np.tile(base[:7], 150), base])
    for limit in (60, 400):
        plain, filed = (list(induced.sorted_suffixes(text, limit, rows)) for rows in (1 << 20, 700))
        for k in (0, 1):
            assert np.array_equal(np.concatenate([x[k] for x in plain]), np.concatenate([x[k] for x in filed]))
    raw = text.tobytes()
    order = np.concatenate([p for p, _ in plain]).tolist()
    assert order == sorted(range(len(raw)), key=lambda i: raw[i : i + 12000])


def test_a_shard_larger_than_memory_finds_what_a_plain_count_finds(monkeypatch):
    rng = np.random.default_rng(18)
    parts = [rng.integers(97, 105, n).astype(np.uint8).tobytes() for n in rng.integers(450, 900, 40)]
    segments = [*parts, parts[3][:420] + parts[9][-430:], parts[5][20:], parts[0] + parts[1]]
    monkeypatch.setattr(induced, "ROWS", 600)
    monkeypatch.setattr(induced.sorted_suffixes, "__defaults__", (600,))
    seg, at, *_ = suffix_dedup.repeats(segments, 400)
    seen = collections.Counter(s[i : i + 400] for s in segments for i in range(len(s) - 399))
    assert set(zip(seg.tolist(), at.tolist())) == {(k, i) for k, s in enumerate(segments) for i in range(len(s) - 399) if seen[s[i : i + 400]] > 1}


# 8


def test_classifier_separates_and_scores_the_empty(spark, docs, none):
    rng = np.random.default_rng(4)
    data = [(k, prose(rng, 60) if k % 2 else prose(rng, 60).replace(" ", "$$$ ").upper()) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(200)] + [(1, 0, 1), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(df, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    assert all((got[k] >= 0.3) == bool(k % 2) for k in got)
    mean = quality_classifier.score(docs, model).join(docs.filter("doc_id = 38").select("doc_id"), "doc_id").first().score
    assert 0 <= mean <= 1
    assert quality_classifier.learn(df, labels.limit(0)) is None
    assert quality_classifier.score(none, model).isEmpty()
    assert {r.score for r in quality_classifier.score(df, None).collect()} == {1.0}


# 9


def test_language_model_counts_equal_brute_force(spark, docs, rows, none, tmp_path):
    tokens = [WORDS.findall((r[1] or "").translate(lower)) + ["\0"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c, pairs = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
            pairs.update(zip(["\1", *t], t))
    n, v = c.total(), len(c)
    expected = sorted((r[0] or -1, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(rows, tokens))
    docs.write.parquet(str(tmp_path / "d"))
    for df in (docs, spark.read.parquet(str(tmp_path / "d"))):
        got = language_model.score(df, ~fold("doc_id", 7, 2)).collect()
        assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
        assert {r.train_tokens for r in got} == {n}
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(none, F.lit(True)).isEmpty()
    assert {r.score for r in language_model.score(docs, F.lit(False)).collect()} == {0.0}


def test_weights_learn_the_better_estimate():
    cells = np.array([(3 << 20) + 1, (3 << 20) + 2])
    w = language_model.learn_weights(cells, np.array([50.0, 50.0]), np.array([0.5, 0.5]), np.array([40.0, 45.0]), 1e-4)
    assert w[3, 2] > 0.9
    assert np.allclose(w.sum(1), 1)


# 10


def test_token_counts_use_and_fill_the_cache(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    path, cache = P.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    tok = Tokenizer.from_file(path)
    expected = collections.Counter((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    for _ in range(2):
        got = token_counts.count_tokens(docs, path, cache)
        assert by_row(got, "doc_id", "n_bytes", "n_tokens") == expected
        assert all(r.over_limit == (r.n_tokens > 512) for r in got.collect())
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in rows})  # the second run encodes nothing
    assert token_counts.count_tokens(none, path, f"{cache}2").isEmpty()
