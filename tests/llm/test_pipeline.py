"""The pipeline's stages, each against what a plain reading of its rule gives on its own input, and on odd tables."""

import collections
import re
from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def component_ids(texts):
    """A label for each text, the same for those linked by fingerprints at most four bits apart."""
    from test_text_operators import brute_fingerprint

    prints = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(6):
        label = [min(label[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
    return label


def test_stages_are_the_ones_asked_for():
    import corpus_pipeline as c

    assert [name for name, _ in c.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "SentencePiece encoding"]


@needs_tables
def test_each_stage_acts_on_what_it_gets(spark, tmp_path):
    import corpus_pipeline as c
    import sentencepiece
    from test_mixing import brute as brute_mix
    from test_passages import brute as brute_passages

    from wanderlane.llm import mixing, pieces

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    schema, before = docs.columns, docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(c.STAGES) - 1 or docs.columns == schema
        after = docs.collect()
        if name.startswith("quality"):
            good, bad = ({r.doc_id for r in before if labels.get(r.doc_id) == q} for q in (1, 0))
            kept = {r.doc_id for r in after}
            assert len(good & kept) >= 0.97 * len(good)
            assert len(bad & kept) < 0.5 * len(bad)
        elif name.startswith("SimHash"):
            label = component_ids([r.text for r in before])
            least = {x: min(r.doc_id for r, y in zip(before, label) if y == x) for x in set(label)}
            assert sorted(r.doc_id for r in after) == sorted(least.values())
        elif name.startswith("suffix"):
            expected = brute_passages([r.text.encode() for r in before], 51, 400, whole=True)
            assert {r.doc_id: r.text for r in after} == {r.doc_id: t for r, t in zip(before, expected) if t}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name.startswith("mixing"):
            taken, _ = brute_mix([(r.doc_id, r.text, r.source) for r in before], block=mixing.BLOCK, shard_slots=mixing.SHARD_SLOTS)
            words = collections.Counter()
            for r in after:
                words[r.doc_id] += len(WORDS.findall(r.text))
            assert words == +collections.Counter({r.doc_id: n for r, n in zip(before, taken)})
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
            assert collections.Counter((r.doc_id, tuple(r.ids)) for r in after) == collections.Counter((r.doc_id, tuple(model.encode(r.text))) for r in before)
            assert all(r.round_trip for r in after)
        before = after


@needs_tables
def test_run_gives_the_last_stage(spark):
    import __spark_entry__ as e

    assert e.queries()["pipeline"](spark, DATA).count() > 0
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in e.queries()}


ODD = "doc_id long, text string, lang string, source string, n_chars int, score double, row long, gone int, spans string, key int, taken int, _text string, _score int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, an id with two texts, texts without words, a long text, and names that stages use."""
    prose = lambda seed, n: " ".join(f"{chr(97 + (seed * 7 + j) % 26)}{(seed * 31 + j * j) % 97}ing" for j in range(n))
    rest = ("en", "s", None, 0.5, 1, 2, "x", 3, 4, "y", 5)
    texts = [(0, prose(0, 90)), (1, prose(1, 80)), (1, prose(2, 85)), (2, prose(3, 70)), (2, prose(3, 70)), (None, prose(4, 60)), (None, prose(5, 66)), (None, prose(5, 66)), (5, None), (6, ""), (7, " \n\t"), (8, prose(6, 9000)), (9, "日本 語 " + prose(7, 40)), (10, prose(1, 80)), (11, "one two")]
    rows = [(d, t, *rest) for d, t in texts] + [(None,) * 13]
    return spark.createDataFrame(rows, ODD).repartition(3)


def stage_named(name):
    import corpus_pipeline as c

    return next(f for n, f in c.STAGES if n.startswith(name))


def labels_dir(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_an_empty_table(spark, odd, tmp_path):
    import corpus_pipeline as c

    d = labels_dir(spark, tmp_path, [])
    for k, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, odd.limit(0), d)
        assert out.count() == 0
        assert k == len(c.STAGES) - 1 or out.columns == odd.columns


def test_quality_stage_on_odd_rows(spark, odd, tmp_path):
    kept = stage_named("quality")(spark, odd, labels_dir(spark, tmp_path, [(k, 1, None) for k in (None, 0, 1, 8, 99)]))
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))  # only good labels: all stay


def test_near_dedup_stage_on_odd_rows(spark, odd):
    rows = odd.collect()
    label = component_ids([r.text for r in rows])
    out = stage_named("SimHash")(spark, odd, "").collect()
    place = lambda r: (r.doc_id is None, r.doc_id or 0)
    expected = [min(place(r) for r, y in zip(rows, label) if y == x) for x in set(label)]
    assert sorted(map(place, out)) == sorted(expected)
    kept = [r.text for r in out]
    assert sorted(component_ids(kept)) == list(range(len(kept)))  # no two of a group, and a row of every group
    assert len(kept) == len(set(label)) and {r.text for r in out} <= {r.text for r in rows}


def test_near_dedup_keeps_a_text_whose_id_another_group_has(spark):
    texts = {(3, "b"): "the quick brown fox jumps over the lazy dog again and again today", (5, "a"): "completely other words stand here for nobody to read or repeat ever", (5, "b"): "the quick brown fox jumps over the lazy dog again and again today"}
    docs = spark.createDataFrame([(d, t, "en", "s", None) for (d, _), t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage_named("SimHash")(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(3, texts[3, "b"]), (5, texts[5, "a"])])


def test_suffix_stage_on_odd_rows(spark, odd):
    from test_passages import brute as brute_passages

    rows = odd.collect()
    expected = brute_passages([(r.text or "").encode() for r in rows], 51, 400, whole=True)
    out = stage_named("suffix")(spark, odd, "")
    assert out.columns == odd.columns
    got = collections.Counter((r.doc_id, r.text, r.n_chars, r.score, r["_text"]) for r in out.collect())
    assert got == collections.Counter((r.doc_id, t, len(t), r.score, r["_text"]) for r, t in zip(rows, expected) if t)


def test_mixing_stage_on_odd_rows(spark, odd):
    from test_mixing import brute as brute_mix

    rows = odd.collect()
    taken, _ = brute_mix([(r.doc_id, r.text, r.source) for r in rows], block=256, shard_slots=1024)
    out = stage_named("mixing")(spark, odd, "")
    assert out.columns == odd.columns
    expected, got = collections.Counter(), collections.Counter()
    for r, n in zip(rows, taken):
        expected[r.doc_id] += n
    for r in out.collect():
        got[r.doc_id] += len(WORDS.findall(r.text))
        assert r.n_chars == len(r.text)
    assert got == +expected


def test_encoding_stage_on_odd_rows(spark, odd):
    import sentencepiece

    from wanderlane.llm import pieces

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = stage_named("SentencePiece")(spark, odd, "").collect()
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out) == collections.Counter((r.doc_id, tuple(model.encode(r.text or ""))) for r in odd.collect())
