"""Sources of few words reach their mixing targets too."""

from wanderlane.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_capped_sources_are_taken_twice_to_the_word(spark):
    sizes = {"a": 127, "b": 1000, "c": 10, "d": 64, "e": 1, "f": 40_000}
    rows = [(k, " ".join(["w"] * n), "en", s, None) for k, (s, n) in enumerate(sizes.items())] + [(9, "  ", "en", "g", None)]
    docs = spark.createDataFrame(rows, DOC)
    got = {r.source: r for r in mixing.mix(docs)[0].collect()}
    for s, n in sizes.items():
        assert got[s].taken <= 2 * n
        assert s == "f" or got[s].taken == got[s].target == 2 * n
    assert abs(got["f"].taken - got["f"].target) <= 64
    assert got["g"].taken == 0
    assert {r.source for r in mixing.apply_mix(docs).collect()} == set(sizes)


def test_a_source_with_a_small_target_gets_it_to_the_word(spark):
    docs = spark.createDataFrame([(0, " ".join(["w"] * 100), "en", "a", None), (1, " ".join(["w"] * 100), "en", "b", None)], DOC)
    got = {r.source: r for r in mixing.mix(docs, weights=(9, 1), share_percent=100, block=100)[0].collect()}
    assert got["b"].target == 20 and got["b"].taken == 20
    assert got["a"].target == got["a"].taken == 180
