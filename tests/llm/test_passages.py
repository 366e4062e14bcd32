"""The pipeline's suffix-array stage: every run of over 50 words that repeats goes, however few its bytes."""

import collections
import hashlib
import re

import numpy as np

from wanderlane.llm import suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def whole_characters(t, gone):
    """A run's ends go inwards to where a character begins."""
    for k in range(len(t)):
        if gone[k] and (k == 0 or not gone[k - 1]):
            while k < len(t) and gone[k] and t[k] & 0xC0 == 0x80:
                gone[k] = False
                k += 1
    for k in range(len(t) - 1, -1, -1):
        if gone[k] and k + 1 < len(t) and not gone[k + 1] and t[k + 1] & 0xC0 == 0x80:
            while gone[k] and t[k] & 0xC0 == 0x80:
                gone[k] = False
                k -= 1
            gone[k] = False


def brute(texts, words, length, whole=False):
    """Each text without the runs of words, and the stretches of bytes, that start anywhere else too. whole: characters of
    which only some bytes repeat stay."""
    spans = [[m.span() for m in WORD.finditer(t)] for t in texts]
    bags = [[t[a:b] for a, b in s] for t, s in zip(texts, spans)]
    seen = collections.Counter(tuple(b[i : i + words]) for b in bags for i in range(len(b) - words + 1))
    held = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t, s, bag in zip(texts, spans, bags):
        gone = np.zeros(len(t), bool)
        for i in range(len(bag) - words + 1):
            if seen[tuple(bag[i : i + words])] > 1:
                gone[s[i][0] : s[i + words - 1][1]] = True
        for i in range(len(t) - length + 1):
            if held[t[i : i + length]] > 1:
                gone[i : i + length] = True
        if whole:
            whole_characters(t, gone)
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode())
    return out


def words(n, seed):
    return " ".join(hashlib.sha256(f"{seed}-{k}".encode()).hexdigest()[: 2 + k % 5] for k in range(n))


def test_runs_of_over_50_words_go_and_shorter_ones_stay(spark):
    import corpus_pipeline

    passage, fifty, long_words = words(51, "p"), words(50, "q"), " ".join(["x" * 60 + str(k) for k in range(8)])
    assert len(passage) < 400 < len(long_words)
    texts = [f"{words(20, 1)} {passage} {words(20, 2)}", f"{words(9, 3)}\n{passage}", f"{fifty} {words(30, 4)}", f"{words(30, 5)} {fifty}", f"{words(30, 6)} {passage.replace(' ', '  ')} {words(5, 7)}",
        f"{words(9, 8)} {long_words}", f"{long_words} {words(9, 9)}", words(300, 10), f"é {words(60, 11)} ü", f"{words(60, 11)[:-1]} à {words(200, 12)}", "short", ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(99, None, None, None, None)], DOC).repartition(3)
    expected = {k: t for k, t in enumerate(brute([t.encode() for t in texts], 51, 400)) if t}
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_repeats(spark, docs, "").collect()}
    assert got == {k: (t, len(t)) for k, t in expected.items()}
    assert passage not in got[0][0] and fifty in got[2][0] and fifty in got[3][0]
