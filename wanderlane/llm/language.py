"""Language identification in two levels: the language family first, then one-versus-one linear support vector machines
between the languages of that family.

Features are hashed byte trigrams of the whole text in lower case, with everything that is no letter as one space; counts
are damped by a square root and scaled to length one. Models are trained on the driver from a bounded sample: at most
SAMPLE rows, taken evenly over the languages by a hash of the id; the bound is a parameter. Predictions see the text only.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn from, every row is
`und`; a null lang is never learned; of several texts of an id in a language the least is learned; of families and languages
with equal margins the first by name wins; a very long text is read whole, by one task; repeated rows and ids keep their
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, table
from .vector import LOWER, blocks

WIDTH = 2048
SAMPLE = 3000

#: Families of languages by ISO 639-1 code. Any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur pa gu mr ne",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def trigram_rows(column: pa.Array, width: int = WIDTH):
    """(first row, last row + 1, matrix of unit rows) for each block of a string column; an empty text is a row of zeros."""
    for block in blocks(column):
        data = _FOLD[block.data].astype(np.uint32)
        rows = block.byte_rows
        if len(data) >= 3:
            code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            code = ((code * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(width)
            within = (rows[:-2] == rows[2:]) & ((data[:-2] != 0x20) | (data[1:-1] != 0x20))
            x = np.sqrt(block.counts(code[within].astype(np.int64), rows[:-2][within], width).astype(np.float32))
        else:
            x = np.zeros((block.rows, width), np.float32)
        yield block.lo, block.hi, x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Nesterov's accelerated gradient. y: +1 and -1, weighted to equal mass."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y, rate = y.astype(np.float32), np.float32(1 / (1 / c + 4))
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        g = weight * slack * y * 2
        grad = np.append(v[:-1] / np.float32(c) - g @ x, -g.sum())
        new = v - rate * grad
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Family machines (one against the rest) and, inside each family, one machine for each pair of languages."""
    langs = np.array(langs, object)
    family = np.array([FAMILY.get(v, v) for v in langs], object)
    names = sorted(set(family))
    model = {"families": names, "members": {f: sorted(set(langs[family == f])) for f in names}, "pairs": {}}
    model["family"] = [train_svm(x, np.where(family == f, 1, -1)) for f in names] if len(names) > 1 else []
    for members in model["members"].values():
        for i, a in enumerate(members):
            for b in members[i + 1 :]:
                use = (langs == a) | (langs == b)
                model["pairs"][a, b] = train_svm(x[use], np.where(langs[use] == a, 1, -1))
    return model


def predict(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row: the logistic of the family's margin times that of the closest duel won."""
    sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
    margins = np.stack([x @ w + b for w, b in model["family"]], 1) if model["family"] else np.ones((len(x), 1))
    best, score = margins.argmax(1), sure(margins.max(1))
    lang = np.empty(len(x), object)
    for k, f in enumerate(model["families"]):
        rows, members = np.flatnonzero(best == k), model["members"][f]
        votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
        for i, a in enumerate(members):
            for j, b in enumerate(members[i + 1 :], i + 1):
                w, bias = model["pairs"][a, b]
                m = x[rows] @ w + bias
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        won = (votes + 1e-3 * np.tanh(np.minimum(least, 9))).argmax(1)
        lang[rows] = np.array(members, object)[won]
        duel = least[np.arange(len(rows)), won]
        score[rows] *= np.where(np.isinf(duel), 1, sure(duel))
    return lang, score


def _vectors(batches):
    for batch in batches:
        for lo, hi, x in trigram_rows(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, hi - lo), pa.array([row.tobytes() for row in x], pa.binary())], ["lang", "x"])


def sample(docs: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most bound rows (id, lang, text): the smallest hashes of ids, the same number for each language where there are as many."""
    per_lang = Window.partitionBy("lang").orderBy("mark", "doc_id")
    ids = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("mark"))
    ids = ids.withColumn("n", F.row_number().over(per_lang)).filter(F.col("n") <= bound).orderBy("n", "mark", "lang").limit(bound).select("doc_id", "lang").distinct()
    return docs.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # at most bound rows


def fit(docs: DataFrame, bound: int = SAMPLE) -> dict | None:
    rows = sample(docs, bound).mapInArrow(_vectors, "lang string, x binary").collect()  # at most bound rows of WIDTH floats
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.x))
    return train(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows])


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH floats for each family and pair of languages

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            lang, score = np.full(len(column), "und", object), np.zeros(len(column))
            if model:
                for lo, hi, x in trigram_rows(column):
                    lang[lo:hi], score[lo:hi] = predict(model, x)
                blank = ~pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
                lang[blank], score[blank] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(lang, pa.string()), pa.array(score)], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3, 1)
    model = fit(docs.select("doc_id", "lang", "text").filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
