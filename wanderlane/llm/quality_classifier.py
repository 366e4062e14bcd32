"""Quality by nearest-neighbour voting in a latent semantic space.

Labelled texts become vectors of hashed term weights: byte pairs of the whole text, and three counts of form (words that
repeat the word before, lines equal to the line before, words). A truncated singular value decomposition of a bounded
sample of labelled rows gives the latent space; the sample's latent vectors (SAMPLE rows of RANK floats, whatever the size
of the corpus) are broadcast. Every document is projected and compared with all of them by exact cosine products, block by
block; the labels of its nearest neighbours, weighted by similarity, are its score.

Defined results: an empty or null text, and one of a single byte, gets the labels' mean; with nothing to learn from the score
is 1; labels for ids without a document are ignored, of several labels of an id the largest counts, of several texts of an id
the least; of neighbours at equal similarity any may be taken; a score at the threshold is accepted; a very long text is
scored whole, by one task; repeated rows keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, free_name, table
from .vector import blocks

WIDTH, RANK = 1024, 48
SAMPLE, NEIGHBOURS, THRESHOLD = 4000, 15, 0.3
_COLUMN = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % WIDTH


def term_rows(column: pa.Array):
    """(first row, last row + 1, matrix of unit rows) for each block of a string column."""
    for block in blocks(column):
        data, rows = block.data.astype(np.int64), block.byte_rows
        x = np.zeros((block.rows, WIDTH + 2), np.float32)
        if len(data) > 1:
            within = rows[:-1] == rows[1:]
            x[:, :WIDTH] = np.sqrt(block.counts(_COLUMN[(data[:-1] << 8 | data[1:])[within]], rows[:-1][within], WIDTH))
        h, r = block.word_hashes, block.word_rows
        if len(h):
            words = np.bincount(r, minlength=block.rows)
            repeats = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=block.rows)
            # Words whose window of eight words occurred before in the block: repeated lines and passages.
            again = np.zeros(len(h), bool)
            if len(h) > 8:
                w = np.zeros(len(h) - 7, np.uint64)
                for k in range(8):
                    w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 7 + k]
                w = w + r[: len(w)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                _, first = np.unique(w, return_index=True)
                again[: len(w)] = True
                again[first] = False
                again[len(w) :] = False
            twice = np.bincount(r[again], minlength=block.rows)
            size = np.sqrt((x * x).sum(1))
            x[:, WIDTH] = size * np.sqrt(repeats / np.maximum(words, 1))
            x[:, WIDTH + 1] = size * np.sqrt(twice / np.maximum(words, 1))
        yield block.lo, block.hi, x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _vectors(batches):
    for batch in batches:
        for lo, hi, x in term_rows(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(lo, hi - lo), pa.array([row.tobytes() for row in x], pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, rank: int = RANK) -> dict | None:
    """docs: doc_id, text; labels: doc_id, quality. At most bound labelled rows, by a hash of the id."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most bound rows
    rows = texts.mapInArrow(_vectors, "quality int, x binary").collect()  # at most bound rows of WIDTH floats
    if not rows:
        return None
    rows.sort(key=lambda r: (r.quality, r.x))
    x, y = np.stack([np.frombuffer(r.x, np.float32) for r in rows]), np.array([r.quality for r in rows], np.float32)
    mean = x.mean(0)
    values, basis = np.linalg.eigh((x - mean).T.astype(np.float64) @ (x - mean))  # the right singular vectors
    basis = basis[:, np.argsort(-values)[: min(rank, len(rows))]].astype(np.float32)
    z = (x - mean) @ basis
    return {"mean": mean, "basis": basis, "z": z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), "y": y}


def vote(model: dict, x: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
    out = np.full(len(x), float(model["y"].mean()))
    k = min(neighbours, len(model["y"]))
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        z = (part - model["mean"]) @ model["basis"]
        sims = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)) @ model["z"].T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(part), 1))
        w = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** 4 + 1e-9
        score = (w * model["y"][near]).sum(1) / w.sum(1)
        some = (part != 0).any(1)
        out[lo : lo + block][some] = score[some]
    return np.clip(out, 0, 1)


def _scored(docs: DataFrame, model: dict | None, text_col: str, name: str) -> DataFrame:
    """docs with the score as a last column of that name."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = np.ones(batch.num_rows)
            if shared.value:
                for lo, hi, x in term_rows(batch.column(at)):
                    out[lo:hi] = vote(shared.value, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: dict | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of each row."""
    return _scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "text", "score").select("doc_id", "score")


def keep(docs: DataFrame, model: dict | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is the threshold or more."""
    name = free_name(docs, "score")
    return _scored(docs, model, text_col, name).filter(F.col(name) >= threshold).select(*docs.columns)


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The production model: labels of ids outside the held-out fold."""
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality").filter(~fold("doc_id", 5, 0)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
