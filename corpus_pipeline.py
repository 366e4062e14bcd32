"""A corpus pipeline of dealt operators: each stage works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns documents again; the last returns their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderlane.llm import mixing, pieces, quality_classifier, simhash, suffix_dedup
from wanderlane.llm.common import fresh_path, table


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as the text has it now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts get the mean label of those it learned from; without labels
    all documents stay; repeated rows are scored each; a score at the threshold is accepted; an empty table stays empty."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that with the least id, as simhash.keep_one() states. Texts without words,
    nulls among them, are one group. Rows are told apart whether or not they have ids, or the same one."""
    return simhash.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat, of over 50 words or of 400 bytes; texts of which nothing is left go, and null
    or empty ones. Every copy of a passage goes, so repeated rows with long texts go. An empty table stays empty."""
    return with_sizes(suffix_dedup.remove_passages(docs).filter(F.length("text") > 0))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to target weights: a row for each use of a document, with the words taken, white space as it was.
    Documents without words, nulls among them, are never taken; a null source is one source; an empty table stays empty."""
    return with_sizes(mixing.apply_mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row: doc_id, n_pieces, ids, round_trip. Null and empty texts have none; repeated rows stay."""
    return pieces.encode(docs, pieces.model_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("suffix-array dedup", remove_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier's vote, fingerprints and pseudorandom permutations are not SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = fresh_path(spark, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
