"""Token counts through a digest cache: every distinct text is encoded once, ever.

A text's key is (digest of its normalised content, digest of the tokenizer file). Normalising means null becomes empty;
anything more would change the counts. Keys found in the cache are joined; the distinct misses are encoded and appended.

Defined results: null or empty text has 0 tokens and 0 bytes; repeated rows and ids each keep their row, and of several stored
counts of a digest (two writers at once) the greatest is taken; other columns are ignored; an empty table gives an empty
result; a very long text is encoded whole, by one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, table, worker_cache

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
BATCH_CHARS = 1 << 18


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _encoder(path: str):
    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        # One tokenizer for all tasks of a worker process: loading one for each leaves memory behind.
        loaded = worker_cache().setdefault("tokenizers", {})
        if path not in loaded:
            loaded[path] = tokenizers.Tokenizer.from_file(path)
            loaded[path].no_truncation()
            loaded[path].no_padding()
        tok = loaded[path]
        for batch in batches:
            texts, counts, start, size = batch.column("text").to_pylist(), [], 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_CHARS or k == len(texts) - 1:
                    counts += [len(e) for e in tok.encode_batch_fast(texts[start : k + 1], add_special_tokens=False)]
                    start, size = k + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def _read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The entries of this tokenizer version; an absent folder is an empty cache."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == version)


def _with_digest(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("digest", F.unhex(F.sha2("text", 256)))


def fill_cache(texts: DataFrame, tokenizer: str, cache: str) -> None:
    """Encode those of the texts (digest, text) that the cache does not have, and append their counts."""
    version = tokenizer_version(tokenizer)
    distinct = texts.select("digest", "text").dropDuplicates(["digest"])  # partial aggregation: copies go before the shuffle
    misses = distinct.join(_read_cache(texts.sparkSession, cache, version).select("digest"), "digest", "left_anti")
    new = misses.mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
    new.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, batches: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row of docs. cache: a folder that all machines see; it is created or appended
    to. batches: parts of the rows (by a hash of the id) that are done one after the other; what one has stored, the next finds."""
    spark = docs.sparkSession
    texts = _with_digest(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    for k in range(batches):
        fill_cache(texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else texts, tokenizer, cache)
    keyed = texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # Two writers may both have added a key. Written out, the join reads plain tables, and a hot digest can be split.
    stored = _read_cache(spark, cache, tokenizer_version(tokenizer)).join(keyed.select("digest").distinct(), "digest", "left_semi")
    known = cut(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return keyed.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches over a cache of this run: the second encodes what the first has not stored."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"), batches=2)
