"""What the text operators share: word pattern, digests, folds and tables written to the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import drop, shared_dir  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows that are worth a file of their own.
FILE_ROWS = 200_000


def cut(df: DataFrame, what: str = "cut", compression: str = "snappy", most: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: its lineage ends there and any executor can go.

    most: a bound of its rows, if known; a small table is then a few files, whatever the number of shuffle partitions.
    per_file: rows that are worth a file, and a task.
    """
    if most is not None:
        df = df.coalesce(max(1, -(-most // per_file)))
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to differ from df's columns (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain_scan(df: DataFrame, of: str = "") -> bool:
    """Whether df is read from files of that format, with no more than projections and filters: read again, it is the same."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    return bool(df.inputFiles()) and all(re.match(r"\W*(Project|Filter|Relation)\b", x) for x in lines) and lines[-1].rstrip().endswith(of)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column of that name that tells its rows apart, the same whenever the result is read.

    A row of Parquet files is known by its file and its place there; anything else is written out with numbers.
    """
    if plain_scan(docs, "parquet") and "_metadata" not in docs.columns:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(name))
    return cut(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")


def worker_cache() -> dict:
    """What all tasks of a worker process share: functions travel by value, and with them copies of their modules."""
    import sys
    import types

    return sys.modules.setdefault("wanderlane_worker_cache", types.ModuleType("wanderlane_worker_cache")).__dict__


def give_back() -> None:
    """Memory that a worker process no longer uses goes back to the machine, where the C library can do that."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fold(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
