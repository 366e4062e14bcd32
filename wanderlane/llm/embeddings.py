"""Near-duplicate embeddings by p-stable hashing: floor((a . x + b) / w) with Gaussian a buckets unit vectors by Euclidean
distance, HASHES of them together in each of TABLES tables; cosine in double precision decides every candidate.

Equal vectors are one class (copies are counted, not paired; a class is known by a 128-bit digest). The buckets are found from
hashes alone; only members of buckets with two classes or more get their vector sent along, once for each such bucket. A
pair of classes that meets in several tables is counted in the first: each row carries its buckets in the tables before.
Pairs are counted and thinned to spanning forests where they are found, so links of a large group are never written out. At
cosine 0.9 a pair is found with probability 1 - (1 - p^HASHES)^TABLES, p = 0.82 for w = 2: 0.99; closer pairs with more.

Defined results: a vector that is null, empty, zero, or has null or non-finite components links with nothing, and is kept;
vectors of different length never link; a cosine of exactly 0.9 links; repeated ids are separate vectors; vectors without an
id take part, and the least id that is not null names the component; an empty table gives an empty result; other columns are
ignored, whatever their names; there are no texts here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import Forest, by_cell, cells, pairs, whole_cells
from .common import cut, table
from .components import components
from .vector import mix64

TABLES, HASHES, CELL, COSINE, SEED = 24, 8, 2.0, 0.9, 7


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision, not yet scaled, or None where it can't link."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.values.to_numpy(zero_copy_only=False)
    empty = pc.is_null(column.values).to_numpy(zero_copy_only=False)
    offsets, null = column.offsets.to_numpy(), pc.is_null(column).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for k in range(len(column)):
        v = values[offsets[k] : offsets[k + 1]]
        good = not null[k] and len(v) and not empty[offsets[k] : offsets[k + 1]].any() and np.isfinite(v).all() and v.any()
        out.append(np.ascontiguousarray(v) if good else None)
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def buckets(x: np.ndarray) -> np.ndarray:
    """The bucket of each unit row in each table, as 64-bit hashes."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    a, b = rng.standard_normal((x.shape[1], TABLES * HASHES)), rng.uniform(0, CELL, TABLES * HASHES)
    cells = np.floor((x @ a + b) / CELL).astype(np.int64).astype(np.uint64).reshape(len(x), TABLES, HASHES)
    h = np.full((len(x), TABLES), x.shape[1], np.uint64) + np.arange(TABLES, dtype=np.uint64) * np.uint64(1 << 32)
    for k in range(HASHES):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return h


def _classes(kind: str):
    """Rows with the class of their vector, a digest of its numbers, and the vector as bytes of that kind."""

    def run(batches):
        for batch in batches:
            vectors = unit_rows(batch.column("embedding"))
            ids = [None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in vectors]
            raw = [None if v is None else v.astype(kind).tobytes() for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "raw"])

    return run


def _hashed(kind: str):
    def run(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            keys = np.zeros((len(raw), TABLES), np.int64)
            for size in np.unique(sizes):
                use = np.flatnonzero(sizes == size)
                for part in np.array_split(use, -(-len(use) // 2048)):
                    keys[part] = buckets(scaled(np.stack([np.frombuffer(raw[k], kind).astype(np.float64) for k in part]))).view(np.int64)
            marks = pa.array([row.tobytes() for row in (keys & 0xFFFFFFFF).astype(np.uint32)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, TABLES), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, marks, lists], [*batch.schema.names, "marks", "keys"])

    return run


def _verify(kind: str):
    def run(batches):
        for rows, starts in whole_cells(batches, "key"):
            yield _linked(rows, starts, kind)

    return run


def _linked(rows: pa.Table, starts: np.ndarray, kind: str) -> pa.RecordBatch:
    """Links (a, b, 0) that span what is linked in these cells, and (a, a, n) for the rows that a newly links with."""
    col = {c: rows.column(c).combine_chunks() for c in rows.schema.names}
    num = {c: col[c].to_numpy(zero_copy_only=False) for c in ("t", "cid", "n", "i", "j", "left", "right")}
    raw = col["raw"].to_pylist()
    sizes = np.array([len(r) for r in raw])
    # Of each row only the marks of tables before its own; what pads them is not looked at.
    marks = np.frombuffer(b"".join(m.ljust(4 * TABLES, b"\0") for m in col["marks"].to_pylist()), np.uint32).reshape(-1, TABLES)
    width = np.dtype(kind).itemsize
    x = np.zeros((len(raw), sizes.max() // width))
    for k, r in enumerate(raw):
        x[k, : len(r) // width] = np.frombuffer(r, kind)
    x = scaled(x)
    forest, linked, bare = Forest(len(raw)), np.zeros(len(raw), np.int64), np.arange(TABLES)
    for a, b in pairs(starts, num["left"], num["right"], 1 << 15):
        once = ((num["i"][a] < num["j"][a]) | (a < b)) & (num["cid"][a] != num["cid"][b]) & (sizes[a] == sizes[b])
        a, b = a[once], b[once]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
        a, b = a[near], b[near]
        if len(a):
            met = ((marks[a] == marks[b]) & (bare < num["t"][a][:, None])).any(1)  # counted in an earlier table
            a, b = a[~met], b[~met]
            np.add.at(linked, a, num["n"][b])
            np.add.at(linked, b, num["n"][a])
            forest.add(a, b)
    a, b = forest.links()
    some = np.flatnonzero(linked)
    cid = num["cid"]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([cid[a], cid[some]])), pa.array(np.concatenate([cid[b], cid[some]])), pa.array(np.concatenate([np.zeros(len(a), np.int64), linked[some]]))], ["a", "b", "n"]
    )


def near_duplicates(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    wide = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), wide.alias("embedding"))
    known = cut(rows.mapInArrow(_classes(kind), "vec_id long, digest binary, raw binary"), "vectors")
    grouped = known.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.max("raw").alias("raw"))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n_classes = classes.count()
    hashed = cut(classes.select("cid", "n", "raw").mapInArrow(_hashed(kind), "cid long, n long, raw binary, marks binary, keys array<long>"), "vector-keys")
    placed = cells(hashed.select("cid", F.posexplode("keys").alias("t", "key")), "key", "cid")
    sent = placed.join(hashed.select("cid", "n", "raw", "marks"), "cid").withColumn("marks", F.expr("substring(marks, 1, 4 * t)"))
    found = cut(by_cell(sent, "key", _verify(kind), "a long, b long, n long"), "vector-links")
    stars = cut(components(found.filter("a <> b").select("a", "b")), "vector-components", most=n_classes)
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("others"))
    rooted = classes.select("cid", "digest", "n", "least").join(stars, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(roots, "root").join(counts, F.col("cid") == F.col("a"), "left")
    table = cut(table.select("digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "vector-table", most=n_classes)
    out = known.select("vec_id", "digest").join(table, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Every pair by cosine, and reachability; the buckets find the same links with the probability stated above.
ORACLE_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
good as (select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_max(list_transform(e, lambda x: abs(x))) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) as (select vec_id, vec_id from v union select reach.a, links.b from reach join links on links.a = reach.b),
parts as (select a, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where links.a = vec_id) as n_links, component_id, vec_id = component_id as kept from v join parts on parts.a = vec_id
"""
