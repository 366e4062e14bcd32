"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set where over half of the XXH64 values of the text's shingles have it. Fingerprints, not texts,
are compared, each distinct one once. They are cut into five segments, and there is a table for each pair of segments, with
the values of both as the key (26 bits, so that chance meetings stay rare in large corpora). Of two fingerprints that differ
in at most four bits, either two segments are equal, and they meet in that pair's table; or one segment is equal and each
other differs in one bit: so each fingerprint also looks up, for each segment, the Hamming ball of radius one around the
next segment (only values with a set bit cleared: the other fingerprint looks up the rest). Matches are verified by the
complete distance. Links are thinned to spanning forests where they are found, so a large group of copies costs links in
proportion to its members. Joins are merges, never broadcasts: both sides grow with the input, and a driver has to hold what
is broadcast.

Defined results: texts without words have fingerprint zero and are linked like any other; a null text is empty; a very long
text is hashed whole, by one task; repeated rows and ids keep their rows; rows without an id take part, and component_id is
the least id that is not null; bits set in exactly half of the values are 0; an empty table gives an empty result; other
columns are ignored, whatever their names. keep_one() keeps of each group the row with the least id (rows without an id come
last), of several with that id the one whose text has the least hash, of equal rows any one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import Forest, by_cell, cells, pairs, whole_cells
from .common import cut, drop, free_name, table, with_row_key
from .components import components
from .vector import LOWER, blocks

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each row."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(column), np.uint64)
    for block in blocks(column):
        starts, ends, rows = block.starts, block.ends, block.word_rows
        if not len(starts):
            continue
        # The words of each row joined by single spaces, so that a shingle is a slice.
        sizes = ends - starts
        first = np.cumsum(sizes + 1) - (sizes + 1)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
        text[np.repeat(first, sizes) + at] = LOWER[block.data[np.repeat(starts, sizes) + at]]
        raw, stop = text.tobytes(), first + sizes
        last = np.searchsorted(rows, rows, "right") - 1  # the last word of each word's row
        begin = np.searchsorted(rows, rows, "left")
        index = np.arange(len(rows))
        use = (index + shingle - 1 <= last) | (index == begin)  # fewer words than a shingle: the whole sequence
        to = np.minimum(index + shingle - 1, last)[use]
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(first[use].tolist(), stop[to].tolist())), np.uint64, int(use.sum()))
        bounds = np.append(np.flatnonzero(np.diff(rows[use], prepend=-1)), len(h))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[:-1], axis=0, dtype=np.int32)
        major = ones * 2 > np.diff(bounds)[:, None]
        out[block.lo + rows[use][bounds[:-1]]] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        found = fingerprints(batch.column("text"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def _verify(batches):
    for t, starts in whole_cells(batches, "key"):
        fp = t.column("fp").combine_chunks().to_numpy().view(np.uint64)
        left, right = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("left", "right"))
        forest = Forest(len(fp))
        for a, b in pairs(starts, left, right):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
            forest.add(a[near], b[near])
        a, b = forest.links()
        yield pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def lookups(fp: Column) -> Column:
    """The keys of a fingerprint: array of (key, exact). key: table number, then the values of its two segments."""
    segment = [F.shiftrightunsigned(fp, low).bitwiseAND((1 << bits) - 1) for low, bits in SEGMENTS]
    n, keys = len(SEGMENTS), []

    def key(i: int, j: int, vi: Column, vj: Column, exact: bool) -> Column:
        return F.struct((F.lit((i * n + j) << 32) + F.shiftleft(vi, 16) + vj).alias("key"), F.lit(exact).alias("exact"))

    for i in range(n):
        keys += [key(i, j, segment[i], segment[j], True) for j in range(i + 1, n)]
        j = (i + 1) % n  # the ball of radius one in the next segment
        lo, hi = min(i, j), max(i, j)
        for b in range(SEGMENTS[j][1]):
            cleared = segment[j].bitwiseXOR(1 << b)
            near = key(lo, hi, *((cleared, segment[i]) if lo == j else (segment[i], cleared)), False)
            keys.append(F.when(F.shiftright(segment[j], b).bitwiseAND(1) == 1, near))
    return F.array_compact(F.array(*keys))


def link(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect the same components as all links do."""
    # A fingerprint has up to 42 keys: its rows are few and small, and dealt out anew before they become many.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt.select("fp", F.explode(lookups(F.col("fp"))).alias("k")).select("k.key", "fp", "k.exact")
    # Buckets without two fingerprints, or without one that has this very value, have nothing to verify.
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("exact").alias("some")).filter("lo < hi and some").select("key", "n")
    return by_cell(cells(rows.select("key", "fp"), "key", "fp", sizes), "key", _verify, "a long, b long")


def _classes(prints: DataFrame) -> DataFrame:
    """fp, component_id for each distinct fingerprint (column fp, with doc_id): the least id of its component."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct", most=prints.count())
    n = distinct.count()
    stars = cut(components(link(distinct)), "simhash-components", most=n)
    rooted = distinct.join(stars.hint("shuffle_merge"), distinct.fp == stars.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.join(roots.hint("shuffle_merge"), "root").select("fp", "root", "component_id"), "simhash-classes", most=n)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = cut(texts.mapInArrow(_fingerprint_batches, "doc_id long, fp long"), "simhash")
    return prints.join(_classes(prints).hint("shuffle_merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies. Rows are told apart by a number of their own, not by their ids."""
    row = free_name(docs, "row")
    keyed = with_row_key(docs, row)
    texts = keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    prints = cut(texts.mapInArrow(_fingerprint_batches, f"row {keyed.schema[row].dataType.simpleString()}, doc_id long, mark long, fp long"), "simhash")
    n_rows = prints.count()
    roots = cut(prints.join(_classes(prints).select("fp", "root").hint("shuffle_merge"), "fp").select("root", "row", F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "row").alias("place")), "simhash-roots", most=n_rows)
    first = roots.groupBy("root").agg(F.min("place")["row"].alias("row"))
    gone = cut(roots.select("row").join(first.select("row").hint("shuffle_merge"), "row", "left_anti"), "simhash-gone", most=n_rows)
    drop(prints, roots)
    return keyed.join(gone.withColumnRenamed("row", row).hint("shuffle_merge"), row, "left_anti").select(*docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
