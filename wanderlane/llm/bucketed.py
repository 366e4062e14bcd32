"""Comparing the members of buckets, whatever their sizes, in bounded tasks.

Small buckets are compared many at a time in vectorised form. A bucket of more than SPLIT members on a side is cut into
sides of about SPLIT: each member goes to every pair of sides that its own side is part of, so all pairs of members still
meet exactly once, and no task holds more than two sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = 2048


def side(member: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(member, F.lit("side")), n)


def cells(rows: DataFrame, key: str, member: str, sizes: DataFrame | None = None) -> DataFrame:
    """rows with columns i, j, left, right: cells in which all pairs of a bucket's members meet once, left against right.

    In a cell (i, i) a row is on both sides; in a cell i < j it is on one. sizes: (key, n) of the buckets to compare; if
    not given, all of two members or more.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1") if sizes is None else sizes
    sizes = sizes.select(key, F.ceil(F.col("n") / SPLIT).alias("_k"))
    own = rows.join(sizes.hint("shuffle_merge"), key)  # never a broadcast: sizes grow with the input
    own = own.withColumn("_s", side(F.col(member), F.col("_k")))
    out = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    return out.select(*rows.columns, F.least("_s", "_o").alias("i"), F.greatest("_s", "_o").alias("j"), (F.col("_s") <= F.col("_o")).alias("left"), (F.col("_s") >= F.col("_o")).alias("right"))


def by_cell(cells: DataFrame, key: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run work over the cells, each whole in one task, with its rows next to each other."""
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j")
    return dealt.mapInArrow(work, schema)


def whole_cells(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each cell begins and the end): every cell is whole in one of them."""
    rest: list[pa.Table] = []

    def bounds(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in (key, "i", "j")]
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.concat_tables([*rest, pa.Table.from_batches([batch])])
        b = bounds(t)
        if len(b) > 2:
            yield t.slice(0, b[-2]), b[:-1]
        rest = [t.slice(b[-2])]
    if rest:
        t = pa.concat_tables(rest)
        yield t, bounds(t)


def pairs(starts: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left rows, right rows): all pairs of a left and a right row of each cell, about limit pairs at a time."""
    cell = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    l_rows, r_rows = np.flatnonzero(left), np.flatnonzero(right)
    r_first = np.searchsorted(cell[r_rows], np.arange(len(starts)))  # of each cell in r_rows
    many = np.diff(r_first)[cell[l_rows]]
    total = np.cumsum(many)
    lo = 0
    while lo < len(l_rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
        n = many[lo:hi]
        a = np.repeat(l_rows[lo:hi], n)
        at = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        yield a, r_rows[np.repeat(r_first[cell[l_rows[lo:hi]]], n) + at]
        lo = hi


class Forest:
    """Links thinned to a spanning forest: keeps a link only if it joins two trees so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Minimum labels, by hooking and pointer jumping, until the links change nothing."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            hi, lo = np.maximum(la, lb)[apart], np.minimum(la, lb)[apart]
            np.minimum.at(self.label, hi, lo)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]
