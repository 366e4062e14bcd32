"""Language-model scoring by deleted interpolation.

A token's probability after another mixes bigram and unigram maximum-likelihood estimates and a uniform one; the weights
depend on a bucket of the context's frequency and are learned by expectation-maximisation on held-out counts: every
training token is scored by counts from which it was deleted, gathered in a histogram of bounded size.

Counting is by request and answer. Documents are taken in blocks of whole texts; a block sends its distinct tokens and
bigrams (64-bit hashes, with its own training counts) to the parts that own them by hash range, a part adds up and answers
each block with the corpus counts, and answers meet the block's tokens again. So every n-gram of the corpus is counted,
frequent ones are added up before they travel, and what a task holds is a block or a part, whatever the size of the corpus.
A block is named by the file range and row that it starts at: reading it twice gives the same blocks; input that is not
a plain scan of files is written out first.

Defined results: a null text is empty, one end token; a null id is never held out; repeated rows are counted and scored
each; with nothing to learn from, all counts are 0 and every token has probability 1; a very long text is a block of its own;
sums do not depend on the order of rows, so there are no ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, plain_scan, table
from .vector import Block, blocks, mix64

END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
TEXT, TOKENS, PAIRS, TOTALS = 0, 1, 2, 3
PART_BYTES = 4 << 20
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 4096  # the larger a block, the fewer requests for the same n-gram; some 30 times that in memory
TASK_BYTES = 16 << 20  # input for each task of the two exchanges
FINE = 4  # histogram cells for each factor of two
LEAST = 1e-6  # of the uniform estimate's weight


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes of the narrowest type."""
    import zstandard

    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    a = np.ascontiguousarray(a.astype(kind))
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, kind.itemsize).T)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    size = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw).astype(np.uint64))


def pair_codes(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A number for each bigram of a block, from the numbers of its tokens; the begin of a text is a number of its own."""
    before = np.append(0, at[:-1].astype(np.int64) + 1)
    before[np.cumsum(lens.astype(np.int64))[:-1]] = 0
    return before * (int(at.max()) + 2 if len(at) else 1) + at


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, bigrams, number of tokens of each row): words and an end for each row, and each with the one before."""
    rows, n = block.word_rows, block.rows
    lens = np.bincount(rows, minlength=n) + 1
    last = np.cumsum(lens) - 1
    out = np.empty(int(lens.sum()), np.uint64)
    out[np.arange(len(rows)) + rows] = block.word_hashes
    out[last] = END
    before = np.append(BEGIN, out[:-1])
    before[last[:-1] + 1] = BEGIN
    return out, mix64(before * np.uint64(0x9E3779B97F4A7C15) + out), lens


def _named_blocks(batches):
    """(name, batch, block) for each block; a block's rows come from one file range."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        file, start = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        cuts = [k for k in range(len(file)) if not k or (file[k], start[k]) != (file[k - 1], start[k - 1])] + [len(file)]
        for lo, hi in zip(cuts, cuts[1:]):
            part, place = batch.slice(lo, hi - lo), (file[lo], start[lo])
            for block in blocks(part.column("text"), BLOCK_BYTES, BLOCK_ROWS):
                at = seen.get(place, 0) + block.lo
                name = hashlib.blake2b(repr((place, at)).encode(), digest_size=8).digest()
                yield int.from_bytes(name, "little", signed=True), part.slice(block.lo, block.rows), block
            seen[place] = seen.get(place, 0) + part.num_rows


def _requests(part_bits: int):
    def run(batches):
        for name, batch, block in _named_blocks(batches):
            token, pair, lens = tokens(block)
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), lens)
            for kind, values in ((TOKENS, token), (PAIRS, pair)):
                found, inverse = np.unique(values, return_inverse=True)
                counts = np.bincount(inverse, weights=train, minlength=len(found)).astype(np.int64)
                part = (found >> np.uint64(64 - part_bits)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(found))
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(spans), name)), pa.array(np.full(len(spans), kind, np.int32)), pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([pack_sorted(found[a:b]) for a, b in spans], pa.binary()), pa.array([pack(counts[a:b]) for a, b in spans], pa.binary())],
                    ["block", "kind", "part", "asked", "own"],
                )

    return run


def _grouped(batches, keys: tuple[str, ...]):
    """Lists of rows with equal keys, from rows sorted by them."""
    held, key = [], None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            now = tuple(row[k] for k in keys)
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _answers(batches):
    for rows in _grouped(batches, ("kind", "part")):
        asked = [unpack_sorted(r["asked"]) for r in rows]
        own = np.concatenate([unpack(r["own"]).astype(np.int64) for r in rows])
        found, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, inverse, own)
        answer, at = total[inverse], 0
        out = {"block": [], "kind": [], "part": [], "data": []}
        for r, a in zip(rows, asked):
            for k, v in (("block", r["block"]), ("kind", r["kind"]), ("part", r["part"]), ("data", pack(answer[at : at + len(a)]))):
                out[k].append(v)
            at += len(a)
        if rows[0]["kind"] == TOKENS:
            for k, v in (("block", rows[0]["part"]), ("kind", TOTALS), ("part", rows[0]["part"]), ("data", pack(np.array([total.sum(), (total > 0).sum(), int(total[found == END].sum())])))):
                out[k].append(v)
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def _texts(batches):
    for name, batch, block in _named_blocks(batches):
        token, pair, lens = tokens(block)
        at, number = (np.unique(values, return_inverse=True)[1] for values in (token, pair))
        _, first = np.unique(pair_codes(at, lens), return_index=True)
        one = lambda v, t: pa.array([v], t)
        yield pa.RecordBatch.from_arrays(
            [one(name, pa.int64()), one(TEXT, pa.int32()), one(0, pa.int32()), one(pack(at), pa.binary()), one(pack(number[first]), pa.binary()), one(pack(lens), pa.binary()), pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id")), one(batch.column("train").to_pylist(), pa.list_(pa.bool_()))],
            ["block", "kind", "part", "data", "pairs", "lens", "ids", "train"],
        )


def _counted(id_type: pa.DataType):
    """Blocks with the corpus count of each token and bigram."""
    names = ["kind", "data", "pairs", "lens", "ids", "train"]

    def run(batches):
        for rows in _grouped(batches, ("block", "whole")):
            if rows[0]["kind"] == TOTALS:
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([TOTALS], pa.int32()), pa.array([r["data"]], pa.binary()), *(pa.nulls(1, pa.binary()) for _ in range(2)), pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.bool_()))], names)
                continue
            text, *answers = rows
            if text["kind"] != TEXT:
                raise RuntimeError("a block was not read again as it was")
            of = {k: np.concatenate([unpack(r["data"]) for r in answers if r["kind"] == k]) for k in (TOKENS, PAIRS)}
            at, lens = unpack(text["data"]), unpack(text["lens"])
            number = unpack(text["pairs"])[np.unique(pair_codes(at, lens), return_inverse=True)[1]]  # of the bigram in the request
            count, pair = of[TOKENS][at], of[PAIRS][number]
            yield pa.RecordBatch.from_arrays(
                [pa.array([TEXT], pa.int32()), *(pa.array([pack(v)], pa.binary()) for v in (count, pair, lens)), pa.array([text["ids"]], pa.list_(id_type)), pa.array([text["train"]], pa.list_(pa.bool_()))], names
            )

    return run


def _bucket(n: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole binary logarithm of its count."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _context(count: np.ndarray, lens: np.ndarray, texts: int) -> np.ndarray:
    """The count of the token before each; of the begin of a text, the number of texts."""
    before = np.append(0, count[:-1]).astype(np.int64)
    before[np.append(0, np.cumsum(lens.astype(np.int64))[:-1])] = texts
    return before


def _histogram(n: int, texts: int):
    def cell(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.floor(-FINE * np.log2(np.maximum(p, 1e-300))), 0).astype(np.int64)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = unpack(row["lens"])
                use = np.repeat(np.array(row["train"], bool), lens)
                context, count, pair = (v[use].astype(np.int64) for v in (_context(unpack(row["data"]), lens, texts), unpack(row["data"]), unpack(row["pairs"])))
                p2 = np.where(context > 1, (pair - 1) / np.maximum(context - 1, 1), 0.0)  # counts without this token
                p1 = (count - 1) / max(n - 1, 1)
                key, inverse = np.unique((_bucket(context - 1) * 1024 + cell(p2)) * 1024 + cell(p1), return_inverse=True)
                sums = [np.bincount(inverse, weights=w, minlength=len(key)) for w in (np.ones(len(p1)), p1, p2)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], ["cell", "n", "p1", "p2"])

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, p1: np.ndarray, p2: np.ndarray, p0: float, rounds: int = 60) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each bucket, by expectation-maximisation over cells of equal estimates."""
    out = np.tile([LEAST, 0.5, 0.5], (64, 1))
    out[0] = [0.1, 0.9, 0.0]
    for bucket in np.unique(cells >> 20):
        use = cells >> 20 == bucket
        p = np.stack([np.full(use.sum(), p0), p1[use] / n[use], p2[use] / n[use]], 1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            mixed = p * w
            w = (n[use][:, None] * mixed / mixed.sum(1, keepdims=True)).sum(0) / n[use].sum()
            w = np.maximum(w, [LEAST, 0, 0])
            w /= w.sum()
        out[bucket] = w
    out[0, 2] = 0.0
    out[0] /= out[0].sum()
    return out


def _scores(n: int, v: int, texts: int, weights: np.ndarray, id_type: pa.DataType):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens, count, pair = unpack(row["lens"]).astype(np.int64), unpack(row["data"]).astype(np.float64), unpack(row["pairs"])
                context = _context(count, lens, texts)
                w = weights[_bucket(context)]
                p = w[:, 0] / (v + 1) + w[:, 1] * count / max(n, 1) + w[:, 2] * pair / np.maximum(context, 1)
                if not n:
                    p[:] = 1.0
                first = np.cumsum(lens) - lens
                sums = [np.add.reduceat(x, first) for x in (np.log10((count + 1) / (n + v + 1)), np.log10(p))]
                known = np.add.reduceat((count > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], id_type), pa.array(lens), pa.array(known), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, train, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row. train: boolean column of the rows to learn from."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    files = docs
    if not plain_scan(docs.select(id_col, text_col)):
        files = d = cut(d, "lm-input")
    d = d.select("doc_id", "text", "train", F.input_file_name().alias("file"), F.input_file_block_start().alias("start"))
    kind = d.schema["doc_id"].dataType
    id_type = pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    part_bits = max(3, min(20, (max(size, 1) // PART_BYTES).bit_length()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    ids = f"array<{kind.simpleString()}>"
    asked = d.mapInArrow(_requests(part_bits), "block long, kind int, part int, asked binary, own binary")
    answers = asked.repartition(n, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_answers, "block long, kind int, part int, data binary")
    answers = answers.select("*", *(F.lit(None).cast("binary").alias(c) for c in ("pairs", "lens")), F.lit(None).cast(ids).alias("ids"), F.lit(None).cast("array<boolean>").alias("train"))
    texts = d.mapInArrow(_texts, f"block long, kind int, part int, data binary, pairs binary, lens binary, ids {ids}, train array<boolean>")
    met = texts.unionByName(answers).withColumn("whole", F.col("kind") < TOTALS)
    met = met.repartition(n, "block", "whole").sortWithinPartitions("block", "whole", "kind", "part")
    counted = cut(met.mapInArrow(_counted(id_type), f"kind int, data binary, pairs binary, lens binary, ids {ids}, train array<boolean>"), "lm-counts", "zstd")
    totals = [unpack(bytes(r.data)).astype(np.int64) for r in counted.filter(F.col("kind") == TOTALS).select("data").toLocalIterator()]  # three numbers a part
    n_train, v, begins = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0, 0)
    blocks_ = counted.filter(F.col("kind") == TEXT)
    cells = blocks_.mapInArrow(_histogram(n_train, begins), "cell long, n double, p1 double, p2 double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "p1", "p2")))
    rows = sorted(tuple(r) for r in cells.collect())  # at most a few thousand cells, whatever the corpus
    columns = [np.array(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64), *(np.empty(0) for _ in range(3))]
    weights = learn_weights(*columns, 1 / (v + 1))
    out = blocks_.mapInArrow(_scores(n_train, v, begins, weights, id_type), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7, 2)
    scored = score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
