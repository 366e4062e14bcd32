"""Removing repeated substrings: every byte covered by a LENGTH-byte string that starts anywhere else in the corpus.

Each window of LENGTH bytes belongs to one anchor, the 64-byte gram in it with the least hash (the leftmost of equals): equal
windows have equal anchors at equal offsets, so two windows can be equal only under anchors with the same hash. The windows
of one anchor form one stretch of text, its segment. Filters, all exact, decide what is sorted:

* equal texts are one text, known to repeat (by SHA-256), and equal segments one segment, known to repeat (by a digest);
* anchors with a hash of their own have no equal window;
* the offset of the anchor in a window lies in one of SIDES ranges, and with it the window holds a certain stretch of text
  around the anchor, its side. Of the distinct segments under one hash only those that share a side with another are sorted.

These meet in a shard, whose text is sorted by external induced sorting with common prefixes (induced.py), and windows next to
each other with a common prefix of LENGTH are repeats. A hash with very many distinct segments is cut into parts sorted
apart; of these, the distinct windows' digests are then counted across parts.

Texts are written once, bucketed by digest, and read in place for the later joins; what is shuffled besides is anchors,
and the text of segments that are sorted. Tables of the run are in the shared folders.

Defined results: a null text is empty; a text shorter than LENGTH keeps all its bytes; a very long text is searched in pieces
that overlap, and held by one task; repeated rows are separate documents, so long repeated texts lose all their bytes; all
occurrences of a repeated string go, the first as well; an empty table gives an empty result; other columns are ignored by
count_removed() and kept by the others, whatever their names.

remove_passages() also takes out each run of WORDS words that starts anywhere else, however few its bytes: texts in which
CODE hashed bytes stand for each word go through the same search, with windows of WORDS * CODE bytes. White space between
words is of no account. Two words with the same code are taken for one: a chance of 2^-47 for a pair.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, drop, free_name, table, with_row_key
from .induced import sorted_suffixes
from .vector import _MULTIPLIER, _VALUES, blocks, mix64, powers

LENGTH, GRAM = 400, 64
PART = 16384  # distinct segments of one anchor hash that are sorted together, some 10 MB
SHARD_BYTES = 1 << 20  # fits the memory of the sort; a shard is larger only where one part is
BLOCK, PIECE = 1 << 15, 1 << 17  # bytes of short texts, and of a long one, whose anchors are looked for at once
SIDES = 4  # ranges of an anchor's offset in a window
WORDS, CODE = 51, 6  # words of a passage that may not repeat; bytes that stand for a word when passages are looked for
SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
_PLACE = 21  # bits for the place of a gram in a piece, to find the leftmost of equals


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.empty(n, np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
    return powers(n), np.multiply.accumulate(inverse)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, hash, place) of each anchor of texts laid end to end; starts are places in data."""
    n, gram = len(data), min(GRAM, length)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none
    up, down = _both_powers(n + 1)
    sums = np.append(np.uint64(0), np.cumsum(_VALUES[data] * up[:n]))
    h = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - length + 1
    least = np.minimum(least[:m], least[width - size : width - size + m])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    start = np.flatnonzero(np.arange(m) + length <= offsets[rows + 1])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none
    place = (least[start] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (rows[start[1:]] != rows[start[:-1]])))
    last = np.append(first[1:], len(start)) - 1
    return rows[start[first]], start[first], start[last], h[place[first]], place[first]


def _pieces(column: pa.Array, length: int):
    """(row, first start, last start, hash, place) over all rows, places in the row's text; long texts in overlapping pieces."""
    for block in blocks(column, BLOCK):
        if block.rows > 1 or len(block.data) <= PIECE:
            row, *starts, h, place = anchors(block.data, block.offsets, length)
            base = block.offsets[row]
            yield block.lo + row, *(x - base for x in starts), h, place - base
        else:
            for at in range(0, len(block.data), PIECE):
                part = block.data[at : at + PIECE + length - 1]
                row, *starts, h, place = anchors(part, np.array([0, len(part)]), length)
                yield block.lo + row, *(x + at for x in starts), h, place + at


def _anchor_lists(length: int):
    """key, twice and a text's anchors: hash, first start a, and in wide the last start and the place, counted from a."""

    def run(batches):
        for batch in batches:
            found = [np.concatenate(x) for x in zip(*_pieces(batch.column("raw"), length))] or [np.empty(0, np.int64)] * 5
            row, a, b, h, place = found
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), a.astype(np.int32), ((b - a) << 16 | (place - a)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("twice"), *lists], ["key", "twice", "h", "a", "wide"])

    return run


def _side_cuts(length: int) -> list[int]:
    room = length - min(GRAM, length)
    return [room * j // SIDES for j in range(SIDES + 1)]


def _segments(length: int):
    """A row for each segment of a text with a shared anchor, with all its places in the text and hashes of its sides."""
    kinds = {"h": pa.int64(), "key": pa.binary(), "a": pa.int32(), "b": pa.int32(), "seg": pa.binary(), "n": pa.int64(), "spans": SPANS, "sides": pa.list_(pa.int64())}
    cuts, digest = _side_cuts(length), lambda raw, size: hashlib.blake2b(raw, digest_size=size).digest()

    def sides(text: bytes, h: int, a: int, end: int, place: int) -> list[int]:
        out = []
        for j in range(SIDES):
            lo, hi = place - cuts[j], place + length - cuts[j + 1]
            if lo >= a and hi <= end:
                out.append(int.from_bytes(digest(h.to_bytes(8, "little", signed=True) + bytes([j]) + text[lo:hi], 8), "little", signed=True))
        return out

    def run(batches):
        for batch in batches:
            out = {name: [] for name in kinds}
            hits = batch.column("hits")
            ends, fields = hits.offsets.to_pylist(), [x.to_pylist() for x in hits.values.flatten()]
            for key, text, twice, lo, hi in zip(batch.column("key"), batch.column("raw"), batch.column("twice").to_pylist(), ends, ends[1:]):
                text, held = text.as_py(), {}
                for h, a, wide in sorted(zip(*(x[lo:hi] for x in fields)), key=lambda x: x[1]):
                    b = a + (wide >> 16)
                    held.setdefault((h, digest(text[a : b + length], 12)), []).append((a, b, a + (wide & 0xFFFF)))
                for (h, seg), places in held.items():
                    spans = []
                    for a, b, _ in places:
                        if spans and spans[-1]["hi"] + 1 == a:
                            spans[-1]["hi"] = b
                        else:
                            spans.append({"lo": a, "hi": b})
                    a, b, place = places[0]
                    for column, value in zip(out.values(), (h, key.as_py(), a, b, seg, len(places) + int(twice), spans, sides(text, h, a, b + length, place))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds.values())], list(kinds))

    return run


def _cut_segments(length: int, part: int):
    names = ["h", "part", "parts", "seg", "bytes"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches):
        out, size = [[] for _ in names], 0
        for batch in batches:
            for text, wanted in zip(batch.column("raw"), batch.column("wanted")):
                text = text.as_py()
                for s in wanted.as_py():
                    parts = -(-s["segments"] // part)
                    row = s["h"], int.from_bytes(s["seg"][:4], "little") % parts, parts, s["seg"], text[s["a"] : s["b"] + length]
                    for column, value in zip(out, row):
                        column.append(value)
                    size += len(row[4])
                if size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names)
                    out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names)

    return run


def repeats(segments: list[bytes], length: int, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(segment and place of each repeated window, segment and place of a first one of each distinct window of wide segments, text)."""
    sizes = np.array([len(s) for s in segments], np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    raw = b"\xff".join(segments) + b"\xff"  # a byte that UTF-8 has not
    text = np.frombuffer(raw, np.uint8)
    again, before, heads = np.zeros(len(text), bool), -1, []
    for pos, lcp in sorted_suffixes(text, length):
        same = np.flatnonzero(lcp >= length)
        again[pos[same]] = True
        again[np.append(before, pos[:-1])[same]] = True
        before = pos[-1] if len(pos) else before
        if wide is not None:
            heads.append(pos[lcp < length])
    at = np.flatnonzero(again)
    seg = np.searchsorted(first, at, "right") - 1
    inside = at - first[seg] + length <= sizes[seg]  # the others run over a segment's end
    at, seg = at[inside], seg[inside]
    if wide is None:
        return seg, at - first[seg], seg[:0], at[:0], raw
    head = np.sort(np.concatenate(heads)) if heads else at[:0]
    of = np.searchsorted(first, head, "right") - 1
    use = (head - first[of] + length <= sizes[of]) & wide[of]
    return seg, at - first[seg], of[use], head[use], raw


def _find_repeats(length: int, shard_bytes: int):
    names = ["h", "seg", "lo", "hi", "window", "alone"]

    def shard(h: list, parts: list, seg: list, raw: list) -> pa.RecordBatch:
        wide = np.array(parts) > 1
        which, at, of, head, text = repeats(raw, length, wide if wide.any() else None)
        cuts = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
        ends = np.append(cuts[1:], len(at)) - 1 if len(at) else cuts
        marked = np.zeros(len(text), bool)
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        marked[first[which] + at] = True
        n, m = len(cuts), len(head)
        all_of = np.concatenate([which[cuts], of]).astype(np.int64)
        lo, hi = np.concatenate([at[cuts], head - first[of]]), np.concatenate([at[ends], head - first[of]])
        window = [None] * n + [hashlib.blake2b(text[x : x + length], digest_size=16).digest() for x in head.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([h[k] for k in all_of.tolist()], pa.int64()), pa.array([seg[k] for k in all_of.tolist()], pa.binary()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(window, pa.binary()), pa.array(np.append(np.zeros(n, bool), ~marked[head]))],
            names,
        )

    def run(batches):
        h, part, parts, seg, raw, size = [], [], [], [], [], 0
        for batch in batches:
            *cols, text = (batch.column(c) for c in ("h", "part", "parts", "seg", "bytes"))
            for *row, bytes_ in zip(*(c.to_pylist() for c in cols), text):
                row.append(bytes_.as_py())
                if size >= shard_bytes and (row[0], row[1]) != (h[-1], part[-1]):
                    yield shard(h, parts, seg, raw)
                    h, part, parts, seg, raw, size = [], [], [], [], [], 0
                for column, value in zip((h, part, parts, seg, raw), row):
                    column.append(value)
                size += len(row[4])
        if raw:
            yield shard(h, parts, seg, raw)

    return run


def _cut_out(length: int):
    kinds = {"key": pa.binary(), "removed": pa.int64(), "runs": pa.int64(), "kept_sha256": pa.string(), "spans": SPANS}

    def run(batches):
        for batch in batches:
            out = {name: [] for name in kinds}
            for key, text, spans, twice in zip(batch.column("key"), batch.column("raw"), batch.column("spans"), batch.column("twice").to_pylist()):
                text, merged = text.as_py(), []
                for lo, hi in [(0, len(text) - length)] if twice else sorted((s["lo"], s["hi"]) for s in spans.as_py()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi + length)
                    else:
                        merged.append([lo, hi + length])
                digest, at = hashlib.sha256(), 0
                for lo, hi in merged:
                    digest.update(text[at:lo])
                    at = hi
                digest.update(text[at:])
                row = key.as_py(), sum(hi - lo for lo, hi in merged), len(merged), digest.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in merged]
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds.values())], list(kinds))

    return run


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, part: int = PART, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, removed, runs, kept_sha256, spans) of each distinct text that loses bytes; key: 16 bytes of its SHA-256."""
    if not 0 < length <= 1 << 15:
        raise ValueError("length must be 1 to 32768")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = docs.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("raw")).filter(F.octet_length("raw") >= length)
    keyed = raw.select(F.substring(F.unhex(F.sha2("raw", 256)), 1, 16).alias("key"), "raw")
    distinct = keyed.groupBy("key").agg(F.first("raw").alias("raw"), (F.count("*") > 1).alias("twice"))
    name = f"wanderlane_texts_{uuid.uuid4().hex}"
    # The shuffle above deals texts by the same hash as the buckets, so they are written, and later read, in place.
    distinct.write.bucketBy(n, "key").option("compression", "zstd").saveAsTable(name)
    try:
        return _search(spark.table(name), n, length, part, shard_bytes)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _search(texts: DataFrame, n: int, length: int, part: int, shard_bytes: int) -> DataFrame:
    grams = cut(texts.select("key", "raw", "twice").mapInArrow(_anchor_lists(length), "key binary, twice boolean, h array<long>, a array<int>, wide array<int>"), "grams")
    # Written out, so that the join below has two plain sides and a hot hash can be split.
    counts = grams.select(F.explode("h").alias("h"), (1 + F.col("twice").cast("int")).alias("n")).groupBy("h").agg(F.sum("n").alias("n"))
    n_anchors = int(grams.agg(F.coalesce(F.sum(F.size("h")), F.lit(0))).first()[0])
    common = cut(counts.filter("n > 1").select("h"), "common", most=n_anchors)
    places = grams.select("key", F.explode(F.arrays_zip("h", "a", "wide")).alias("g")).select("g.*", "key")
    hits = places.join(common.hint("shuffle_merge"), "h", "left_semi").groupBy("key").agg(F.collect_list(F.struct("h", "a", "wide")).alias("hits"))  # of one text
    shared = cut(texts.join(hits.hint("shuffle_merge"), "key").select("key", "raw", "twice", "hits").mapInArrow(_segments(length), "h long, key binary, a int, b int, seg binary, n long, spans array<struct<lo:int,hi:int>>, sides array<long>"), "anchors")
    drop(grams, common)
    segments = cut(shared.groupBy("h", "seg").agg(F.sum("n").alias("n"), F.min(F.struct("key", "a", "b")).alias("at"), F.first("sides").alias("sides")), "segments", most=shared.count())
    n_segments = segments.count()
    sided = segments.select("h", "seg", F.explode("sides").alias("side"))
    met = cut(sided.groupBy("side").agg(F.count("*").alias("n")).filter("n > 1").select("side"), "sides", most=SIDES * n_segments)
    sorted_ = cut(sided.join(met.hint("shuffle_merge"), "side", "left_semi").select("h", "seg").distinct().join(segments.select("h", "seg", "at").hint("shuffle_merge"), ["h", "seg"]), "sorted", most=n_segments)
    many = sorted_.groupBy("h").agg(F.count("*").alias("segments")).filter(F.col("segments") > part)
    wanted = sorted_.join(many.hint("shuffle_merge"), "h", "left").select("at.key", F.struct("h", "seg", "at.a", "at.b", F.coalesce("segments", F.lit(1)).alias("segments")).alias("s"))
    wanted = wanted.groupBy("key").agg(F.collect_list("s").alias("wanted"))  # of one text
    cuts = texts.select("key", "raw").join(wanted.hint("shuffle_merge"), "key").select("raw", "wanted").mapInArrow(_cut_segments(length, part), "h long, part int, parts int, seg binary, bytes binary")
    dealt = cuts.repartition(n, "h", "part").sortWithinPartitions("h", "part")
    found = cut(dealt.mapInArrow(_find_repeats(length, shard_bytes), "h long, seg binary, lo int, hi int, window binary, alone boolean"), "repeats")
    across = found.filter("window is not null").groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    late = found.filter("alone").join(across.hint("shuffle_merge"), "window", "left_semi").select("h", "seg", "lo", "hi")
    inner = found.filter("window is null").select("h", "seg", "lo", "hi").unionByName(late)
    once = segments.filter("n = 1").select("h", "seg", "at").join(inner.hint("shuffle_merge"), ["h", "seg"]).select("at.key", F.array(F.struct((F.col("at.a") + F.col("lo")).alias("lo"), (F.col("at.a") + F.col("hi")).alias("hi"))).alias("spans"))
    whole = shared.join(segments.filter("n > 1").select("h", "seg").hint("shuffle_merge"), ["h", "seg"], "left_semi").select("key", "spans")
    spans = once.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one text
    hit = texts.join(spans.hint("shuffle_merge"), "key", "left").filter("twice or spans is not null").select("key", "raw", "twice", F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"))
    out = cut(hit.mapInArrow(_cut_out(length), "key binary, removed long, runs long, kept_sha256 string, spans array<struct<lo:int,hi:int>>"), "removed")
    drop(shared, segments, met, sorted_, found)
    return out


def _keyed(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256))


def count_removed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    spans = repeated_spans(docs, text_col, **options).drop("spans")
    rows = docs.select(F.col(id_col).alias("doc_id"), _keyed(text_col).alias("sha"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("key", F.substring("sha", 1, 16)).join(spans.hint("shuffle_merge"), "key", "left")
    return rows.select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("runs", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )


def _without(text: str, found: list) -> str:
    raw, at, kept = text.encode(), 0, []
    for lo, hi in found:
        while lo < len(raw) and raw[lo] & 0xC0 == 0x80:  # a character that is cut stays whole
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        kept.append(raw[at:lo])
        at = max(lo, hi)
    return b"".join([*kept, raw[at:]]).decode()


def _merged(found: list) -> list:
    out = []
    for lo, hi in sorted(found):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _strip(position: int, words: int):
    """The batch without its last column, a struct of two lists of spans (bytes, bytes of word codes), and without those in the text."""
    word = re.compile(WORD.encode())

    def run(batches):
        for batch in batches:
            texts = batch.column(position).to_pylist()
            for k, both in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not both or texts[k] is None:
                    continue
                found = [(s["lo"], s["hi"]) for s in both["spans"] or []]
                if both["passages"]:
                    at = [m.span() for m in word.finditer(texts[k].encode())]
                    for s in both["passages"]:
                        first, end = -(-s["lo"] // CODE), s["hi"] // CODE  # a window may begin or end within a word's code
                        if end - first >= words:
                            found.append((at[first][0], at[end - 1][1]))
                if found:
                    texts[k] = _without(texts[k], _merged(found))
            columns = [pa.array(texts, pa.string()) if k == position else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def _word_codes(block) -> np.ndarray:
    """CODE bytes for each word of a block, none of them 0xFF; some PIECE bytes of text at a time."""
    h, lo, starts, ends = np.empty(len(block.starts), np.uint64), 0, block.starts, block.ends
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        base = starts[lo]
        part = block.data[base : ends[hi - 1]]
        up, down = _both_powers(len(part) + 1)
        sums = np.append(np.uint64(0), np.cumsum(_VALUES[part] * up[: len(part)]))
        h[lo:hi] = mix64((sums[ends[lo:hi] - base] - sums[starts[lo:hi] - base]) * down[starts[lo:hi] - base])
        lo = hi
    codes = h.view(np.uint8).reshape(-1, 8)[:, :CODE]
    return np.where(codes == 0xFF, np.uint8(0), codes)


def _codes(batches):
    """row, and the codes of each text's words."""
    for batch in batches:
        out = []
        for block in blocks(batch.column("text"), BLOCK):
            raw = _word_codes(block).tobytes()
            cuts = CODE * np.searchsorted(block.word_rows, np.arange(block.rows + 1))
            out += [raw[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.binary())], ["row", "codes"])


def _stripped(docs: DataFrame, text_col: str, words: int | None, options: dict) -> DataFrame:
    row, gone = free_name(docs, "row"), free_name(docs, "gone")
    keyed = with_row_key(docs, row)
    texts = keyed.select(F.col(row).alias("row"), F.col(text_col).alias("text"))
    key = lambda c: F.substring(_keyed(c), 1, 16).alias("key")
    nothing = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    # Joins by digest and by row are never broadcasts: spans grow with the corpus, and plans stay the same at every size.
    few = {"most": keyed.count(), "per_file": 20_000}
    spans = repeated_spans(texts, **options)
    found = texts.select("row", key("text")).join(spans.select("key", "spans").hint("shuffle_merge"), "key").select("row", "spans", nothing.alias("passages"))
    first = found = cut(found, "dedup-spans", **few)
    drop(spans)
    if words:
        coded = cut(texts.mapInArrow(_codes, f"row {keyed.schema[row].dataType.simpleString()}, codes binary"), "dedup-codes", "zstd")
        passages = repeated_spans(coded, "codes", **options | {"length": words * CODE})
        more = coded.select("row", key("codes")).join(passages.select("key", F.col("spans").alias("passages")).hint("shuffle_merge"), "key").select("row", nothing.alias("spans"), "passages")
        found = cut(first.unionByName(more).groupBy("row").agg(F.first("spans", True).alias("spans"), F.first("passages", True).alias("passages")), "dedup-spans", **few)
        drop(coded, passages, first)
    found = found.select(F.col("row").alias(row), F.struct("spans", "passages").alias(gone))
    joined = keyed.join(found.hint("shuffle_merge"), row, "left").select(*docs.columns, gone)
    return joined.mapInArrow(_strip(docs.columns.index(text_col), words or 0), docs.schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes taken out of the text; characters of which only some bytes repeat stay."""
    return _stripped(docs, text_col, None, options)


def remove_passages(docs: DataFrame, text_col: str = "text", words: int = WORDS, **options) -> DataFrame:
    """docs as of remove_repeats(), without the runs of that many words that repeat as well."""
    return _stripped(docs, text_col, words, options)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_removed(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select rid, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) as m from (select rid, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) as i from d where length(h) >= {2 * LENGTH})),
dup as (select rid, i from (select rid, i, count(*) over (partition by m) as c from w) where c > 1),
runs as (select rid, i, sum(opens) over (partition by rid order by i) as run from (select rid, i, case when i <= lag(i) over (partition by rid order by i) + {LENGTH} then 0 else 1 end as opens from dup)),
spans as (select rid, min(i) as lo, max(i) + {LENGTH} as hi from runs group by rid, run),
cuts as (select d.rid, lo, hi, substr(h, 2 * coalesce(lag(hi) over (partition by d.rid order by lo), 0) + 1, 2 * (lo - coalesce(lag(hi) over (partition by d.rid order by lo), 0))) as piece from spans join d on d.rid = spans.rid),
sums as (select rid, sum(hi - lo)::bigint as n_removed, count(*) as n_spans, string_agg(piece, '' order by lo) as kept, max(hi) as last from cuts group by rid)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256 from d left join sums on sums.rid = d.rid
"""
