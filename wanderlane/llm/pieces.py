"""SentencePiece encoding and decoding by a forward pass over shared prefixes.

Texts are marked (spaces become the mark, with one in front) and split into units, a run of marks and the characters up to
the next; no piece spans two units. The distinct units of some megabytes of text are sorted, which lays out their trie in
depth-first order: from one unit to the next, the forward states of the common prefix are kept, and only the rest is
computed. A unit's ids are looked up for every further occurrence.

The model file is of the BPE kind, whose result is not the segmentation of the greatest sum of scores. So the state of a
prefix is not a sum but the last piece of the prefix's own encoding: the piece that ends there and is compatible with the
state where it begins, that is, encoding the two pieces' text gives these two pieces. There is one such piece for each
prefix, following the states back gives the encoding, and the ids are those of the sentencepiece library.

Defined results: a null or empty text has no ids; characters outside the vocabulary become byte pieces; decoding gives the
text back unless it holds the mark itself (U+2581), which decodes as a space; a very long text is encoded whole, by one task;
of pairs of equal rank the leftmost is merged first, as the library does; repeated rows keep their rows; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, worker_cache

MARK = "▁"
CHUNK_CHARS = 1 << 21
CACHED_UNITS = 400_000
_TWO = (2, 1)


def shared_prefixes(units: list[str], width: int = 24) -> list[int]:
    """How many characters each unit shares with the one before it, for distinct units."""
    if not units:
        return []
    chars = np.array([u[:width] for u in units], f"U{width}").view(np.uint32).reshape(len(units), width)
    same = chars[1:] == chars[:-1]
    out = [0, *np.where(same.all(1), width, same.argmin(1)).tolist()]
    for k in range(1, len(units)):
        if out[k] == width or "\0" in units[k] or "\0" in units[k - 1]:  # longer than compared, or like the padding
            out[k] = len(os.path.commonprefix((units[k - 1], units[k])))
    return out


class Pieces:
    """The vocabulary of a model file of the BPE kind."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [k for k in range(n) if model.is_control(k) or model.is_unknown(k) or model.is_byte(k)]
        plain = set(range(n)) - set(special)
        self.ids = {model.id_to_piece(k): k for k in sorted(plain)}
        self.rank = {p: -model.get_score(k) for p, k in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded = [b""] * n
        for p, k in self.ids.items():
            self.decoded[k] = p.replace(MARK, " ").encode()
        for b, k in enumerate(self.bytes):
            self.decoded[k] = bytes([b])
        # Pieces that encode as themselves: only these end a prefix.
        self._raws = {p: self._raw(p) for p in self.ids if self.merge(p) == [p]}
        # Lengths of pieces by their last three characters, those of two and one included.
        lengths: dict[str, set[int]] = {}
        for p in self._raws:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {2, 1} if p[-2:] in self._raws else {1}).add(len(p))
        self._sizes = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}
        self.release()

    def merge(self, text: str) -> list[str]:
        """Encoding of a short text from the definition: merge the best adjacent pair, the leftmost of equals, while there is one."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _forget(self) -> None:
        self._pair: dict[str, dict[str, bool]] = {}
        self._first: dict[str, bool] = {}
        self._n_pairs = 0

    def release(self) -> None:
        """Forgets what was learned from texts: a worker that lives on for other work holds the vocabulary alone."""
        self._forget()
        self._units: dict[str, bytes] = {}

    def _raw(self, piece: str) -> bytes:
        """Ids (int32) of a piece, or of the bytes of a character outside the vocabulary."""
        k = self.ids.get(piece)
        return np.array([k] if k is not None else [self.bytes[b] for b in piece.encode()], np.int32).tobytes()

    def encode_sorted(self, units: list[str]) -> list[bytes]:
        """Ids (int32) of units in sorted order: a depth-first walk of their trie."""
        # For each prefix: its last piece, what is known of the pieces that fit behind it, and its ids.
        out, known = [], self._pair
        states, rows, ids = [""], [self._first], [b""]
        raw, sizes_of = self._raws, self._sizes
        for unit, common in zip(units, shared_prefixes(units)):
            del states[common + 1 :], rows[common + 1 :], ids[common + 1 :]
            for end in range(common + 1, len(unit) + 1):
                # Only lengths of pieces with these last characters come into question.
                for size in (sizes_of.get(unit[end - 3 : end]) if end > 2 else None) or _TWO:
                    if size <= end:
                        piece = unit[end - size : end]
                        if piece in raw or size == 1:
                            row = rows[end - size]
                            fits = row.get(piece)
                            if fits is None:
                                last = states[end - size]
                                fits = row[piece] = not last or self.merge(last + piece) == [last, piece]
                                self._n_pairs += 1
                            if fits:
                                states.append(piece)
                                row = known.get(piece)
                                if row is None:
                                    row = known[piece] = {}
                                rows.append(row)
                                ids.append(ids[end - size] + (raw.get(piece) or self._raw(piece)))
                                break
                else:
                    raise AssertionError("a prefix without a state")
            out.append(ids[-1])
        if self._n_pairs > 4 * CACHED_UNITS:
            self._forget()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self._units
        if len(known) > CACHED_UNITS:
            known.clear()
        new = sorted(set().union(*split).difference(known))
        known.update(zip(new, self.encode_sorted(new)))
        return [np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, without the mark in front; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.decoded.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)


def _loaded(path: str) -> Pieces:
    """One vocabulary for all tasks of a worker process."""
    known = worker_cache().setdefault("pieces", {})
    if path not in known:
        known[path] = Pieces(path)
    return known[path]


def _chunks(texts: list[str | None]):
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS or k == len(texts) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


def _encode(path: str):
    def run(batches):
        pieces = _loaded(path)
        try:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for lo, hi in _chunks(texts):
                    ids = pieces.encode(texts[lo:hi])
                    same = [pieces.decode(x) == (t or "") for x, t in zip(ids, texts[lo:hi])]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes), lists, pa.array(same)], ["doc_id", "n_pieces", "ids", "round_trip"])
        finally:
            pieces.release()
            give_back()

    return run


def encode(docs: DataFrame, model: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (decoding gives the text) for each row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_encode(model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text for each row of ids; null ids are an empty text."""

    def run(batches):
        pieces = _loaded(model)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pieces.decode(x) for x in ids], pa.string())], ["doc_id", "text"])

    d = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path())
