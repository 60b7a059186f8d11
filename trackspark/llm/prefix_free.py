"""Repeated 50-byte strings across documents, by a prefix-free parse of the corpus.

1. Rolling-hash triggers cut every text into phrases. Every 50-byte window chooses one 29-byte
   trigger inside itself: the place of its least 7-byte hash, taken modulo 22 (which samples fewer
   triggers than the least 29-byte hash would). Equal windows choose equal triggers, neighbouring
   windows mostly the same one. The windows of a trigger, with the text they cover, are one
   *phrase*; phrases overlap, and a window belongs to exactly one.
2. The parse is put into order by (trigger, phrase): the dictionary's order. Equal phrases lie side by
   side, and so do different phrases around one trigger. A phrase that occurs in a document with a
   smaller id is covered there as a whole, however often the corpus repeats it.
3. Only a phrase's first document may still share single windows with other phrases of the same
   trigger, at the borders of copied passages. Those windows alone are ordered in the same way.

All steps stream over sorted rows with constant state. Equal phrases or windows inside one batch of
documents are combined before any shuffle, so a passage that a third of all documents share sends a
row for each batch, not for each document. Strings are compared by hashes (64 bits for windows, 64
with 48 of the trigger for phrases).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm import hashing, words
from trackspark.llm.common import texts
from trackspark.session import cut_lineage

WINDOW = 50
SEED_BYTES, MODULUS, TRIGGER = 7, 22, 29  # TRIGGER % MODULUS == SEED_BYTES keeps the choices in order
CHUNK = 1 << 15  # windows hashed at once; places in a chunk fit 16 bits
BATCH_BYTES = 1 << 23  # text whose phrases are combined before the shuffle
BATCH_WINDOWS = 1 << 19  # single windows combined before the shuffle
_LOW = np.uint64(0xFFFF)


def hashes_at(h16: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the 50-byte windows at these places, from the hashes of 16-byte strings."""
    return hashing.pair(hashing.pair(h16[at], h16[at + 16]), hashing.pair(h16[at + 32], h16[at + 34]))


def phrases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(trigger, phrase, first window, windows)`` of each phrase of a text, in order."""
    out = []
    for c in range(0, len(data) - WINDOW + 1, CHUNK):
        h16, h7 = hashing.sixteen_and_seven(data[c : c + CHUNK + WINDOW - 1])
        low = (h7 & ~_LOW) | np.arange(len(h7), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):  # 32 neighbours
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:-12], low[12:])  # the least of the 44 seeds of each window, the first one on a tie
        place = np.arange(len(low))
        chosen = place + ((low & _LOW).astype(np.int64) - place) % MODULUS
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        n = (last - first + 1).astype(np.uint64)
        at = chosen[first]
        phrase = hashing.pair(hashing.pair(hashes_at(h16, first), hashes_at(h16, last)), n)
        out.append((hashing.pair(h16[at], h16[at + TRIGGER - 16]) >> np.uint64(16), phrase, c + first, n.astype(np.int64)))
    if not out:
        e = np.zeros(0, np.uint64)
        return e, e, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


# Rows of both orders: key, item and doc decide the order; place = crc32(text) << 32 | first window.
# The key's low 16 bits hold the windows of the row; 0 marks a stretch already known to be covered,
# whose windows are counted in item.
_ROWS = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("doc", pa.int64()), ("place", pa.int64())])
_ROWS_DDL = "key long, item long, doc long, place long"
_FOUND = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("open", pa.bool_())])
_FOUND_DDL = "doc long, place long, n int, open boolean"


def _runs(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join windows that follow each other in one document."""
    if not len(doc):
        return doc, place, n
    order = np.lexsort((place, doc))
    doc, place, n = doc[order], place[order], n[order]
    start = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + n[:-1])])
    at = np.flatnonzero(start)
    return doc[at], place[at], np.add.reduceat(n, at)


def _combine(key: np.ndarray, item: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Of equal items only the rows of the smallest document stay; the others' windows are covered."""
    order = np.argsort(item, kind="stable")
    k, i, d = key[order], item[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])])) if len(i) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(d, start), np.diff(np.append(start, len(i)))) if len(i) else d
    covered = np.zeros(len(i), bool)
    covered[order] = d > least
    cd, cp, cn = _runs(doc[covered], place[covered], (key[covered] & _LOW).astype(np.int64))
    spread = hashing.mix(cp.astype(np.uint64) ^ hashing.mix(cd.astype(np.uint64))) & ~_LOW
    stay = ~covered
    parts = [
        np.concatenate([key[stay], spread]).view(np.int64),
        np.concatenate([item[stay].view(np.int64), cn]),
        np.concatenate([doc[stay], cd]),
        np.concatenate([place[stay], cp]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(p) for p in parts], schema=_ROWS)


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of the batches in groups of about ``BATCH_BYTES`` of text, ids never null."""
    group, size = [], 0
    for b in batches:
        for doc, text in zip(*b.columns, strict=True):
            if doc.is_valid:
                group.append((doc.as_py(), text.as_py().encode()))
                size += len(group[-1][1])
                if size >= BATCH_BYTES:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to parse rows."""
    for group in _by_size(batches):
        parts = []
        for doc, raw in group:
            if len(raw) < WINDOW:
                continue
            t, p, first, n = phrases(np.frombuffer(raw, np.uint8))
            parts.append(((t << np.uint64(16)) | n.astype(np.uint64), p, np.full(len(t), doc), (_tag(raw) << 32) + first))
        if parts:
            yield _combine(*map(np.concatenate, zip(*parts, strict=True)))


def _tag(raw: bytes) -> int:
    """Tells apart different texts under one id."""
    return zlib.crc32(raw) >> 1


class _Order:
    """Reads rows in (key, item, doc) order; state: the current key's first item, and its open rows."""

    def __init__(self, shift: int):
        self.shift = np.uint64(shift)  # keys are equal when they agree above these bits
        self.key = self.item = self.least = None
        self.many = False  # the key has several items
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first rows while it has one

    def rows(self, b: pa.RecordBatch, with_open: bool) -> pa.RecordBatch:
        full, item, doc, place = (c.to_numpy() for c in b.columns)
        full = full.view(np.uint64)
        n = (full & _LOW).astype(np.int64)
        through = n == 0
        found = [(doc[through], place[through], item[through], np.zeros(through.sum(), bool))]
        keep = ~through
        full, item, doc, place, n = full[keep], item[keep], doc[keep], place[keep], n[keep]
        if len(full):
            key = full >> self.shift
            goes_on = self.key is not None and key[0] == self.key
            new_key = np.concatenate([[not goes_on], key[1:] != key[:-1]])
            new_item = np.concatenate([[not goes_on or (item[0], full[0]) != self.item], (item[1:] != item[:-1]) | (full[1:] != full[:-1])]) | new_key
            at = np.maximum.accumulate(np.where(new_item, np.arange(len(full)), -1))
            least = np.where(at >= 0, doc[np.maximum(at, 0)], self.least if goes_on else 0)
            covered = doc > least
            found.append((doc[covered], place[covered], n[covered], np.zeros(covered.sum(), bool)))
            if with_open:
                group = np.cumsum(new_key) - (0 if goes_on else 1)  # 0: the key that goes on, or the first
                items = np.bincount(group, new_item, group[-1] + 1)
                if goes_on:
                    items[0] += 1 if not self.many else 2
                many = items > 1
                if goes_on and many[0]:
                    found += [(*h, np.ones(len(h[0]), bool)) for h in self.held]
                    self.held = []
                elif not goes_on or group[-1] > 0:
                    self.held = []
                shared = ~covered & many[group]
                found.append((doc[shared], place[shared], n[shared], np.ones(shared.sum(), bool)))
                if not many[-1]:
                    tail = (group == group[-1]) & ~covered
                    self.held.append((doc[tail], place[tail], n[tail]))
                self.many = bool(many[-1])
            self.key, self.item, self.least = key[-1], (item[-1], full[-1]), least[-1]
        out = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip((out[0], out[1], out[2].astype(np.int32), out[3]), _FOUND.types, strict=True)], schema=_FOUND)


def _ordered(rows: DataFrame, shift: int, with_open: bool) -> DataFrame:
    """Covered stretches, and with ``with_open`` the phrases that need a look at single windows."""

    def run(batches):
        order = _Order(shift)
        for b in batches:
            if b.num_rows:
                yield order.rows(b, with_open)

    dealt = rows.repartition(F.shiftrightunsigned("key", shift)).sortWithinPartitions("key", "item", "doc")
    return dealt.mapInArrow(run, _FOUND_DDL)


def _own(column: pa.Array, k: int, tag: int, is_open: bool) -> tuple[np.ndarray, np.ndarray]:
    """First windows and window counts of the stretches of row k."""
    found = column.slice(k, 1).flatten()
    place, n, open_ = (c.to_numpy(zero_copy_only=False) for c in found.flatten())
    own = (place >> 32 == tag) & (open_.astype(bool) == is_open)
    return place[own] & 0xFFFFFFFF, n[own].astype(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with open phrases to rows of single windows."""
    for b in batches:
        parts, size = [], 0
        for k in range(b.num_rows):
            raw = b.column(1)[k].as_py().encode()
            tag = _tag(raw)
            first, n = _own(b.column(2), k, tag, True)
            if len(first):
                at = np.sort(words.ragged(first, n))
                h = np.concatenate([hashes_at(hashing.sixteen_and_seven(np.frombuffer(raw, np.uint8, int(x[-1]) + WINDOW - int(x[0]), int(x[0])))[0], x - x[0]) for x in _near(at)])
                parts.append((h & ~_LOW | np.uint64(1), h, np.full(len(at), b.column(0)[k].as_py()), (tag << 32) + at))
                size += len(at)
            if parts and (size >= BATCH_WINDOWS or k == b.num_rows - 1):
                yield _combine(*map(np.concatenate, zip(*parts, strict=True)))
                parts, size = [], 0


def _near(at: np.ndarray) -> list[np.ndarray]:
    """Ascending places in stretches without wide gaps."""
    return np.split(at, np.flatnonzero(np.diff(at) > 256) + 1)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(raw: bytes, column: pa.Array, k: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what stays."""
    if not column[k].is_valid:
        return 0, 0, raw
    first, n = _own(column, k, _tag(raw), False)
    order = np.argsort(first)
    kept, removed, runs, end = [], 0, 0, 0
    for a, b in zip(first[order].tolist(), (first + n)[order].tolist(), strict=True):
        b += WINDOW - 1
        if a > end or not runs:
            runs += 1
            kept.append(raw[end:a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
    kept.append(raw[end:])
    return removed, runs, b"".join(kept)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for k in range(b.num_rows):
            raw = b.column(1)[k].as_py().encode()
            removed, runs, kept = _cut(raw, b.column(2), k)
            rows.append((b.column(0)[k].as_py(), len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT)


def _with_found(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("place", "n", "open")).alias("found"))  # a document's own
    return docs.join(per_doc, docs["doc_id"] == per_doc["doc"], how).select("doc_id", "text", "found")


def covered_stretches(docs: DataFrame) -> DataFrame:
    """``doc, place, n, open``: stretches of windows that start in a document with a smaller id."""
    found = cut_lineage(_ordered(docs.mapInArrow(_parse, _ROWS_DDL), 16, True), "phrases")
    windows = _with_found(docs, found.filter("open"), "inner").mapInArrow(_windows, _ROWS_DDL)
    single = cut_lineage(_ordered(windows, 16, False), "windows")
    return found.filter("not open").unionByName(single)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row.

    A byte goes when a 50-byte string over it also starts in a row with a smaller id; strings never
    cross rows. A null text is empty; texts under 50 bytes lose nothing; a row with a null id keeps
    everything and takes nothing from others; rows with one id never take from each other, equal
    rows give equal results; other columns are ignored; an empty table gives an empty table.
    """
    docs = texts(df, id_col, text_col)
    return _with_found(docs, covered_stretches(docs), "left").mapInArrow(_results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept``: the remaining bytes themselves (a cut may fall inside a character)."""

    def run(batches):
        for b in batches:
            rows = [(b.column(0)[k].as_py(), _cut(b.column(1)[k].as_py().encode(), b.column(2), k)[2]) for k in range(b.num_rows)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["doc_id", "kept"])

    docs = texts(df, id_col, text_col)
    return _with_found(docs, covered_stretches(docs), "left").mapInArrow(run, "doc_id long, kept binary")
