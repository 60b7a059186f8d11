"""Cost-balanced packing of token sequences.

A sequence's work is estimated as ``linear * tokens + quadratic * tokens**2`` summed over its pieces
(attention stays inside a piece). Pieces go in descending order to the sequence of lowest cost that
still has room for them; what fits nowhere whole is cut to fill the room that is left, again lowest
cost first. Whole windows of a long document are sequences of their own.

Each task packs its own partition in windows of bounded size and carries what does not fill a
sequence into the next window, so nothing is shuffled and every sequence but a partition's last ones
is full. The rest of a partition is cut into sequences whose sizes are powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trackspark.llm.common import map_rows, texts
from trackspark.llm.tokens import default_tokenizer, word_tokens

SEQUENCE = 4096
END_ID = 2
WINDOW_TOKENS = 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
TASK_SHIFT = 40  # sequence_id = task number << 40 | number within the task


def balance(lengths: np.ndarray, n: int, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Fill ``n`` sequences of ``size`` from pieces of at most ``size`` tokens each.

    Returns for each sequence its ``(piece, from, to)`` parts. Equal lengths keep their order, equal
    costs take the lowest sequence number.
    """
    cost, room = np.zeros(n), np.full(n, size)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def put(k: int, s: int, a: int, b: int) -> None:
        out[s].append((k, a, b))
        room[s] -= b - a
        cost[s] += linear * (b - a) + quadratic * (b - a) ** 2

    late = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size_k = int(lengths[k])
        fits = np.where(room >= size_k, cost, np.inf)
        s = int(np.argmin(fits)) if n else 0
        if n and fits[s] < np.inf:
            put(k, s, 0, size_k)
        else:
            late.append(k)
    for k in late:
        at = 0
        while at < lengths[k]:
            free = np.where(room > 0, cost, np.inf)
            s = int(np.argmin(free)) if n else 0
            if not n or free[s] == np.inf:
                break
            take = int(min(room[s], lengths[k] - at))
            put(k, s, at, at + take)
            at += take
    return out


class Packer:
    """Takes the documents of one partition, gives finished pieces."""

    def __init__(self, task: int, size: int, window: int, linear: float, quadratic: float):
        self.next, self.size, self.window = task << TASK_SHIFT, size, window
        self.weights = linear, quadratic
        self.pending: list[tuple] = []  # (doc_id, start, ids as bytes, doc_tokens)
        self.tokens = 0
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step, total, at = 4 * self.size, len(ids) // 4, 0
        while len(ids) - at >= step:
            self.sequence([(doc_id, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            self.pending.append((doc_id, at // 4, ids[at:], total))
            self.tokens += (len(ids) - at) // 4
            if self.tokens >= self.window:
                self.fill()

    def fill(self) -> None:
        """Pack all full sequences; what is left over (less than one) stays pending."""
        n = self.tokens // self.size
        lengths = np.array([len(p[2]) // 4 for p in self.pending], np.int64)
        done = np.zeros(len(lengths), np.int64)
        for parts in balance(lengths, n, self.size, *self.weights):
            cut = []
            for k, a, b in parts:
                doc_id, start, ids, total = self.pending[k]
                cut.append((doc_id, start + a, ids[4 * a : 4 * b], total))
                done[k] += b - a
            self.sequence(cut)
        self.pending = [(d, s + int(a), ids[4 * int(a) :], t) for (d, s, ids, t), a, n in zip(self.pending, done, lengths, strict=True) if a < n]
        self.tokens = int((lengths - done).sum())

    def close(self) -> None:
        """The rest, cut into sequences of descending powers of two."""
        self.fill()
        room, cut = 0, []
        for doc_id, start, ids, total in self.pending:
            at = 0
            while at < len(ids):
                room = room or 1 << (self.tokens.bit_length() - 1)
                take = min(4 * room, len(ids) - at)
                cut.append((doc_id, start + at // 4, ids[at : at + take], total))
                at, room, self.tokens = at + take, room - take // 4, self.tokens - take // 4
                if not room:
                    self.sequence(cut)
                    cut = []
        self.pending = []

    def take(self) -> dict:
        rows, self.rows = self.rows, []
        return dict(zip(_SCHEMA.names, map(list, zip(*rows, strict=True)), strict=True))


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    + [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, tokenizer: str | None = None, window: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """A row for each piece of each document; the pieces of a document cover its ids exactly.

    Every document ends with ``end_id``, so a null or empty text is one piece of one id. Repeated
    rows are packed as often as they occur, null ids stay null, other columns are ignored, an empty
    table gives an empty table. A document larger than a sequence is cut; the memory of a task is one
    window of ids and its longest document. ``size`` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = word_tokens(path)
        p = Packer(TaskContext.get().partitionId(), size, window, linear, quadratic)
        for b in batches:
            for i, (ids, _) in zip(b["doc_id"], enc.encode(b["text"]), strict=True):
                p.add(i, ids + end)
            if p.rows:
                yield p.take()
        p.close()
        if p.rows:
            yield p.take()

    return map_rows(texts(df, id_col, text_col), run, _SCHEMA, _DDL)
