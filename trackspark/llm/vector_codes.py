"""Product-quantised vector codes with memoised grid cells.

Vectors are cut into parts, each part has a small codebook. To assign a part, its coarse grid cell is
hashed. For a cell met for the first time, the entries that can be nearest to *some* point of the
cell's box are found: an entry whose least distance to the box is over another's greatest distance
is nowhere the nearest in it. The cache keeps the entries left, and only those are evaluated exactly for
the parts that fall into the cell. Cells whose hash meets another cell's are told apart by their
coordinates and evaluated over all entries.

A round of the codebook's training is one map with sums in the task (entries x width numbers) and one
small aggregation; the driver holds the codebook only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Cells along the extent of a codebook's entries.
CELLS = 4
#: Cached cells of a part before the cache is emptied (an emptied cell is only computed again).
MOST_CELLS = 200_000
#: Vectors with a component from here on are not coded: their sums would leave Spark's decimals.
LARGEST = 1e20
#: Components within which every distance is exact in 64 bits, whatever the width up to 512.
EXACT, WIDEST = 1 << 25, 512
_EMPTY = np.zeros(0, np.uint64)


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as 64-bit integers, or Python integers where one does not fit."""
    with np.errstate(over="ignore"):
        x = np.floor(values.astype(np.float64) * SCALE)
    if not x.size or np.abs(x).max() < EXACT:
        return x.astype(np.int64)
    return np.array([[math.floor(Fraction(v) * SCALE) for v in row] for row in values.astype(np.float64).tolist()], object).reshape(x.shape)


def _hash(cells: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cells), np.uint64)
    for k in range(cells.shape[1]):
        h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Grid:
    """Nearest entries of one part's codebook (``entries x width`` integers)."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS, most: int = MOST_CELLS):
        self.entries, self.most = entries, most
        self.small = entries.dtype != object and entries.shape[1] <= WIDEST and (not entries.size or np.abs(entries).max() < EXACT)
        extent = int((entries.max(0) - entries.min(0)).max()) if entries.size else 0
        self.shift = max(0, (extent // cells).bit_length() - 1)
        self.clear()

    def clear(self) -> None:
        """Cached cells: hashes in order, coordinates, and for each entry whether it is a candidate."""
        self.hashes, self.cells, self.open = _EMPTY, np.zeros((0, self.entries.shape[1]), np.int64), np.zeros((0, len(self.entries)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries that are not dominated across its box."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
        most = (np.maximum(-below, -above) ** 2).sum(2)  # the farther border of each dimension
        return least <= most.min(1)[:, None]

    def lookup(self, cells: np.ndarray) -> np.ndarray:
        """``candidates`` of each row's cell, through the cache."""
        keys, first, place = np.unique(_hash(cells), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, keys)
        found = np.zeros(len(keys), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == keys[inside]
        if not found.all():
            new = ~found
            fresh = cells[first[new]]
            mask = np.concatenate([self.candidates(fresh[a : a + 4096]) for a in range(0, len(fresh), 4096)])
            if len(self.hashes) + len(fresh) > self.most:
                self.clear()
                return self.candidates_of(cells)
            keep = np.argsort(np.concatenate([self.hashes, keys[new]]), kind="stable")
            self.hashes = np.concatenate([self.hashes, keys[new]])[keep]
            self.cells = np.concatenate([self.cells, fresh])[keep]
            self.open = np.concatenate([self.open, mask])[keep]
            at = np.searchsorted(self.hashes, keys)
        mask = self.open[at][place]
        mask[(self.cells[at][place] != cells).any(1)] = True  # another cell under the same hash
        return mask

    def candidates_of(self, cells: np.ndarray) -> np.ndarray:
        """Without the cache, a stretch at a time."""
        return np.concatenate([self.candidates(cells[a : a + 4096]) for a in range(0, len(cells), 4096)])

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(entry, squared distance)`` of each row, the lower index among equals."""
        if not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.small or values.dtype == object or np.abs(values).max() >= EXACT:
            d = ((values.astype(object)[:, None, :] - self.entries.astype(object)[None]) ** 2).sum(2)
            best = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
            return best, d[np.arange(len(d)), best]
        rows, entries = np.nonzero(self.lookup(values >> self.shift))
        d = ((values[rows] - self.entries[entries]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        least = np.minimum.reduceat(d, starts)
        index = np.where(d == least[rows], entries, len(self.entries))
        return np.minimum.reduceat(index, starts), least


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that can be coded, and their integers."""
    fits = np.flatnonzero(np.diff(column.offsets.to_numpy()) == dim)
    values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(fits), dim)
    within = (np.abs(values) < LARGEST).all(1)
    return fits[within], quantise(values[within])


def _sums(dim: int, books: list[np.ndarray]):
    """For ``mapInArrow``: sums and counts of each entry, once a task."""
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, q = _vectors(batch.column(0), dim)
            for p, grid in enumerate(grids):
                v = q[:, p * width : (p + 1) * width]
                code, _ = grid.nearest(v)
                for e in np.unique(code).tolist():
                    mine = v[code == e]
                    s = total.setdefault((p, e), [0, [0] * width])
                    s[0] += len(mine)
                    s[1] = [a + int(b) for a, b in zip(s[1], mine.sum(0).tolist(), strict=True)]
        rows = [(p, e, k, str(x), n) for (p, e), (n, xs) in total.items() for k, x in enumerate(xs)]
        names = ["part", "entry", "pos", "total", "n"]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, [pa.int32()] * 3 + [pa.string(), pa.int64()], strict=True))})

    return run


def train(vectors: DataFrame, dim: int, first: list[list[int]], parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds``; each round reads the vectors once and returns entries x dim sums."""
    width = dim // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    ddl = "part int, entry int, pos int, total string, n long"
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(dim, [_array(b) for b in books]), ddl)
        exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        for r in sums.groupBy("part", "entry", "pos").agg(exact, F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"]][r["pos"]] = int(r["total"]) // r["n"]
    return [_array(b) for b in books]


def _array(rows: list[list[int]]) -> np.ndarray:
    big = any(abs(x) >= EXACT for r in rows for x in r)
    return np.array(rows, object if big else np.int64).reshape(len(rows), -1)


def book_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def finite(embedding: str) -> Column:
    """A vector without null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(embedding).isNotNull() & ~odd


_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def encode(df: DataFrame, dim: int, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits for each part; nulls for vectors of another length."""
    width = dim // len(books) if books else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b) for b in books]
        for batch in batches:
            fits, q = _vectors(batch.column(2), dim)
            code, error = np.zeros((len(fits), len(grids)), np.uint8), np.zeros(len(fits), np.int64)
            for p, grid in enumerate(grids):
                c, d = grid.nearest(q[:, p * width : (p + 1) * width])
                code[:, p], error = c, error + d
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for k, c, e in zip(fits.tolist(), code, error.tolist(), strict=True):
                codes[k], errors[k] = c.tobytes().hex(), e if e < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema=_CODES)

    return df.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row.

    Rows with a null vector or a null or non-finite component go. The codebooks start from the 16
    smallest ids (null ids last; equal ids in the order of their vectors). All rows should have the
    length of the first of them, a positive multiple of 8; others, all where that is no such multiple,
    and rows with a component of ``LARGEST`` or more stay with a null code and error and count
    nowhere. With fewer than 16 vectors the
    codebooks are shorter. Repeated rows count and stay as often as they stand; equal labels, and null
    labels, share one ``label_error``, null where it or an error leaves 64 bits; other columns are
    ignored; an empty table gives an empty table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).filter(finite("v"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()
    dim = len(first[0]["v"]) if first else 0
    if dim % PARTS:
        dim = 0
    usable = [r["v"] for r in first if dim and len(r["v"]) == dim and max(map(abs, r["v"])) < LARGEST]
    start = [[int(x) for x in quantise(np.array([v]))[0]] for v in usable]
    books = train(rows.select("v"), dim, start) if start else []
    if not books:
        coded = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        coded = encode(rows, dim, books)
    coded = cut_lineage(coded, "codes")
    by_label = coded.groupBy(F.coalesce("label", F.lit("")).alias("l"), F.col("label").isNull().alias("none")).agg(
        F.expr("if(bool_or(code is not null and error is null), null, try_cast(sum(cast(error as decimal(38,0))) as long))").alias("label_error")
    )
    on = (F.coalesce(coded["label"], F.lit("")) == F.col("l")) & (coded["label"].isNull() == F.col("none"))
    return coded.join(by_label, on).select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
