"""Run-length masks: Arrow UDFs over the compressed string form.

A mask is a column-major sequence of run lengths (background first), written as printable
characters of five bits each. All functions work on whole Arrow batches: geometry
needs no shuffle and no pixel ever becomes a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- codec ------------------------------------------------------------------------------


def encode_runs(runs) -> str:
    """Run lengths to characters: from the fourth run on, the difference to two runs before."""
    x = np.asarray(runs, dtype=np.int64).copy()
    x[3:] -= np.asarray(runs, dtype=np.int64)[1:-2]
    out = []
    for value in x.tolist():
        while True:
            bits = value & 31
            value >>= 5
            done = value == (-1 if bits & 16 else 0)
            out.append(chr((bits if done else bits | 32) + 48))
            if done:
                break
    return "".join(out)


def decode_runs(text: str | bytes) -> np.ndarray:
    raw = text if isinstance(text, bytes) else text.encode("ascii")
    c = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) - 48
    last = np.flatnonzero((c & 32) == 0)
    if len(last) == 0:
        return np.zeros(0, dtype=np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(c)) - np.repeat(first, last - first + 1)
    x = np.add.reduceat((c & 31) << (5 * place), first)
    x -= np.where(c[last] & 16, np.int64(1) << (5 * (last - first + 1)), 0)
    x[1::2] = np.cumsum(x[1::2])
    x[2::2] = np.cumsum(x[2::2])
    return x


def segments(runs: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Foreground as vertical segments ``x, y0, y1`` (end exclusive), in pixel order."""
    ends = np.cumsum(runs)[1::2]
    n = runs[1::2][: len(ends)]
    starts, ends = (ends - n)[n > 0], ends[n > 0]
    x0, x1 = starts // height, (ends - 1) // height
    k = x1 - x0 + 1
    x = np.repeat(x0, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    lo = np.maximum(np.repeat(starts, k) - x * height, 0)
    hi = np.minimum(np.repeat(ends, k) - x * height, height)
    return x, lo, hi


# --- whole batches ----------------------------------------------------------------------


def _within(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that start over at each index of ``first``."""
    if not len(values):
        return values
    total = np.cumsum(values)
    sizes = np.diff(np.append(first, len(values)))
    return total - np.repeat((total - values)[first], sizes)


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(owner, prepend=-1))


def _stored(counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, how many of them each mask has)`` of a column of compressed masks, as they are written."""
    counts = counts.cast(pa.large_binary())
    ends = np.frombuffer(counts.buffers()[1], np.int64)[counts.offset : counts.offset + len(counts) + 1]
    c = np.frombuffer(counts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] - np.uint8(48)
    last = np.flatnonzero((c & 32) == 0)
    sizes = np.diff(np.searchsorted(last, ends - ends[0]))
    top = c[last].astype(np.int64)
    x = (top & 15) - (top & 16)
    # Most numbers have one character; the others take in one more each round.
    length = np.diff(last, prepend=-1)
    at, step = np.flatnonzero(length > 1), 1
    while len(at):
        x[at] = x[at] << 5 | (c[last[at] - step] & 31)
        step += 1
        at = at[length[at] > step]
    return x, sizes


def _paired(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs but a mask's first one: rows of a run inside and the one outside behind it (0 where none is), the
    mask's first row and its number of rows. Each is stored as the difference to two runs before."""
    some = sizes > 0
    body = np.ones(len(x), bool)
    body[(np.cumsum(sizes) - sizes)[some]] = False
    n = np.maximum(sizes - 1, 0)
    rows = (n + 1) // 2
    first = np.cumsum(rows) - rows
    cells = np.zeros(2 * int(rows.sum()), np.int64)
    cells[np.arange(int(n.sum())) + np.repeat(2 * first - (np.cumsum(n) - n), n)] = x[body]
    out = cells.reshape(-1, 2).cumsum(0)
    has = rows > 0
    before = out[first[has]] - cells.reshape(-1, 2)[first[has]]
    out -= np.repeat(before, rows[has], 0)
    out.ravel()[(2 * first + n)[n % 2 == 1]] = 0
    return out, first, rows


def decode_batch(counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(runs, mask of each run)`` of a column of compressed masks; nulls and empty strings have none."""
    x, sizes = _stored(counts)
    paired, first, _ = _paired(x, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    late = np.flatnonzero(k > 0)
    x[late] = paired.ravel()[2 * first[owner[late]] + k[late] - 1]
    return x, owner


def ranges(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Foreground of a column of compressed masks as pixel ranges ``mask, start, end`` in order."""
    x, sizes = _stored(counts)
    paired, first, rows = _paired(x, sizes)
    has = rows > 0
    both = paired[:, 0] + paired[:, 1]
    ends = np.cumsum(both)
    lead = x[(np.cumsum(sizes) - sizes)[has]] - (ends - both)[first[has]]
    starts = ends - both + np.repeat(lead, rows[has])
    on = np.flatnonzero(paired[:, 0] > 0)
    owner = np.repeat(np.arange(len(sizes)), rows)
    return owner[on], starts[on], starts[on] + paired[on, 0]


def encode_batch(runs: pa.Array) -> pa.Array:
    """A column of run lengths as compressed masks; nulls stay."""
    known = runs.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = runs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    k = np.arange(len(x)) - np.repeat(ends - sizes, sizes)
    late = np.flatnonzero(k > 2)
    v = x.copy()
    v[late] -= x[late - 2]
    # As many groups of five bits as hold the value and its sign.
    n = np.ones(len(v), np.int64)
    bound = 16
    while (more := (v < -bound) | (v >= bound)).any():
        n += more
        bound <<= 5
    stop = np.cumsum(n)
    text = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    for i in range(int(n.max(initial=0))):
        at = np.flatnonzero(n > i)
        text[stop[at] - n[at] + i] = (v[at] >> (5 * i) & 31) + np.where(n[at] > i + 1, 80, 48)
    offsets = np.append(0, stop)[np.append(0, ends)]
    bitmap = pa.array(known).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(runs), [bitmap, pa.py_buffer(offsets), pa.py_buffer(text)]).cast(pa.string())


def encode_rectangles(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, height: int, width: int) -> pa.Array:
    """Compressed masks of rectangles of pixels: column after column only differences of 0 are written."""
    wide = w > 1
    start, tail = x * height + y, width * height - (x + w - 1) * height - y - h
    # start, h, then height - h and the columns between, then the rest; a single column has start, h and the rest.
    head = np.stack([start, h, np.where(wide, height - h, tail)], 1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(x) + 1, 3, dtype=np.int32)), pa.array(head.ravel()))
    ends = pa.array(np.append(0, np.cumsum(wide)).astype(np.int32))
    last = pa.ListArray.from_arrays(ends, pa.array((tail - (height - h))[wide]))
    zeros = pc.binary_repeat(pa.scalar("0"), pa.array(np.where(wide, 2 * w - 3, 0)))
    return pc.binary_join_element_wise(encode_batch(lists), zeros, encode_batch(last), "")


def intervals(runs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Foreground of a batch as pixel ranges ``mask, start, end`` in order."""
    begins = _starts(owner)
    ends = _within(runs, begins)
    k = np.arange(len(runs)) - np.repeat(begins, np.diff(np.append(begins, len(runs))))
    on = np.flatnonzero((k % 2 == 1) & (runs > 0))
    return owner[on], ends[on] - runs[on], ends[on]


def columns_of(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pixel ranges as vertical segments ``mask, x, y0, y1``; ``height`` is that of each mask."""
    h = height[owner]
    x0, x1 = starts // h, (ends - 1) // h
    k = x1 - x0 + 1
    if len(k) and k.max() == 1:  # no range goes on in a second column
        return owner, x0, starts - x0 * h, ends - x0 * h
    mask, h = np.repeat(owner, k), np.repeat(h, k)
    x = np.repeat(x0, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    return mask, x, np.maximum(np.repeat(starts, k) - x * h, 0), np.minimum(np.repeat(ends, k) - x * h, h)


def _corners(mask: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Area under the lower hull of each mask's points, which stand in order of (mask, x).

    Points on or above the line through their neighbours are no corners; in every mask all of them
    are dropped at once until none is left.
    """
    n = int(mask[-1]) + 1
    while True:
        inner = (mask[2:] == mask[:-2]) if len(mask) > 2 else np.zeros(0, bool)
        turn = (x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) - (y[1:-1] - y[:-2]) * (x[2:] - x[:-2])
        drop = np.flatnonzero(inner & (turn <= 0)) + 1
        if not len(drop):
            break
        keep = np.ones(len(mask), bool)
        keep[drop] = False
        mask, x, y = mask[keep], x[keep], y[keep]
    same = mask[1:] == mask[:-1]
    return np.bincount(mask[1:][same], ((y[1:] + y[:-1]) * np.diff(x) / 2)[same], n)


def _second_moments(x, y0, y1, n, first, own, area) -> tuple[np.ndarray, ...]:
    """Centre and second moments of each mask; coordinates count from its corner, so that sums stay small."""
    add = lambda v: np.add.reduceat(v, first)
    mid = (y0.astype(float) + (y1 - 1)) / 2
    cx, cy = add(x * n) / area, add(n * mid) / area
    mid, dx = mid - cy[own], x - cx[own]
    return cx, cy, add(n * dx**2) / area, add(n * mid**2 + n * (n**2 - 1) / 12) / area, add(dx * mid * n) / area


def _extents(x: np.ndarray, y0: np.ndarray, y1: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.stack([x[first], np.minimum.reduceat(y0, first), np.maximum.reduceat(x, first), np.maximum.reduceat(y1, first) - 1], 1)


def shapes(counts: pa.Array, height: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of ``GEOMETRY`` and the box of each mask with pixels, by ``mask`` (its row)."""
    owner, x, y0, y1 = columns_of(*ranges(counts), height)
    if not len(owner):
        return {"mask": owner}
    first = _starts(owner)
    rows = owner[first]
    own = np.cumsum(np.diff(owner, prepend=owner[0]) != 0)  # masks counted from 0
    add = lambda v: np.add.reduceat(v, first)
    n = (y1 - y0).astype(float)
    xs, base = x - x[first][own], np.minimum.reduceat(y0, first)
    area = add(n)
    cx, cy, m20, m02, m11 = _second_moments(xs, y0 - base[own], y1 - base[own], n, first, own, area)
    spread = np.sqrt((m20 - m02) ** 2 + 4 * m11**2)
    major, minor = (m20 + m02 + spread) / 2, np.maximum((m20 + m02 - spread) / 2, 0.0)
    at = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(x, prepend=x[0] - 1) != 0))
    columns, mask = x[at].astype(float), own[at]
    hull = -_corners(mask, columns, -np.maximum.reduceat(y1 - 1, at).astype(float)) - _corners(mask, columns, np.minimum.reduceat(y0, at).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "mask": rows,
            "mask_area": area,
            "centroid_x": cx + x[first],
            "centroid_y": cy + base,
            "elongation": np.where(minor > 0, np.sqrt(major / minor), np.nan),
            "orientation": 0.5 * np.arctan2(2 * m11, m20 - m02),
            "solidity": np.where(hull > 0, area / hull, np.nan),
            "eccentricity": np.where(major > 0, np.sqrt(1 - minor / major), np.nan),
            "box": _extents(x, y0, y1, first),
        }


def centres(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels and centroid of each mask from its pixel ranges; NaN without pixels."""
    n = len(height)
    area = np.bincount(owner, ends - starts, minlength=n)
    cx, cy = np.full(n, np.nan), np.full(n, np.nan)
    mask, x, y0, y1 = columns_of(owner, starts, ends, height)
    if len(mask):
        first = _starts(mask)
        rows = mask[first]
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(mask))))
        base = np.minimum.reduceat(y0, first)
        size = y1 - y0
        add = lambda v: np.add.reduceat(v, first)
        # Twice the sums, which are whole, from the corner of the mask.
        across, down = add(2 * (x - x[first][own]) * size), add((y0 + y1 - 1 - 2 * base[own]) * size)
        cx[rows] = across / 2 / area[rows] + x[first]
        cy[rows] = down / 2 / area[rows] + base
    return area, cx, cy


def _meetings(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every two pixel ranges of a frame that share pixels: the masks ``a < b`` and how many.

    One sweep for all masks of all frames: pixel ranges are ordered by their starts, and each meets those
    that start before it ends. ``frame`` is the frame of each mask, ascending.
    """
    far = int(ends.max()) + 1 if len(ends) else 1
    at = frame[owner] * far
    lo, hi = at + starts, at + ends
    order = np.argsort(lo, kind="stable")
    owner, lo, hi = owner[order], lo[order], hi[order]
    met = np.searchsorted(lo, hi, "left") - np.arange(len(lo)) - 1
    i = np.repeat(np.arange(len(lo)), met)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(met) - met, met)
    n = np.minimum(hi[i], hi[j]) - lo[j]
    return np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j]), n


def shared_pixels(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, frame: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Common pixels of the given pairs of masks, which stand in order of (``first``, ``second``)."""
    total = np.zeros(len(first), np.int64)
    if not len(first):
        return total
    a, b, n = _meetings(owner, starts, ends, frame)
    keys, asked = first * len(frame) + second, a * len(frame) + b
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[at] == asked
    return np.bincount(at[hit], n[hit], minlength=len(keys)).astype(np.int64)


def overlaps(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray, frame: np.ndarray) -> dict[str, np.ndarray]:
    """Common pixels of the masks of a frame: ``a < b`` (masks) and ``n``, for pairs that share any."""
    a, b, n = _meetings(owner, starts, ends, frame)
    size = len(frame)
    keys, place = np.unique(a * size + b, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, n)
    return {"a": keys // size, "b": keys % size, "n": total}


# --- geometry ---------------------------------------------------------------------------


_FIELDS = [
    "mask_area",
    "centroid_x",
    "centroid_y",
    "elongation",
    "orientation",
    "solidity",
    "eccentricity",
]
INTS = T.ArrayType(T.IntegerType())
POINTS = T.ArrayType(INTS)
GEOMETRY = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in _FIELDS] + [T.StructField("box", INTS)]
)
PAIRS = T.ArrayType(
    T.StructType([T.StructField(c, T.LongType()) for c in ("ia", "ib", "inter", "area_a", "area_b")])
)


def _pick(runs: np.ndarray, height: int, ranks: np.ndarray) -> list[list[int]]:
    """Pixels at the given positions of the (x, y) order."""
    x, y0, y1 = segments(runs, height)
    upto = np.cumsum(y1 - y0)
    at = np.searchsorted(upto, ranks, side="right")
    y = y0[at] + ranks - (upto[at] - (y1 - y0)[at])
    return [[int(p), int(q)] for p, q in zip(x[at], y)]


def pixels_at(counts: pa.Array, height: np.ndarray, num_points: int) -> np.ndarray:
    """Per mask ``num_points`` pixels ``x, y``, evenly spaced in the (x, y) order; zeros without pixels."""
    owner, starts, ends = ranges(counts)
    n = np.zeros(len(counts), np.int64)
    np.add.at(n, owner, ends - starts)
    upto, some = np.cumsum(ends - starts), np.flatnonzero(n)
    rank = np.arange(num_points) * (n[some, None] - 1) // (num_points - 1)
    rank += (np.cumsum(n) - n)[some, None]
    at = np.searchsorted(upto, rank, side="right")
    pixel = ends[at] - (upto[at] - rank)
    out = np.zeros((len(counts), num_points, 2), np.int32)
    out[some] = np.stack([pixel // height[some, None], pixel % height[some, None]], 2)
    return out


def thirds(counts: pa.Array, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, pixels of its three equal parts along the major axis)``; tiny masks are left out.

    A column's pixels are in the order of the axis or against it, so those beyond a cut are counted from
    where the cut crosses the column; no pixel is listed.
    """
    owner, x, y0, y1 = columns_of(*ranges(counts), height)
    area = np.bincount(owner, y1 - y0, len(counts))
    big = area[owner] >= 10
    owner, x, y0, y1 = owner[big], x[big], y0[big], y1[big]
    if not len(owner):
        return owner, np.zeros((0, 3), np.int64)
    first = _starts(owner)
    rows, own = owner[first], np.cumsum(np.diff(owner, prepend=owner[0]) != 0)
    add = lambda v: np.add.reduceat(v, first)
    n, area = (y1 - y0).astype(float), area[rows]
    xs, base = x - x[first][own], np.minimum.reduceat(y0, first)[own]
    _, _, m20, m02, m11 = _second_moments(xs, y0 - base, y1 - base, n, first, own, area)
    _, vectors = np.linalg.eigh(np.stack([m20, m11, m11, m02], 1).reshape(-1, 2, 2))
    axis = vectors[:, :, 1]
    longer = np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1)
    axis = np.where(longer > 0, axis, -axis)
    ax, ay = axis[own, 0], axis[own, 1]
    low, high = np.where(ay >= 0, y0, y1 - 1), np.where(ay >= 0, y1 - 1, y0)  # along the axis
    least, most = x * ax + low * ay, x * ax + high * ay
    lo, hi = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
    extent = hi - lo

    def beyond(cut: np.ndarray) -> np.ndarray:
        cut = cut[own]
        short = np.where(most < cut, y1 - y0, 0)
        # By bisection where the cut crosses a column: its first pixel that reaches the cut.
        at = np.flatnonzero((least < cut) & (most >= cut))
        cut, shift, ay_, low_ = cut[at], x[at] * ax[at], ay[at], low[at]
        way, steps, stop = np.where(ay_ >= 0, 1, -1), np.zeros(len(at), np.int64), (y1 - y0)[at]
        while (steps < stop).any():
            half = (steps + stop) // 2  # where both ends have met, the answer is there: it reaches the cut
            reach = shift + (low_ + way * half) * ay_ >= cut
            steps, stop = np.where(reach, steps, half + 1), np.where(reach, half, stop)
        short[at] = steps
        return add(y1 - y0 - short)

    last, upper = beyond(lo + 2 * extent / 3), beyond(lo + extent / 3)
    kept = extent >= 1e-6
    parts = np.stack([add(y1 - y0) - upper, upper - last, last], 1)
    return rows[kept], parts[kept]


# --- Spark functions --------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def rle_encode(runs: pa.Array) -> pa.Array:
    return encode_batch(runs)


def rectangle_codes(height: int, width: int):
    """Compressed masks of rectangles ``x, y, w, h`` on a canvas; NULL where one of them is."""

    @F.arrow_udf(T.StringType())
    def codes(x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in (x, y, w, h)])
        sides = [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y, w, h)]
        return pc.if_else(pa.array(known), encode_rectangles(*sides, height, width), pa.scalar(None, pa.string()))

    return codes


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray, known: np.ndarray) -> pa.Array:
    """Lists of the given sizes; NULL where not ``known``, which must have size 0."""
    ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values if isinstance(values, pa.Array) else pa.array(values), mask=pa.array(~known))


@F.arrow_udf(INTS)
def rle_decode(counts: pa.Array) -> pa.Array:
    runs, owner = decode_batch(counts)
    return _lists(runs.astype(np.int32), np.bincount(owner, minlength=len(counts)), counts.is_valid().to_numpy(zero_copy_only=False))


@F.arrow_udf(GEOMETRY)
def mask_geometry(counts: pa.Array, height: pa.Array) -> pa.Array:
    """NULL measures without a mask; a mask without pixels has area 0 and an empty box only."""
    found = shapes(counts, _heights(height))
    known = counts.is_valid().to_numpy(zero_copy_only=False)
    columns = []
    for name in _FIELDS:
        v = np.full(len(counts), np.nan)
        if name == "mask_area":
            v[known] = 0.0
        if name in found:
            v[found["mask"]] = found[name]
        columns.append(pa.array(v, mask=np.isnan(v)))
    return pa.StructArray.from_arrays([*columns, _boxes(found, known)], names=[*_FIELDS, "box"])


def _boxes(found: dict, known: np.ndarray) -> pa.Array:
    box = np.zeros((len(known), 4), np.int32)
    if "box" in found:
        box[found["mask"]] = found["box"]
    return _lists(box[known].ravel(), 4 * known, known)


@F.arrow_udf(T.LongType())
def mask_area(counts: pa.Array) -> pa.Array:
    owner, starts, ends = ranges(counts)
    area = np.zeros(len(counts), np.int64)
    np.add.at(area, owner, ends - starts)
    return pa.array(area, mask=counts.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(INTS)
def mask_box(counts: pa.Array, height: pa.Array) -> pa.Array:
    """[x1, y1, x2, y2] with inclusive maxima; zeros for an empty mask."""
    owner, x, y0, y1 = columns_of(*ranges(counts), _heights(height))
    first = _starts(owner)
    found = {"mask": owner[first], "box": _extents(x, y0, y1, first)} if len(owner) else {}
    return _boxes(found, counts.is_valid().to_numpy(zero_copy_only=False))


@F.arrow_udf(PAIRS)
def mask_pairs(ids: pa.Array, counts: pa.Array, parts: pa.Array, whole: pa.Array) -> pa.Array:
    """Overlaps of the unordered mask pairs that each packed row is responsible for."""
    sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    frame = np.repeat(np.arange(len(ids)), sizes)
    masks = counts.flatten()
    owner, starts, ends = ranges(masks)
    area = np.zeros(len(masks), np.int64)
    np.add.at(area, owner, ends - starts)
    common = overlaps(owner, starts, ends, frame)
    # Every pair of a row's masks, also those that share nothing.
    stop = np.repeat(np.cumsum(sizes), sizes)
    ahead = stop - np.arange(len(frame)) - 1
    a = np.repeat(np.arange(len(frame)), ahead)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    part = parts.flatten().to_numpy(zero_copy_only=False)
    known = masks.is_valid().to_numpy(zero_copy_only=False)
    mine = (whole.to_numpy(zero_copy_only=False).astype(bool)[frame[a]] | (part[a] != part[b])) & known[a] & known[b]
    a, b = a[mine], b[mine]
    keys, shared = common["a"] * len(frame) + common["b"], np.zeros(len(a), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, a * len(frame) + b), len(keys) - 1)
        hit = keys[at] == a * len(frame) + b
        shared[hit] = common["n"][at[hit]]
    place = ids.flatten().to_numpy(zero_copy_only=False)
    columns = [place[a], place[b], shared, area[a], area[b]]
    rows = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["ia", "ib", "inter", "area_a", "area_b"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(frame[a], minlength=len(ids)))).astype(np.int32)), rows)


def _heights(height: pa.Array) -> np.ndarray:
    return height.fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)


def _point_lists(points: np.ndarray, known: np.ndarray) -> pa.Array:
    values = points[known].ravel()
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, 2, dtype=np.int32)), pa.array(values))
    return _lists(inner, points.shape[1] * known, known)


def spread_points(num_points: int):
    """Evenly spaced pixels along x; one point asks for the truncated centroid."""

    @F.arrow_udf(POINTS)
    def points(counts: pa.Array, height: pa.Array) -> pa.Array:
        known, h = counts.is_valid().to_numpy(zero_copy_only=False), _heights(height)
        if num_points > 1:
            return _point_lists(pixels_at(counts, h, num_points), known)
        found = shapes(counts, h)
        centre = np.zeros((len(counts), 1, 2), np.int32)
        if len(found["mask"]):
            centre[found["mask"], 0] = np.stack([found["centroid_x"], found["centroid_y"]], 1) + 1e-9
        return _point_lists(centre, known)

    return points


def random_points(num_points: int):
    """Pixels drawn with the row's own seed (so a retried task draws the same ones)."""

    @F.pandas_udf(POINTS)
    def points(counts: pd.Series, height: pd.Series, seed: pd.Series) -> pd.Series:
        def one(c, h, s):
            if c is None:
                return None
            runs = decode_runs(c)
            n = int(runs[1::2].sum())
            if n == 0:
                return [[0, 0]] * num_points
            rng = np.random.default_rng(int(s) & 0x7FFFFFFFFFFFFFFF)
            return _pick(runs, int(h), rng.choice(n, num_points, replace=n < num_points))

        return pd.Series([one(*row) for row in zip(counts, height, seed)])

    return points


@F.arrow_udf(T.ArrayType(T.LongType()))
def body_thirds(counts: pa.Array, height: pa.Array) -> pa.Array:
    """Pixel counts of the three equal parts along the major axis; NULL for tiny masks."""
    mask, parts = thirds(counts, _heights(height))
    known = np.zeros(len(counts), bool)
    known[mask] = True
    return _lists(parts.ravel(), 3 * known, known)
