"""Benchmark decontamination: CGK embedding of word windows, bit-sampling LSH, exact edit check.

A random walk over a window copies the word under its pointer at every step and then moves on or
stays, as a random function of step and word tells. Two windows a few edits apart fall into step
again after each edit, so their edit distance becomes a small Hamming distance of the copies. Some
steps of the walk are sampled as a key; walks and samples are repeated, but near the edits allowed
some passages share no key. So an item is also dealt into one part more than it may have edits: in
every passage to be found one part stands whole, and nothing is missed.

Benchmark items are tiled by windows of their own size class, documents have a window at every word.
Whatever shares a key is verified: the exact word edit distance between the whole item and the best
stretch of the document around the hit. Words are runs of letters and digits, lower-cased (A-Z and
Latin-1), so case, punctuation and white space do not count as edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm import hashing
from trackspark.llm.common import slices, texts

SIZES = (1, 2, 4, 8, 16, 32)  # window sizes in words; an item takes the largest that it fills
WALKS, SAMPLES, STEPS_KEYED = 3, 3, 4  # walks, keys of each walk, steps in a key
SHARE = 0.2  # edits allowed for each item word
ITEM_ROWS, ITEM_BYTES = 20_000, 1 << 26  # items compared in one pass over the documents
GROUP_CHARS, CHUNK = 1 << 20, 1 << 14
PART_WORDS = 8  # of a longer part the first words are compared
SEED = 11


@dataclass
class Index:
    """Keys of the windows of a block of items."""

    items: list[tuple[int | None, np.ndarray]]  # id, word codes
    sizes: list[int] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)  # sizes
    keys: dict = field(default_factory=dict)  # (size, walk, sample) or size of a part -> {key: [(item number, offset)]}
    filters: dict = field(default_factory=dict)  # the same -> flags by the key's top bits
    bits: int = 20


def _steps(size: int) -> int:
    """Of a walk: enough for its pointer to come near the end of the window."""
    return max(1, round(1.5 * size))


def plan(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps and their multipliers, ``(walks, samples, steps)`` each; fixed for a size."""
    rng = np.random.default_rng([SEED, size])
    steps = _steps(size)
    k = min(STEPS_KEYED, steps)
    at = np.array([[np.sort(rng.choice(steps, k, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)])
    odd = rng.integers(0, 1 << 63, at.shape, np.uint64) * np.uint64(2) + np.uint64(1)
    return at, odd


def walk_keys(codes: np.ndarray, starts: np.ndarray, sizes: list[int]) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """Keys of the windows at ``starts`` for each (size, walk, sample); beyond ``codes`` the word is 0."""
    plans = {s: plan(s) for s in sizes}
    longest = max((_steps(s) for s in sizes), default=1)
    padded = np.concatenate([codes, np.zeros(longest + 1, np.uint64)])
    for w in range(WALKS):
        moves = hashing.mix(padded + hashing.BYTES[w])  # bit j: whether this word moves the walk on at step j
        use: dict[int, list] = {}
        for s, (at, odd) in plans.items():
            for j in range(SAMPLES):
                for a, o in zip(at[w, j].tolist(), odd[w, j], strict=True):
                    use.setdefault(a, []).append(((s, w, j), o))
        keys = {(s, w, j): np.zeros(len(starts), np.uint64) for s in sizes for j in range(SAMPLES)}
        for c in range(0, len(starts), CHUNK):
            pointer = starts[c : c + CHUNK].copy()
            for j in range(max(use, default=-1) + 1):
                if j in use:
                    word = padded.take(pointer)
                    for name, o in use[j]:
                        keys[name][c : c + CHUNK] += word * o
                step = moves.take(pointer)
                step >>= np.uint64(j)
                step &= np.uint64(1)
                pointer += step.view(np.int64)
        yield from keys.items()


def parts_of(words: int, share: float) -> list[tuple[int, int]]:
    """``(offset, size)`` of parts of which one stands whole in any passage with at most ``share`` edits a word."""
    n = min(int(share * words) + 1, words)
    at = [words * k // n for k in range(n + 1)]
    return [(a, min(b - a, PART_WORDS)) for a, b in zip(at, at[1:], strict=False)]


def part_keys(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the keys of the parts at every word; a part that does not end in ``codes`` has none."""
    key = np.zeros(len(codes), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        if size > len(codes):
            return
        key = hashing.pair(key[: len(codes) - size + 1], codes[size - 1 :])
        if size in sizes:
            yield size, key


def build(items: list[tuple[int | None, str]], share: float = SHARE) -> Index:
    codes, _, _, first = hashing.split_words([t.encode() for _, t in items], letters=True)
    index = Index([(i, codes[a:b]) for (i, _), a, b in zip(items, first[:-1], first[1:], strict=True) if a < b])
    tiles: dict[int, list[tuple[int, int]]] = {}
    for n, (_, c) in enumerate(index.items):
        size = max(s for s in SIZES if s <= len(c))
        offsets = sorted({*range(0, len(c) - size + 1, size), len(c) - size})
        tiles.setdefault(size, []).extend((n, o) for o in offsets)
    index.sizes = sorted(tiles)
    parts = [(n, *part) for n, (_, c) in enumerate(index.items) for part in parts_of(len(c), share)]
    index.parts = sorted({size for *_, size in parts})
    index.bits = min(24, max(16, int(np.log2(64 * max(sum(map(len, tiles.values())), len(parts)) + 1))))
    for size, own in tiles.items():
        for n, o in own:
            window = index.items[n][1][o : o + size]
            for name, key in walk_keys(window, np.zeros(1, np.int64), [size]):
                index.keys.setdefault(name, {}).setdefault(int(key[0]), []).append((n, o))
    for n, o, size in parts:
        (_, key), = part_keys(index.items[n][1][o : o + size], [size])
        index.keys.setdefault(size, {}).setdefault(int(key[0]), []).append((n, o))
    for name, keys in index.keys.items():
        flags = np.zeros(1 << index.bits, bool)
        flags[np.array(list(keys), np.uint64) >> np.uint64(64 - index.bits)] = True
        index.filters[name] = flags
    return index


def best_end(pattern: list[int], stretch: list[int]) -> tuple[int, int]:
    """``(distance, end)``: the least edit distance of the pattern to a substring, and its first end.

    Bit-parallel over the pattern, with Python's integers as bit vectors of any length.
    """
    m = len(pattern)
    where: dict[int, int] = {}
    for k, p in enumerate(pattern):
        where[p] = where.get(p, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for k, s in enumerate(stretch, 1):
        eq = where.get(s, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best[0]:
            best = (score, k)
    return best


def verify(item: np.ndarray, doc: np.ndarray, at: int, share: float) -> tuple[int, int, int] | None:
    """``(edits, first word, last word + 1)`` of the item near word ``at``, if its edits are few enough."""
    limit = int(share * len(item))
    a, b = max(0, at - limit), min(len(doc), at + len(item) + limit)
    pattern, stretch = item.tolist(), doc[a:b].tolist()
    edits, end = best_end(pattern, stretch)
    if edits > limit:
        return None
    _, back = best_end(pattern[::-1], stretch[:end][::-1])
    return edits, a + end - back, a + end


def find(codes: np.ndarray, ends: np.ndarray, index: Index, share: float) -> dict[tuple[int, int], tuple[int, int, int]]:
    """``(document number, item number) -> (edits, first word, end)``, the best of each pair.

    Document d has the codes from ``ends[d]`` to ``ends[d + 1]``.
    """
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(codes) or not index.sizes:
        return out
    seen = set()
    for name, keys in chain(walk_keys(codes, np.arange(len(codes)), index.sizes), part_keys(codes, index.parts)):
        for s in np.flatnonzero(index.filters[name][keys >> np.uint64(64 - index.bits)]).tolist():
            for n, offset in index.keys[name].get(int(keys[s]), ()):
                d = int(np.searchsorted(ends, s, "right")) - 1
                at = s - int(ends[d]) - offset
                if (d, n, at) in seen:
                    continue
                seen.add((d, n, at))
                got = verify(index.items[n][1], codes[ends[d] : ends[d + 1]], at, share)
                if got and got < out.get((d, n), (1 << 60, 0, 0)):
                    out[d, n] = got
    return out


def _found(rows: list[str | None], index: Index, share: float) -> Iterator[tuple[int, int, int, int, int]]:
    """``(row, item number, edits, start, end)`` of the hits; start and end in code points."""
    for group in _groups(rows):
        raw = [(rows[k] or "").encode() for k in group]
        codes, starts, ends, first = hashing.split_words(raw, letters=True)
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        for (d, n), (edits, a, b) in find(codes, first, index, share).items():
            head = raw[d][: starts[first[d] + a] - at[d]].decode()
            body = raw[d][starts[first[d] + a] - at[d] : ends[first[d] + b - 1] - at[d]].decode()
            yield group[d], n, edits, len(head), len(head) + len(body)


def _groups(rows: list[str | None]) -> Iterator[range]:
    start, size = 0, 0
    for k, t in enumerate(rows):
        size += len(t or "")
        if size >= GROUP_CHARS or k == len(rows) - 1:
            yield range(start, k + 1)
            start, size = k + 1, 0


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items with a text, in blocks of bounded rows and bytes."""
    known = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    r = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-2 * r["n"] // ITEM_ROWS) if r["n"] > ITEM_ROWS else 1, -(-2 * r["b"] // ITEM_BYTES) if r["b"] > ITEM_BYTES else 1)
    for k in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield [(x["item_id"], x["text"]) for x in part.orderBy("item_id", "text").collect()]


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_edits", pa.int32()), ("item_words", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_HITS_DDL = "doc_id long, item_id long, n_edits int, item_words int, start long, end long"


def leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_edits, item_words, start, end`` for each item found in each row.

    ``start``/``end`` are code points of the best stretch. A null text holds nothing; a null or
    wordless item is found nowhere; repeated items count once; repeated rows repeat their hits; null
    ids stay null; of equally good places the first counts; other columns are ignored; empty tables
    give an empty table.
    """
    docs = texts(df, id_col, text_col)
    parts = [docs.mapInArrow(_hits(build(block, share), share), _HITS_DDL) for block in item_blocks(items)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hits(index: Index, share: float):
    def run(batches):
        for b in batches:
            ids, rows = (c.to_pylist() for c in b.columns)
            out = [(ids[k], index.items[n][0], edits, len(index.items[n][1]), a, e) for k, n, edits, a, e in _found(rows, index, share)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _HITS.types, strict=True)], schema=_HITS)

    return run


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows in which no item is found, with their columns; a row without a text stays."""
    at = df.columns.index(text_col)

    def clean(index: Index):
        def run(batches):
            for b in slices(batches):
                keep = np.ones(b.num_rows, bool)
                for k, *_ in _found(b.column(at).to_pylist(), index, share):
                    keep[k] = False
                yield b.filter(pa.array(keep))

        return run

    for block in item_blocks(items):
        df = df.mapInArrow(clean(build(block, share)), df.schema)
    return df
