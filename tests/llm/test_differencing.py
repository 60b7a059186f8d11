"""Differencing: groups stay whole, shards come close, slots have no gaps."""

import itertools
import random
import zlib
from collections import defaultdict

from trackspark.llm import differencing


def test_against_every_partition():
    random.seed(2)
    for _ in range(20):
        sizes = [random.randint(1, 60) for _ in range(8)]
        found, sums = differencing.difference(sizes, 2)
        best = min(abs(sum(sizes) - 2 * sum(c)) for k in range(9) for c in itertools.combinations(sizes, k))
        assert sorted(sums) == sorted([sum(s for s, j in zip(sizes, found) if j == x) for x in (0, 1)])
        assert max(sums) - min(sums) <= best + max(sizes) // 4


def test_tighter_than_greedy():
    random.seed(4)
    sizes = [random.randint(1, 30_000) for _ in range(4000)]
    _, sums = differencing.difference(sizes, 8)
    greedy = [0] * 8
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert differencing.combine([]) == []


def check(df):
    rows, docs = differencing.shard_by_bytes(df).collect(), df.collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    group, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        group[r["size"], r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_table(small, awkward, empty):
    sizes = check(small)
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values())
    check(awkward)
    assert differencing.shard_by_bytes(empty).count() == 0


def test_hot_text(spark):
    rows = [(i, "one hot text") for i in range(3000)] + [(3000 + i, f"text {i}" * (i % 9)) for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
