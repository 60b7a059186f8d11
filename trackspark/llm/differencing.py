"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Documents with equal texts form a group that stays together. A partial partition is an n-tuple of
subset sums; the two with the largest spread are combined in opposite order (largest with smallest)
until one is left. Differencing composes: each task combines the groups of its own partition to a
few tuples, only these (shard count numbers each) are combined once more, and the outcome tells
each task's subset its shard. No group list leaves its partition.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackspark.llm.common import texts, utf8
from trackspark.session import cut_lineage

CHUNK = 200_000  # groups combined at once; more in a partition make several tuples


def combine(tuples: list[list[int]]) -> list[list[int]]:
    """Differencing of n-tuples of sums: for each tuple, the final subset of each of its entries.

    Ties are taken in input order, so equal input gives equal output.
    """
    if not tuples:
        return []
    n = len(tuples[0])
    parent: list[int] = []  # entries that ended in one subset, as a forest
    heap = []
    for k, t in enumerate(tuples):
        entries = sorted((s, k * n + j) for j, s in enumerate(t))
        parent.extend(range(k * n, k * n + n))
        heap.append((entries[0][0] - entries[-1][0], k, entries))
    heapq.heapify(heap)
    stamp = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        entries = []
        for (s, x), (t, y) in zip(a, reversed(b), strict=True):
            parent[y] = x
            entries.append((s + t, x))
        entries.sort()
        heapq.heapreplace(heap, (entries[0][0] - entries[-1][0], stamp, entries))
        stamp += 1
    final = {x: j for j, (_, x) in enumerate(heap[0][2])}

    def subset(x: int) -> int:
        seen = []
        while parent[x] != x:
            seen.append(x)
            x = parent[x]
        for y in seen:
            parent[y] = x
        return final[x]

    return [[subset(k * n + j) for j in range(n)] for k in range(len(tuples))]


def difference(sizes: list[int], n: int) -> tuple[list[int], list[int]]:
    """The subset of each size, and the subsets' sums."""
    found = [row[0] for row in combine([[s] + [0] * (n - 1) for s in sizes])]
    sums = [0] * n
    for s, j in zip(sizes, found, strict=True):
        sums[j] += s
    return found, sums


def _partial(n: int):
    schema = pa.schema([("digest", pa.binary()), ("bytes", pa.int64()), ("part", pa.int64()), ("subset", pa.int32())])

    def run(batches):
        task, chunk, digests, sizes = TaskContext.get().partitionId(), 0, [], []

        def out():
            found, _ = difference(sizes, n)
            part = [task << 32 | chunk] * len(sizes)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((digests, sizes, part, found), schema.types, strict=True)], schema=schema)

        for b in batches:
            digests += b.column("digest").to_pylist()
            sizes += b.column("bytes").to_pylist()
            if len(sizes) >= CHUNK:
                yield out()
                chunk, digests, sizes = chunk + 1, [], []
        if sizes:
            yield out()

    return run


def _numbered(n: int):
    """Adds the task and each row's place among the task's rows of its shard."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(n, np.int64)
        for b in batches:
            shard = b.column("shard").to_numpy()
            place = np.zeros(len(shard), np.int64)
            for s in range(n):
                at = np.flatnonzero(shard == s)
                place[at] = seen[s] + np.arange(len(at))
                seen[s] += len(at)
            arrays = [*b.columns, pa.array(np.full(len(shard), task)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, "task", "place"])

    return run


def shard_by_bytes(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and its gapless slot there; sizes are UTF-8 bytes plus 1.

    A null text counts as an empty one (size 1, same group). Rows with equal texts, repeated rows
    among them, share a shard. Null ids stay null. A group larger than a shard's fair share makes its
    shard that large: groups are never cut. An empty table gives an empty table.
    """
    spark = df.sparkSession
    raw = utf8("text")
    rows = texts(df, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text") + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest"),
    )
    rows = cut_lineage(rows, "shard-rows")  # a few numbers a document; the texts are read once
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    parts = cut_lineage(groups.mapInArrow(_partial(n_shards), "digest binary, bytes long, part long, subset int"), "shard-parts")

    # One tuple of n_shards sums for each task and chunk: bounded by the number of partitions.
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("part", "subset").agg(F.sum("bytes").alias("bytes")).orderBy("part", "subset").collect():
        sums.setdefault(r["part"], [0] * n_shards)[r["subset"]] = r["bytes"]
    places = [(p, j, s) for p, row in zip(sums, combine(list(sums.values())), strict=True) for j, s in enumerate(row)]
    shard_of = spark.createDataFrame(places, "part long, subset int, shard int")
    shards = parts.join(F.broadcast(shard_of), ["part", "subset"]).select("digest", "shard")

    # A hot text is split by adaptive execution: nothing above the join needs a digest's rows together.
    dealt = rows.join(shards, "digest").select("doc_id", "size", "text_crc32", "shard")
    dealt = cut_lineage(dealt.mapInArrow(_numbered(n_shards), "doc_id long, size long, text_crc32 long, shard int, task long, place long"), "shard-slots")
    counts = dealt.groupBy("task", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("task", "shard", before.alias("first"))  # tasks x shards rows
    return dealt.join(F.broadcast(firsts), ["task", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
