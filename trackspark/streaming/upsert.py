"""Chunk-by-chunk upsert: keep the last row per key, safe to restart, with a bounded number of files.

Every micro-batch becomes a *run*, a folder named after the batches it covers. ``FANOUT`` runs of one
size are merged into a run of the next size, so that after n batches a reader opens at most
``FANOUT`` - 1 runs of each of about log(n) sizes, each in a fixed number of key-hashed files. What is merged
follows from the batch number alone, and a run counts once its ``_SUCCESS`` marker is there, which is
written last: a batch that is replayed after a failure writes the same runs again or finds them done.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("video_id", "frame_idx", "object_id")
FANOUT, FILES = 8, 8
_RUN = re.compile(r"run-(\d+)-(\d+)")


def _files(spark: SparkSession, path: str):
    """The folder and its file system, whatever the cluster stores it on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The complete runs, (first, last) batch, widest first among those that begin together."""
    folder, fs = _files(spark, path)
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        m = _RUN.fullmatch(status.getPath().getName())
        if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(m[1]), int(m[2])))
    return sorted(found, key=lambda r: (r[0], -r[1]))


def cover(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The widest runs that no other contains: each batch once."""
    out: list[tuple[int, int]] = []
    for first, last in found:
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def _name(run: tuple[int, int]) -> str:
    return f"run-{run[0]}-{run[1]}"


def _read(spark: SparkSession, path: str, chosen: Sequence[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{_name(r)}" for r in chosen])


def _last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rest, F.col(order)).alias("_r")).select(*keys, "_r.*")


def merges(batch_id: int, fanout: int = FANOUT) -> list[tuple[int, int]]:
    """The runs that are due after a batch, small ones first."""
    out, size = [], fanout
    while (batch_id + 1) % size == 0:
        out.append((batch_id + 1 - size, batch_id))
        size *= fanout
    return out


def start_upsert(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = KEYS,
    order: str,
    fanout: int = FANOUT,
    files: int = FILES,
):
    """Upsert every micro-batch: one row per key, the last by ``order`` inside a batch, then by batch.

    Runs that a wider one contains are removed when the *next* batch is written, so that a reader who has
    just chosen them can finish.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = runs(spark, path)
        kept = set(cover(found))
        folder, fs = _files(spark, path)
        for run in found:
            # What this batch may have to merge again after a failure stays.
            if run not in kept and run[1] < batch_id:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, _name(run)), True)
        if not any(first <= batch_id <= last for first, last in found):
            rows = _last(batch, keys, order).withColumn("_batch", F.lit(batch_id))
            rows.repartition(files, *keys).write.mode("overwrite").parquet(f"{path}/{_name((batch_id, batch_id))}")
        for first, last in merges(batch_id, fanout):
            found = runs(spark, path)
            if (first, last) not in found:
                parts = cover([r for r in found if first <= r[0] and r[1] <= last])
                merged = _last(_read(spark, path, parts), keys, "_batch")
                merged.repartition(files, *keys).write.mode("overwrite").parquet(f"{path}/{_name((first, last))}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, path: str, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """The upserted table: for every key the row of its latest batch."""
    return _last(_read(spark, path, cover(runs(spark, path))), keys, "_batch").drop("_batch")
