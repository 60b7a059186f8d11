"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lead_columns(df: DataFrame, lead: Sequence[str] = ("video_id", "bird_id", "frame_idx")) -> DataFrame:
    """Key columns first, the others in their order."""
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def dataset(df: DataFrame, path: str, *, partition: Sequence[str] = ("video_id",), rows_per_file: int = 5_000_000) -> None:
    """Parquet partitioned by video. A large video spreads over many tasks and files: the
    writer does not gather a video in one task, and files are capped by row count."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*partition).parquet(path)


def video_documents(df: DataFrame, path: str, *, entry: str = "entries", order: Sequence[str] = ()) -> None:
    """One JSON document per video: its (human-scale) events as an array."""
    cols = [c for c in df.columns if c != "video_id"]
    first = [c for c in order if c in cols]
    item = F.struct(*first, *[c for c in cols if c not in first])
    docs = df.groupBy("video_id").agg(F.sort_array(F.collect_list(item)).alias(entry))
    docs.write.mode("overwrite").partitionBy("video_id").json(path)


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Union keeping the row with the highest ``version`` per key (combined map-side)."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    rest = F.struct(*[c for c in both.columns if c not in keys])
    return both.groupBy(*keys).agg(F.max_by(rest, F.col(version)).alias("_r")).select(*keys, "_r.*")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def mot_text(rows: DataFrame, path: str) -> None:
    """Text rows sorted by (frame, id) inside each file, partitioned by variant and video."""
    keys = [c for c in ("variant", "video_id") if c in rows.columns]
    sorted_ = rows.repartitionByRange(*keys, "frame_idx", "id").sortWithinPartitions(*keys, "frame_idx", "id")
    sorted_.select(*keys, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def csv_report(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """A report as CSV files with headers: each holds a range of the order, in the order of the file names."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", "true").csv(path)


def frame_text(frames: DataFrame) -> DataFrame:
    """Array columns as comma text, the stored form of the frame metrics."""
    arrays = [f.name for f in frames.schema if f.dataType.typeName() == "array"]
    return frames.withColumns({c: F.array_join(c, ",") for c in arrays})
