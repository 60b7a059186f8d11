"""Small helpers of the text operators: plain columns in, Arrow batches out."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and nothing else, so that no other column can clash; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


#: Bytes of a batch that become Python objects at once (one row at least).
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Stretches of bounded bytes of a task's batches; then freed memory goes back to the system.

    A Python worker outlives its task and keeps what its allocators hold, which the next stage would
    find taken.
    """
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``mapInArrow`` for a function from column lists to column lists (one dict a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(b.to_pydict() for b in batches if b.num_rows):
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return df.mapInArrow(run, ddl)
