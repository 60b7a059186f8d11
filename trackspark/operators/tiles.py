"""All-pairs work inside small groups (the objects of one frame), without emitting pairs.

The rows of a group are packed into an array and pair measures are folded inside the row, so
one frame is one row and no pair ever becomes one. Groups are packed only up to ``tile``
members: those of a wider group are dealt into parts and every pair of parts becomes its own
row (each member is copied once per part), so the quadratic work is spread over tasks and
still covers every pair exactly once. The plan is the same whether wide groups exist or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TILE = 64


def parts_of(df: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """``keys, _parts``: in how many parts of about half a tile a group is dealt (1 up to a tile)."""
    n = F.count(F.lit(1))
    parts = F.when(n > tile, F.ceil(n / (tile / 2))).otherwise(F.lit(1)).cast("int")
    return df.groupBy(*keys).agg(parts.alias("_parts"))


def part_of(member: Sequence[str]) -> Column:
    """The deal needs no order; it must only be the same on a retry, hence a hash of the row."""
    return F.pmod(F.xxhash64(*member), F.col("_parts")).cast("int")


def deal(df: DataFrame, keys: Sequence[str], member: Sequence[str], *, tile: int = TILE) -> DataFrame:
    """Every member once for each packed row it stands in (``_pa``, ``_pb``). Only wide groups are looked up.

    Rows with a NULL among the keys form no group.
    """
    known = F.lit(True)
    for name in keys:
        known = known & F.col(name).isNotNull()
    wide = parts_of(df, keys, tile).filter(F.col("_parts") > 1)
    return (
        df.filter(known)
        .join(wide, list(keys), "left")
        .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        .withColumn("_part", part_of(member))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_pa", F.least("_part", "_other"))
        .withColumn("_pb", F.greatest("_part", "_other"))
        .drop("_other")
    )


def _starts(batch: pa.Table, names: Sequence[str]) -> np.ndarray:
    """First row of every run of rows with equal (known) ``names``."""
    new = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        new[1:] = False
        for name in names:
            column = batch.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pairs_of(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, first and second row of all pairs inside the groups, in order of their rows."""
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    # A row meets all later rows of its group.
    ahead = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
    first = np.repeat(np.arange(n), ahead)
    second = np.arange(len(first)) - np.repeat(np.cumsum(ahead) - ahead, ahead) + first + 1
    return group[first], first, second


def fold_pairs(
    df: DataFrame,
    keys: Sequence[str],
    member: Sequence[str],
    fold: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, int], dict[str, np.ndarray]],
    schema: StructType,
    *,
    raw: Sequence[str] = (),
    tile: int = TILE,
) -> DataFrame:
    """One row per group or pair of a wide group's parts, with what ``fold`` makes of its pairs.

    The numeric ``member`` columns come as arrays with NaN for NULL, those named in ``raw`` as Arrow arrays, rows in
    their order; ``fold(columns, group, first, second, n_groups)`` gets all pairs of many groups at once and returns the
    columns of ``schema`` (long or double, where NaN is NULL, or Arrow arrays). Two more columns are ``_group``, the
    group of each row, and ``_own``: a member stands in as many groups as its own has parts, but is ``_own`` in one.
    """
    names = [*keys, "_pa", "_pb"]
    rows = deal(df, keys, member, tile=tile).select(*names, "_part", *member)
    # Groups only have to stand together: the last key, which differs most, is compared first.
    rows = rows.repartition(*names).sortWithinPartitions(*reversed(keys), "_pa", "_pb", *member)
    made = StructType([*[rows.schema[k] for k in keys], *schema.fields])
    kinds = dict(rows.dtypes)
    wanted = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
    columns = [c for c in member if kinds[c] in numbers and c not in raw]

    def folded(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        group, first, second = _pairs_of(starts, table.num_rows)
        part, a, b = (table.column(c).to_numpy() for c in ("_part", "_pa", "_pb"))
        mine = (a[first] == b[first]) | (part[first] != part[second])
        if not mine.all():
            group, first, second = group[mine], first[mine], second[mine]
        cells = {c: table.column(c).cast(pa.float64()).to_numpy() for c in columns}
        cells |= {c: table.column(c).combine_chunks() for c in raw}
        sizes = np.diff(np.append(starts, table.num_rows))
        cells |= {"_group": np.repeat(np.arange(len(starts)), sizes), "_own": (a == b) & (part == a)}
        out = fold(cells, group, first, second, len(starts))
        heads = table.select(list(keys)).take(pa.array(starts)).combine_chunks()
        arrays = [heads.column(k).combine_chunks() for k in keys]
        # Without any pair numpy would count in whole numbers.
        as_array = lambda v, kind: v if isinstance(v, pa.Array) else pa.array(np.asarray(v, float if kind == "double" else np.int64), from_pandas=True)
        arrays += [as_array(out[c], kind) for c, kind in wanted]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _starts(table, names)
            # The last group may go on in the next batch.
            cut = int(starts[-1])
            held = table.slice(cut).to_batches()
            if cut:
                yield folded(table.slice(0, cut), starts[:-1])
        if held:
            table = pa.Table.from_batches(held)
            yield folded(table, np.zeros(1, np.int64))

    return rows.mapInArrow(run, made)


def pack(df: DataFrame, keys: Sequence[str], member: Sequence[str], *, tile: int = TILE) -> DataFrame:
    """One row per group, or per pair of a wide group's parts (``_pa`` <= ``_pb``), with ``items``.

    ``items`` is the sorted array of structs of the ``member`` columns and their ``_part``; every
    member stands in ``_parts`` rows. Rows with a NULL among the keys form no group.
    """
    dealt = deal(df, keys, member, tile=tile)
    item = F.struct(*member, "_part")
    return dealt.groupBy(*keys, "_pa", "_pb", "_parts").agg(F.sort_array(F.collect_list(item)).alias("items"))


def pair_array(measure, items: str | Column = "items") -> Column:
    """Array of ``measure(a, b)`` over the unordered pairs a packed row is responsible for."""
    arr = F.col(items) if isinstance(items, str) else items
    whole = F.col("_pa") == F.col("_pb")

    def after(a: Column, i: Column) -> Column:
        rest = F.slice(arr, i + 2, F.size(arr))
        mine = F.filter(rest, lambda b: whole | (a["_part"] != b["_part"]))
        return F.transform(mine, lambda b: measure(a, b))

    return F.flatten(F.transform(arr, after))


def fold(values: Column, start: Column, step) -> Column:
    return F.aggregate(values, start, step)
