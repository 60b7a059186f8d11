"""Ordered operators over long sequences, without one task per sequence.

A recording may hold a large share of all rows, so nothing here partitions rows by the
sequence key alone. A sequence is cut into blocks of ``block`` order units; rows are
partitioned by (sequence, block), and what has to cross a block border travels in a carry
table with at most one row per block:

* :class:`Neighbours` gives ``lag`` / ``lead`` / short rolling sums across block borders;
* :func:`with_runs` (gaps and islands) and :func:`running_total` carry a prefix value.

There is one plan at every size; the block size is an argument and no property of the data. Rows
without a key or an order value belong to no sequence: they stay, with NULL results.
The carry table is read from the same exchange as the rows (the rows are selected first, so
that both branches ask for identical columns and the exchange is reused).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order units (frames) per block: large enough that the block summary is ~1e-5 of the rows,
#: small enough that one block always fits a task.
BLOCK = 65_536

BLK = "_blk"

#: Rows of no sequence are spread over the blocks from here downwards.
ABSENT = -(1 << 40)


def block_of(order: str | Column, block: int) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(float(block))).cast("long")


def in_blocks(df: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """Partition by (sequence, block): the one exchange the ordered operators need.

    Rows without a key or an order value get blocks of their own, so that they crowd no task.
    """
    complete = F.lit(True)
    for name in (*keys, order):
        complete = complete & F.col(name).isNotNull()
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    absent = F.lit(ABSENT) - F.pmod(F.xxhash64(*plain), F.lit(256))
    here = F.coalesce(block_of(order, block), F.lit(0))
    return df.withColumn(BLK, F.when(complete, here).otherwise(absent)).repartition(*keys, BLK)


def present() -> Column:
    """Whether a row of :func:`in_blocks` belongs to a sequence."""
    return F.col(BLK) > ABSENT


def edges(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per block of the sequences: ``keys``, the block and ``aggs``, from the exchange of the rows.

    Filters and narrower columns would move below the exchange, and Spark would compute the rows a second time
    for an exchange of other content. So the keys come out as aggregates, which no filter passes, and a hash of
    all columns keeps them together.
    """
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    own = [*keys, BLK]
    out = rows.groupBy(*own).agg(
        *[F.max(k).alias(f"_key{i}") for i, k in enumerate(own)], *aggs, F.max(F.xxhash64(*plain)).alias("_all")
    )
    out = out.drop(*own).withColumnsRenamed({f"_key{i}": k for i, k in enumerate(own)})
    return out.filter(present() & F.col("_all").isNotNull()).drop("_all")


def block_window(keys: Sequence[str], order: str | Sequence[str]):
    cols = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys, BLK).orderBy(*cols)


class Neighbours:
    """Rows of ordered sequences with access to the previous and next rows.

    ``df`` holds the rows; :meth:`lag`, :meth:`lead` and :meth:`sum_ahead` /
    :meth:`any_behind` build columns for it. ``keys + order + tie`` must be unique.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: str,
        *,
        tie: Sequence[str] = (),
        back: int = 0,
        ahead: int = 0,
        block: int = BLOCK,
    ):
        self.keys, self.order, self.back, self.ahead = list(keys), [order, *tie], back, ahead
        self.w = block_window(keys, self.order)
        whole = Window.partitionBy(*keys, BLK)
        base = in_blocks(df, keys, order, block)
        numbered = base.withColumn("_rn", F.row_number().over(self.w))
        if ahead or back > 1:
            numbered = numbered.withColumn("_cnt", F.count(F.lit(1)).over(whole))
        self.df = numbered.join(self._carry(base, numbered), [*keys, BLK], "left")

    def _carry(self, base: DataFrame, numbered: DataFrame) -> DataFrame:
        keys = self.keys
        order = F.struct(*self.order)
        row = F.struct(*[F.col(c) for c in base.columns if c not in keys and c != BLK])
        if self.back <= 1 and self.ahead <= 1:
            tail = F.array(F.max_by(row, order)) if self.back else F.array()
            head = F.array(F.min_by(row, order)) if self.ahead else F.array()
            ends = edges(base, keys, tail.alias("_tail"), head.alias("_head"))
        else:
            is_tail = F.col("_rn") > F.col("_cnt") - self.back
            is_head = F.col("_rn") <= self.ahead
            keyed = F.struct(order.alias("_o"), row.alias("_row"))

            def side(flag: Column) -> Column:
                items = F.array_sort(F.collect_list(F.when(flag, keyed)))
                return F.transform(items, lambda s: s["_row"])

            ends = edges(
                numbered.filter(is_tail | is_head), keys, side(is_tail).alias("_tail"), side(is_head).alias("_head")
            )
        by_block = Window.partitionBy(*keys).orderBy(BLK)
        out = []
        if self.back:
            prior = F.flatten(F.collect_list("_tail").over(by_block.rowsBetween(-self.back, -1)))
            first = F.greatest(F.size(prior) - self.back + 1, F.lit(1))
            out.append(F.slice(prior, first, self.back).alias("_before"))
        if self.ahead:
            later = F.flatten(F.collect_list("_head").over(by_block.rowsBetween(1, self.ahead)))
            out.append(F.slice(later, 1, self.ahead).alias("_after"))
        carry = ends.select(*keys, BLK, *out)
        some = F.lit(False)
        if self.back:
            some = some | (F.size("_before") > 0)
        if self.ahead:
            some = some | (F.size("_after") > 0)
        return carry.filter(some)

    def lag(self, name: str, k: int = 1) -> Column:
        at = F.size("_before") - (F.lit(k + 1) - F.col("_rn"))
        crossed = F.get(F.col("_before"), at)[name]
        return F.when(F.col("_rn") > k, F.lag(name, k).over(self.w)).otherwise(crossed)

    def lead(self, name: str, k: int = 1) -> Column:
        left = F.col("_cnt") - F.col("_rn")
        crossed = F.get(F.col("_after"), (F.lit(k - 1) - left).cast("int"))[name]
        return F.when(left >= k, F.lead(name, k).over(self.w)).otherwise(crossed)

    def sum_ahead(self, name: str, rows: int) -> tuple[Column, Column]:
        """Sum and row count over the current row and the ``rows - 1`` rows after it."""
        frame = self.w.rowsBetween(0, rows - 1)
        n_in = F.count(F.lit(1)).over(frame)
        extra = F.slice(F.coalesce(F.col("_after"), F.array()), 1, (F.lit(rows) - n_in).cast("int"))
        total = F.aggregate(
            extra, F.lit(0).cast("long"), lambda acc, r: acc + r[name].cast("long")
        )
        return F.sum(F.col(name).cast("long")).over(frame) + total, n_in + F.size(extra)

    def any_behind(self, name: str, rows: int) -> Column:
        """Whether a boolean column holds in one of the previous ``rows`` rows."""
        here = F.coalesce(F.max(F.col(name)).over(self.w.rowsBetween(-rows, -1)), F.lit(False))
        before = F.coalesce(F.col("_before"), F.array())
        want = F.greatest(F.lit(rows) - (F.col("_rn") - 1), F.lit(0))
        start = F.greatest(F.size(before) - want + 1, F.lit(1)).cast("int")
        return here | F.exists(F.slice(before, start, want.cast("int")), lambda r: r[name])

    def with_columns(self, columns: dict[str, Column]) -> DataFrame:
        hidden = [BLK, "_rn", "_cnt", "_before", "_after"]
        known = {name: F.when(present(), value) for name, value in columns.items()}
        return self.df.withColumns(known).drop(*hidden)


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, *, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of ``value`` along each sequence."""
    blocked = in_blocks(df.withColumn("_v", value), keys, order, block)
    earlier = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        edges(blocked, keys, F.sum("_v").alias("_s"))
        .select(*keys, BLK, F.sum("_s").over(earlier).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    w = block_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.sum("_v").over(w))
        .join(carry, [*keys, BLK], "left")
        .withColumn(name, F.when(present(), F.col("_in") + F.coalesce(F.col("_carry"), F.lit(0))))
        .drop("_v", "_in", "_carry", BLK)
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "row_idx", *, block: int = BLOCK
) -> DataFrame:
    """0-based position along each sequence."""
    out = running_total(df, keys, order, F.lit(1).cast("long"), name, block=block)
    return out.withColumn(name, F.col(name) - 1)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    tie: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Greatest non-null ``value`` at or before each row (``tie`` orders equal positions)."""
    blocked = in_blocks(df.withColumn("_v", value), keys, order, block)
    earlier = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        edges(blocked, keys, F.max("_v").alias("_s"))
        .select(*keys, BLK, F.max("_s").over(earlier).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    w = block_window(keys, [order, *tie]).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.withColumn("_in", F.max("_v").over(w))
        .join(carry, [*keys, BLK], "left")
        .withColumn(name, F.when(present(), F.coalesce("_in", "_carry")))
        .drop("_v", "_in", "_carry", BLK)
    )


def carry_backward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    *,
    tie: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Smallest non-null ``value`` at or after each row (``tie`` orders equal positions)."""
    blocked = in_blocks(df.withColumn("_v", value), keys, order, block)
    # A growing frame from the far end: a "following" frame would rescan for every row.
    down = [F.col(c).desc() for c in (order, *tie)]
    w = Window.partitionBy(*keys, BLK).orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(1, Window.unboundedFollowing)
    carry = (
        edges(blocked, keys, F.min("_v").alias("_s"))
        .select(*keys, BLK, F.min("_s").over(later).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
    )
    return (
        blocked.withColumn("_in", F.min("_v").over(w))
        .join(carry, [*keys, BLK], "left")
        .withColumn(name, F.when(present(), F.coalesce("_in", "_carry")))
        .drop("_v", "_in", "_carry", BLK)
    )


def with_runs(
    df: DataFrame, keys: Sequence[str], order: str, *, max_step: int | Column = 1, block: int = BLOCK
) -> DataFrame:
    """Gaps and islands: add ``run_start``, the order value at which the row's run begins.

    A run goes on while the step to the previous row is at most ``max_step``; the start value
    identifies the run within its sequence, so no global numbering pass is needed.
    """
    step = max_step if isinstance(max_step, Column) else F.lit(max_step)
    w = block_window(keys, order)
    blocked = in_blocks(df, keys, order, block)
    # Breaks seen inside a block; whether its first row opens a run is decided by the carry.
    marked = blocked.withColumn(
        "_open", F.when(F.col(order) - F.lag(order).over(w) > step, F.col(order))
    )
    by_block = Window.partitionBy(*keys).orderBy(BLK)
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.max(step).alias("_step") if isinstance(max_step, Column) else step.alias("_step")
    carry = (
        edges(marked, keys, F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.max("_open").alias("_last"), limit)
        .withColumn("_gap", F.col("_lo") - F.lag("_hi").over(by_block))
        .withColumn("_lead", F.when(F.col("_gap") <= F.col("_step"), F.lit(None)).otherwise(F.col("_lo")))
        .withColumn("_carry", F.max(F.coalesce("_last", "_lead")).over(earlier))
        .select(*keys, BLK, F.coalesce("_lead", "_carry").alias("_carry"))
    )
    here = F.max("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_in", here)
        .join(carry, [*keys, BLK], "left")
        .withColumn("run_start", F.when(present(), F.coalesce("_in", "_carry")))
        .drop("_open", "_in", "_carry", BLK)
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    max_step: int | Column = 1,
    aggs: Sequence[Column] = (),
    block: int = BLOCK,
) -> DataFrame:
    """One row per run: ``run_start``, ``run_end``, ``n_rows`` and ``aggs``."""
    return (
        with_runs(df, keys, order, max_step=max_step, block=block)
        .filter(F.col("run_start").isNotNull())
        .groupBy(*keys, "run_start")
        .agg(F.max(order).alias("run_end"), F.count(F.lit(1)).alias("n_rows"), *aggs)
    )


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable[[dict, object], tuple[object, Iterable[tuple]]],
    schema: str,
) -> DataFrame:
    """Sequential scan over *event-level* rows (periods, boundaries, keyframes).

    Rows are sorted inside the partitions and streamed through ``step(row, state)``, which
    returns the next state and the rows to emit; only the state of one sequence is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, None
                state, emitted = step(row, state)
                out.extend(emitted)
            yield pd.DataFrame(out, columns=names)

    names = [part.split()[0] for part in schema.split(", ")]
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)
