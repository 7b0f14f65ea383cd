"""Positions, running totals and average ranks that stay distributed for any group size.

A window over one large group would sort that whole group in one task. Here large inputs are cut
into range slices instead, each slice is ranked alone, and the totals of the earlier slices are added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideframe.session import stage

ROWS_PER_SLICE = 1_000_000
#: ``monotonically_increasing_id`` numbers the rows of a task from a multiple of this on.
TASK_IDS = 1 << 33
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other, as they do in a group-by; keeps the left keys."""
    if not on:
        raise ValueError("a join needs at least one key")
    other = right.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in on else F.col(f"`{c}`") for c in right.columns])
    matched = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in on])
    joined = left.join(other, matched, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in on])


def broadcast_if_small(df: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """Broadcast hint for a table whose rows, and bytes where a row has no bound, were measured; else the plain join stays."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str | None = None,
                   out: str = "before", rows_per_slice: int = ROWS_PER_SLICE, staged: bool = False) -> DataFrame:
    """Add ``out``: the total weight (or number) of the rows that come earlier in the same group.

    ``by`` + ``order`` must identify a row, so aggregate duplicates first; then even a group that
    holds most of the table is split evenly by its order values. The input is written once, so that
    sizing it and ranking it do not compute it twice; ``staged`` says that it already is a table.
    """
    df = df if staged else stage(df, "to-rank")
    by, order = list(by), list(order)
    share = F.lit(1).cast("long") if weight is None else F.col(weight)
    zero = F.lit(0).cast("long")
    rows = df.count()
    if rows <= rows_per_slice:
        earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(share).over(earlier), zero))

    # Tasks are of ROWS_PER_SLICE rows, or one per core, however short the slices are; a task's sorted rows are numbered from its own number on.
    parts = min(math.ceil(rows / rows_per_slice), max(math.ceil(rows / ROWS_PER_SLICE), df.sparkSession.sparkContext.defaultParallelism))
    placed = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id())
    within = F.pmod("__at", F.lit(TASK_IDS))
    cut = stage(placed.withColumn("__slice", F.col("__at") - within + F.floor(within / rows_per_slice)).drop("__at"), "ranks")
    earlier_slices = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*by, "__slice").agg(F.sum(share).alias("__total"))
        .withColumn("__start", F.coalesce(F.sum("__total").over(earlier_slices), zero))
        .drop("__total")
    )
    inside = Window.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = null_safe_join(cut, starts, [*by, "__slice"])
    return (
        placed.withColumn(out, F.col("__start") + F.coalesce(F.sum(share).over(inside), zero))
        .drop("__slice", "__start")
    )


def average_ranks(counts: DataFrame, by: Sequence[str], value: str, n: str = "n", out: str = "rank",
                  rows_per_slice: int = ROWS_PER_SLICE, staged: bool = False) -> DataFrame:
    """1-based average rank of each distinct value, given its number of rows ``n``."""
    placed = running_totals(counts, by, [value], n, "__before", rows_per_slice, staged)
    return placed.withColumn(out, F.col("__before") + (F.col(n) + 1) / F.lit(2.0)).drop("__before")


def top_n_ties(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` highest rows and every row level with the last of them.

    The cut-off comes from a per-task top-n, so no task sees more than ``n`` rows of each other task;
    the rows themselves are then only filtered.
    """
    top = df.filter(F.col(by).isNotNull()).select(by).orderBy(F.col(by).desc()).limit(n)
    cutoff = top.agg(F.min(by).alias("cutoff")).first()["cutoff"]
    return df.filter(F.lit(False) if cutoff is None else F.col(by) >= F.lit(cutoff))


def first_n(df: DataFrame, order_by: Sequence[str | Column], n: int = 1) -> DataFrame:
    """First rows in an explicit order (top-n per task, then a merge; no full sort)."""
    return df.orderBy(*order_by).limit(n)
