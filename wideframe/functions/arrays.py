"""Array expressions whose plans do not grow with the arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_array(values: Sequence, kind: str) -> Column:
    """An array that the optimiser folds to one constant, whatever its length."""
    return F.split(F.lit(",".join(map(repr, values)) if values else "0"), ",").cast(f"array<{kind}>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(cells: Column, size: int, start: Column) -> Column:
    """Sums of the first cell, the first two and so on, each added to ``start``, in order, for an array of ``size`` doubles.

    Appending to an array copies it, so the sums are made in blocks of about the root of ``size``.
    """
    width = max(1, math.isqrt(size))
    none = F.array().cast("array<double>")

    def inside(at: Column, block: Column) -> Column:
        first = F.struct(at.alias("at"), none.alias("sums"))
        return F.aggregate(block, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"] + x)).alias("sums")))

    blocks = F.transform(F.sequence(F.lit(0), F.lit(max(0, size - 1) // width)), lambda b: F.slice(cells, b * width + 1, F.lit(width)))
    first = F.struct(start.alias("at"), F.array().cast("array<array<double>>").alias("all"))
    return F.flatten(F.aggregate(blocks, first, lambda s, block: bound(inside(s["at"], block), lambda r: F.struct(
        r["at"].alias("at"), F.concat(s["all"], F.array(r["sums"])).alias("all"))), lambda s: s["all"]))
