"""Series kept in numbered columns, re-aligned to an anchor of each row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import quoted


def anchor_week(day: Column) -> Column:
    """Week of a day number; halves round to the even week."""
    return F.bround(day / F.lit(7.0))


@dataclass(frozen=True)
class SeriesSpec:
    """``patterns`` maps an output suffix to the regex of that series' columns.

    ``base`` is the week of the first series column and ``n`` the number of weeks to take.
    """

    patterns: Mapping[str, str]
    day: str
    n: int = 20
    base: int = 14
    prefix: str = "Wk"
    totals: bool = True
    drop: bool = True

    def sources(self, names: Sequence[str]) -> dict[str, list[str]]:
        return {s: sorted(c for c in names if re.fullmatch(p, c)) for s, p in self.patterns.items()}


def aligned_window(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add, for each series, the values of the ``n`` weeks from the row's anchor week on.

    Positions before or after the series take its first or last column, a missing value counts as
    zero, and a row without an anchor gets nulls. ``<prefix>NNTotal<suffix>`` is the running total
    of the weeks 0..NN. Three projections over the row; no shuffle and no generator.
    """
    sources = {s: cols for s, cols in spec.sources(df.columns).items() if cols}
    week = f"{spec.prefix}Anchor"
    staged = df.select(*[quoted(c) for c in df.columns], anchor_week(quoted(spec.day)).alias(week))
    first = F.col(week).cast("int") - F.lit(spec.base)
    used = {c for cols in sources.values() for c in cols} if spec.drop else set()
    kept = [quoted(c) for c in [*df.columns, week] if c not in used]
    windowed = staged.select(*kept, *[_slice(cols, first, spec.n).alias(f"__{s}") for s, cols in sources.items()])

    weeks = [F.get(F.col(f"__{s}"), F.lit(i)).alias(f"{spec.prefix}{i:02d}{s}") for s in sources for i in range(spec.n)]
    aligned = windowed.select(*kept, *weeks)

    totals = []
    if spec.totals:
        for s in sources:
            running = F.col(f"{spec.prefix}00{s}")
            for i in range(1, spec.n):
                running = running + F.col(f"{spec.prefix}{i:02d}{s}")
                totals.append(running.alias(f"{spec.prefix}{i:02d}Total{s}"))
    return aligned.select("*", *totals)


def _slice(cols: Sequence[str], first: Column, n: int) -> Column:
    """``n`` values from position ``first`` on, as one slice of the series padded with its end values."""
    values = [F.coalesce(quoted(c).cast("double"), F.lit(0.0)) for c in cols]
    padded = F.concat(F.array_repeat(values[0], n), F.array(*values), F.array_repeat(values[-1], n))
    start = F.least(F.greatest(first, F.lit(-n)), F.lit(len(cols))) + F.lit(n + 1)
    return F.when(first.isNotNull(), F.slice(padded, start, F.lit(n)))


def attach_unit_record(df: DataFrame, records: DataFrame, on: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Give every row of a unit that unit's one record: the first in ``order_by``.

    The first record is a combinable aggregate (no window over a unit's records), and a unit with
    very many rows is left to the adaptive skew join.
    """
    on = list(on)
    rest = [c for c in records.columns if c not in on]
    first = records.groupBy(*on).agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(c) for c in order_by])).alias("__r"))
    return df.join(first.select(*on, "__r.*"), on, "inner")
