"""A fact table with its lookups, configured by names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import quoted


@dataclass(frozen=True)
class Lookup:
    """A table that is joined by equal keys: ``on`` maps columns of the rows so far to columns of ``table``.

    ``columns`` maps the columns taken to the names they get; an empty map takes none, and the lookup then only
    filters. ``how`` is ``inner`` (rows without a match go) or ``left``.
    """

    table: DataFrame
    on: Mapping[str, str]
    columns: Mapping[str, str] = field(default_factory=dict)
    how: str = "inner"


def assemble(facts: DataFrame, lookups: Sequence[Lookup], keep: Sequence[str] | None = None) -> DataFrame:
    """``facts`` joined with each lookup in turn; a later one may use what an earlier one brought.

    Only keys and taken columns are read from a lookup. Whether it is broadcast is left to its size. A
    name that is there already is refused. ``keep`` chooses the result's columns.
    """
    rows = facts
    for i, lookup in enumerate(lookups):
        if lookup.how not in ("inner", "left"):
            raise ValueError(f"a lookup is joined inner or left, not {lookup.how}")
        twice = sorted({n.lower() for n in lookup.columns.values()} & {c.lower() for c in rows.columns})
        if twice:
            raise ValueError(f"the rows already have {twice}")
        keys = [f"__key{i}_{j}" for j in range(len(lookup.on))]
        taken = lookup.table.select(*[quoted(theirs).alias(k) for k, theirs in zip(keys, lookup.on.values())],
                                    *[quoted(c).alias(n) for c, n in lookup.columns.items()])
        match = [quoted(mine) == F.col(k) for k, mine in zip(keys, lookup.on)]
        rows = rows.join(taken, match, lookup.how).drop(*keys)
    return rows if keep is None else rows.select(*[quoted(c) for c in keep])
