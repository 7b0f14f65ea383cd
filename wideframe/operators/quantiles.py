"""Exact quantiles with linear interpolation, for whole columns and per group.

Small inputs use Spark's ``percentile``. That aggregate keeps every distinct value of a group in
one task, so above ``small`` rows the order statistic is found differently: a sketch proposes a
bracket around the wanted rank, exact counts confirm it, and only the rows in the bracket are ranked
(through range slices). The result is exact either way; the sketch only decides how much is ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideframe.operators.ranks import broadcast_if_small, null_safe_join, running_totals
from wideframe.session import stage

SMALL = 1_000_000
ACCURACY = 10_000
COLUMNS_PER_PASS = 50
MAX_ROUNDS = 4


def _array(values: Sequence[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def _passes(items: list, size: int = COLUMNS_PER_PASS):
    return [items[i:i + size] for i in range(0, len(items), size)]


@dataclass
class _Bracket:
    """Where one order statistic of one column lies: ``below`` rows are smaller than ``low``."""

    column: str
    prob: float
    n: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0

    def __post_init__(self):
        self.inside = self.inside or self.n
        position = self.prob * (self.n - 1)
        self.first, self.last = math.floor(position), math.ceil(position)
        self.fraction = position - self.first

    def contains(self):
        value = F.col(f"`{self.column}`").cast("double")
        kept = value.isNotNull()
        if self.low is not None:
            kept = kept & (value >= F.lit(self.low))
        if self.high is not None:
            kept = kept & (value <= F.lit(self.high))
        return kept, value


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], small: int = SMALL,
                    accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles of whole columns; a column without values gives nulls.

    Only statistics reach the driver: one row per pass over at most ``COLUMNS_PER_PASS`` columns.
    """
    counts: dict[str, int] = {}
    for batch in _passes(list(columns)):
        counts |= df.agg(*[F.count(f"`{c}`").alias(c) for c in batch]).first().asDict()

    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    direct = [c for c in columns if 0 < counts[c] <= small]
    for batch in _passes(direct):
        row = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), _array(probs)).alias(c) for c in batch]).first()
        found |= {c: list(row[c]) for c in batch}

    brackets = [_Bracket(c, p, counts[c]) for c in columns if counts[c] > small for p in probs]
    for _ in range(MAX_ROUNDS):
        wide = [b for b in brackets if b.inside > small and b.low != b.high or b.low is None]
        if not wide or not any([_narrow(df, batch, accuracy) for batch in _passes(wide)]):
            break
    for batch in _passes(brackets):
        for bracket, value in _pick(df, batch):
            found[bracket.column][list(probs).index(bracket.prob)] = value
    return found


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> bool:
    """One sketch pass and one counting pass; returns whether any bracket became smaller."""
    slack = 2.0 / accuracy
    sketches = []
    for i, b in enumerate(brackets):
        kept, value = b.contains()
        ends = [max(0.0, (b.first - b.below) / b.inside - slack), min(1.0, (b.last - b.below) / b.inside + slack)]
        sketches.append(F.percentile_approx(F.when(kept, value), _array(ends), accuracy).alias(f"b{i}"))
    proposed = df.agg(*sketches).first()

    counters = []
    for i, b in enumerate(brackets):
        value = F.col(f"`{b.column}`").cast("double")
        low, high = proposed[f"b{i}"]
        counters += [F.count_if(value < F.lit(low)).alias(f"below{i}"),
                     F.count_if(value <= F.lit(high)).alias(f"upto{i}")]
    counted = df.agg(*counters).first()

    smaller = False
    for i, b in enumerate(brackets):
        low, high = proposed[f"b{i}"]
        below, upto = counted[f"below{i}"], counted[f"upto{i}"]
        if below <= b.first and b.last < upto and upto - below < b.inside:
            b.low, b.high, b.below, b.inside = low, high, below, upto - below
            smaller = True
    return smaller


def _pick(df: DataFrame, brackets: list[_Bracket]):
    """Rank the rows inside each bracket and read off the two values next to each position."""
    cells = []
    for i, b in enumerate(brackets):
        kept, value = b.contains()
        cells.append(F.when(kept, F.struct(F.lit(i).alias("target"), value.alias("value"))))
    inside = (
        df.select(F.inline(F.filter(F.array(*cells), lambda cell: cell.isNotNull())))
        .groupBy("target", "value").agg(F.count("*").alias("n"))
    )
    wanted = F.create_map(*[F.lit(x) for i, b in enumerate(brackets) for x in (i, float(b.first - b.below))])
    wanted_last = F.create_map(*[F.lit(x) for i, b in enumerate(brackets) for x in (i, float(b.last - b.below))])
    placed = running_totals(inside, ["target"], ["value"], "n")
    end = F.col("before") + F.col("n")
    hits = placed.select(
        "target", "value",
        ((F.col("before") <= wanted[F.col("target")]) & (wanted[F.col("target")] < end)).alias("is_first"),
        ((F.col("before") <= wanted_last[F.col("target")]) & (wanted_last[F.col("target")] < end)).alias("is_last"),
    ).filter("is_first or is_last").collect()  # at most two rows per bracket
    first = {h["target"]: h["value"] for h in hits if h["is_first"]}
    last = {h["target"]: h["value"] for h in hits if h["is_last"]}
    return [(b, first[i] + (last[i] - first[i]) * b.fraction) for i, b in enumerate(brackets)]


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], small: int = SMALL,
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with ``quantiles``, an array in the order of ``probs``.

    Groups of at most ``small`` rows go through ``percentile``. The others are few (fewer than
    rows / ``small``) and are bracketed per group, so no task holds a whole large group. A sketch grows with
    ``accuracy``, and each task holds one per large group; a bracket holds ``6 / accuracy`` of its group's rows.
    """
    by = list(by)
    rows = df.select(*by, F.col(f"`{value}`").cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    if (sizes.agg(F.max("__n")).first()[0] or 0) <= small:
        return rows.groupBy(*by).agg(F.percentile("__v", _array(probs)).alias("quantiles"))

    large = stage(sizes.filter(F.col("__n") > small), "large-groups")
    n_large = large.count()
    hint = broadcast_if_small(large, n_large)
    few = (
        null_safe_join(rows, broadcast_if_small(large.select(*by), n_large), by, "left_anti")
        .groupBy(*by).agg(F.percentile("__v", _array(probs)).alias("quantiles"))
    )
    many = null_safe_join(rows, hint, by)

    slack = 3.0 / accuracy
    pending, done = large, []
    while True:
        bracketed = _bracket_groups(many, by, probs, slack, accuracy)
        counted = _count_groups(null_safe_join(rows, broadcast_if_small(pending, n_large), by), bracketed, by, probs,
                                n_large)
        counted = stage(counted, "brackets")
        exact = F.forall("targets", lambda t: (t["below"] <= t["first"]) & (t["last"] < t["below"] + t["inside"]))
        done.append(counted.filter(exact))
        pending = counted.filter(~exact).select(*by, "__n")
        if pending.isEmpty():
            break
        many = null_safe_join(rows, broadcast_if_small(pending, n_large), by)
        slack = min(1.0, slack * 8)
    brackets = done[0]
    for more in done[1:]:
        brackets = brackets.unionByName(more)
    return few.unionByName(_pick_groups(rows, brackets, by, n_large))


def _bracket_groups(many: DataFrame, by, probs, slack: float, accuracy: int) -> DataFrame:
    ends = [e for p in probs for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketched = many.groupBy(*by, "__n").agg(F.percentile_approx("__v", _array(ends), accuracy).alias("__ends"))
    targets = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("__n") - 1)
        targets.append(F.struct(
            F.lit(i).alias("target"), F.col("__ends")[2 * i].alias("low"), F.col("__ends")[2 * i + 1].alias("high"),
            F.floor(position).alias("first"), F.ceil(position).alias("last"),
            (position - F.floor(position)).alias("fraction"),
        ))
    return stage(sketched.select(*by, F.array(*targets).alias("targets")), "sketches")


def _count_groups(rows: DataFrame, bracketed: DataFrame, by, probs, n_groups: int) -> DataFrame:
    joined = null_safe_join(rows, broadcast_if_small(bracketed, n_groups), by)
    counters = [
        F.struct(F.count_if(F.col("__v") < F.col("targets")[i]["low"]).alias("below"),
                 F.count_if(F.col("__v").between(F.col("targets")[i]["low"], F.col("targets")[i]["high"]))
                 .alias("inside")).alias(f"c{i}")
        for i in range(len(probs))
    ]
    counted = joined.groupBy(*by, "__n").agg(F.first("targets").alias("targets"), *counters)
    merged = F.zip_with(
        "targets", F.array(*[F.col(f"c{i}") for i in range(len(probs))]),
        lambda t, c: F.struct(*[t[f].alias(f) for f in ("target", "low", "high", "first", "last", "fraction")],
                              c["below"].alias("below"), c["inside"].alias("inside")))
    return counted.select(*by, "__n", merged.alias("targets"))


def _pick_groups(rows: DataFrame, brackets: DataFrame, by, n_groups: int) -> DataFrame:
    joined = null_safe_join(rows, broadcast_if_small(brackets, n_groups), by)
    hits = F.filter("targets", lambda t: F.col("__v").between(t["low"], t["high"]))
    inside = (
        joined.select(*by, "__v", F.inline(hits))
        .groupBy(*by, "target", "first", "last", "below", "fraction", "__v").agg(F.count("*").alias("n"))
    )
    placed = running_totals(inside, [*by, "target"], ["__v"], "n")
    at = F.col("below") + F.col("before")
    first = F.when((at <= F.col("first")) & (F.col("first") < at + F.col("n")), F.col("__v"))
    last = F.when((at <= F.col("last")) & (F.col("last") < at + F.col("n")), F.col("__v"))
    found = placed.groupBy(*by, "target", "fraction").agg(F.max(first).alias("v0"), F.max(last).alias("v1"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("fraction")
    return (
        found.select(*by, "target", value.alias("value"))
        .groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("target", "value"))).alias("found"))
        .select(*by, F.transform("found", lambda f: f["value"]).alias("quantiles"))
    )
