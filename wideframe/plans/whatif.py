"""Vary one input over a grid, predict, and find each row's best value."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import quoted

UNROLLED = 64

Scorer = Callable[[Column], Column] | Transformer


@dataclass(frozen=True)
class Sweep:
    """Grid values ``low``, ``low + step``, … below ``high``."""

    low: int
    high: int
    step: int

    def points(self) -> range:
        if self.high <= self.low:
            raise ValueError("an empty grid")
        return range(self.low, self.high, self.step)

    def values(self) -> Column:
        self.points()
        return F.sequence(F.lit(self.low), F.lit(self.high - 1), F.lit(self.step)).cast("array<double>")


def sweep_bounds(df: DataFrame, col: str, low: float, high: float, step: int, k: float = 2.5) -> Sweep:
    """Mean ± k sample deviations of the values in ``low..high``, rounded (halves to even)."""
    value = quoted(col)
    mean, sd = df.filter(value.between(low, high)).agg(F.avg(value), F.stddev_samp(value)).first()
    if mean is None or sd is None:
        raise ValueError(f"no spread of {col} between {low} and {high}")
    return Sweep(round(mean - k * sd), round(mean + k * sd), step)


def sweep_curve(df: DataFrame, scorer: Scorer, col: str, sweep: Sweep, keep: Sequence[str]) -> DataFrame:
    """``(keep…, col, prediction)`` for every row and grid value; rows are multiplied in place."""
    if isinstance(scorer, Transformer):
        others = [quoted(c) for c in df.columns if c != col]
        grid = df.select(*others, F.explode(sweep.values()).alias(col))
        return scorer.transform(grid).select(*keep, col, "prediction")
    scored = F.transform(sweep.values(), lambda x: F.struct(x.alias(col), scorer(x).alias("prediction")))
    return df.select(*keep, F.inline(scored))


def whatif(df: DataFrame, scorer: Scorer, col: str, sweep: Sweep, key: Sequence[str]) -> DataFrame:
    """``(key…, best, prediction)``: the grid value with the highest prediction, the smallest on ties.

    An expression scorer is evaluated in an array inside the row, without a shuffle; a short grid is
    written out, so that the scores are compiled code. A model needs
    one row per grid value; the maximum is combined before the shuffle, so one row per key travels.
    """
    if not isinstance(scorer, Transformer):
        def scored(x: Column) -> Column:
            return F.struct(scorer(x).alias("p"), (-x).alias("x"))

        points = sweep.points()
        if len(points) <= UNROLLED:
            best = F.array_max(F.array(*[scored(F.lit(float(x))) for x in points]))
        else:
            best = F.array_max(F.transform(sweep.values(), scored))
        return df.select(*key, best.alias("__b")).select(
            *key, (-F.col("__b.x")).alias("best"), F.col("__b.p").alias("prediction"))
    curve = sweep_curve(df, scorer, col, sweep, key)
    best = F.max(F.struct(F.col("prediction").alias("p"), (-F.col(col)).alias("x")))
    return curve.groupBy(*key).agg(best.alias("__b")).select(
        *key, (-F.col("__b.x")).alias("best"), F.col("__b.p").alias("prediction"))
