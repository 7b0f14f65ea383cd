"""Row filters, fitted clamps and samples. Statistics are fitted once and then applied as literals,
so the same limits serve training and later data and the filters reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import columns_of, quoted
from wideframe.operators.quantiles import SMALL, exact_quantiles
from wideframe.session import stage


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _floating(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}


def _known(df: DataFrame, col: str) -> Column:
    """The column's value; null where it is NaN."""
    return F.when(~F.isnan(quoted(col)), quoted(col)) if col in _floating(df) else quoted(col)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Make NaN the same as null, in all columns or in ``cols``: at ingest, and before every fit here."""
    floating = _floating(df) & set(df.columns if cols is None else cols)
    return df.select(*[_known(df, c).alias(c) if c in floating else quoted(c) for c in df.columns])


def base_filter(df: DataFrame, in_: Mapping[str, Sequence] | None = None, not_null: Sequence[str] = (),
                positive: Sequence[str] = ()) -> DataFrame:
    """Rows with listed values, without nulls in ``not_null`` and above zero in ``positive``."""
    kept = [quoted(c).isin(*values) for c, values in (in_ or {}).items()]
    kept += [quoted(c).isNotNull() for c in not_null] + [quoted(c) > 0 for c in positive]
    return df.filter(_all(kept))


def range_filter(df: DataFrame, col: str, low, high) -> DataFrame:
    return df.filter(quoted(col).between(low, high))


def time_split(df: DataFrame, col: str, cut) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut`` and rows from ``cut`` on; prunes folders when ``col`` partitions the table."""
    return df.filter(quoted(col) < F.lit(cut)), df.filter(quoted(col) >= F.lit(cut))


@dataclass(frozen=True)
class OutlierBounds:
    """Fitted limits: ``cap`` on one column and a closed interval for every bounded column."""

    cap: tuple[str, float] | None
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Keep rows inside every interval; a null in a bounded column drops the row."""
        kept = [quoted(self.cap[0]) <= F.lit(self.cap[1])] if self.cap else []
        kept += [quoted(c).between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in self.bounds.items()]
        return df.filter(_all(kept))


def fit_outliers(df: DataFrame, cols: Sequence[str] | None = None, q: tuple[float, float] = (0.002, 0.998),
                 cap: tuple[str, float] | None = None, approx: bool = False, small: int = SMALL) -> OutlierBounds:
    """Fit quantile limits of every numeric column on the capped rows.

    Columns without any value get no limits, and NaN is no value. ``approx`` trades exact quantiles for one sketch pass.
    """
    columns = sorted(columns_of(df, "numeric") if cols is None else cols)
    capped = nan_to_null(OutlierBounds(cap).apply(df), columns)
    if approx:
        row = capped.agg(*[
            F.percentile_approx(quoted(c), F.array(F.lit(q[0]), F.lit(q[1])), 100_000).alias(c) for c in columns
        ]).first()
        found = {c: row[c] or [None, None] for c in columns}
    else:
        found = exact_quantiles(capped, columns, q, small=small)
    return OutlierBounds(cap, {c: (lo, hi) for c, (lo, hi) in found.items() if lo is not None and hi is not None})


def remove_outliers(df: DataFrame, cols: Sequence[str] | None = None, q: tuple[float, float] = (0.002, 0.998),
                    cap: tuple[str, float] | None = None, approx: bool = False) -> DataFrame:
    return fit_outliers(df, cols, q, cap, approx).apply(df)


@dataclass(frozen=True)
class Clamp:
    """Fitted limits of one column."""

    col: str
    low: float | None
    high: float | None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.low is None:
            return df
        value = _known(df, self.col)
        return df.withColumn(
            self.col, F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(self.low)), F.lit(self.high))))


def fit_winsor(df: DataFrame, col: str, k: float = 3, floor: float | None = 0) -> Clamp:
    """Limits at mean ± k sample standard deviations, the lower one not below ``floor``; NaN counts as null."""
    mean, sd = df.agg(F.avg(_known(df, col)), F.stddev_samp(_known(df, col))).first()
    if mean is None or sd is None:
        return Clamp(col, None, None)
    low = mean - k * sd
    return Clamp(col, low if floor is None else max(float(floor), low), mean + k * sd)


def winsorize(df: DataFrame, col: str, k: float = 3, floor: float | None = 0,
              fit_on: DataFrame | None = None) -> DataFrame:
    """Clamp ``col``; limits come from ``fit_on`` (the training rows) or else from ``df`` itself."""
    return fit_winsor(df if fit_on is None else fit_on, col, k, floor).apply(df)


@dataclass(frozen=True)
class Fill:
    """Fitted fill values per column."""

    values: Mapping[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.select(*[
            F.coalesce(_known(df, c), F.lit(self.values[c])).alias(c) if self.values.get(c) is not None else quoted(c)
            for c in df.columns
        ])


def fit_mean(df: DataFrame, cols: Sequence[str] | None = None) -> Fill:
    """Column means in one aggregation; NaN counts as null."""
    columns = columns_of(df, "numeric") if cols is None else list(cols)
    return Fill(df.agg(*[F.avg(_known(df, c)).alias(c) for c in columns]).first().asDict() if columns else {})


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return fit_mean(df, cols).apply(df)


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null and NaN become zero (``na.fill`` takes both)."""
    return df.na.fill(0, list(cols) if cols is not None else columns_of(df, "numeric"))


def sample_n(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` random rows without replacement.

    A random key is drawn once and written with the rows that can matter: keys below a threshold that all
    but surely leaves a few more than ``n``. The row count decides the threshold, so the top-n that follows
    sees about ``n`` rows whatever the size of the table; should the threshold leave too few, it is raised.
    """
    total, rows = df.count(), df.withColumn("__r", F.rand(seed))
    share = 1.0 if total <= n else min(1.0, (n + 6 * n**0.5 + 20) / total)
    while True:
        near = stage(rows.filter(F.col("__r") <= share), "sample")
        if share >= 1.0 or near.count() >= n:
            return near.orderBy("__r").limit(n).drop("__r")
        share = min(1.0, 2 * share)


def sample_frac(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A random fraction and its complement.

    Both sides test one hash of the row key, so they stay disjoint and complete however often and
    on whatever partitions the input is read again.
    """
    chosen = (F.pmod(F.xxhash64(*[quoted(k) for k in key], F.lit(seed)), F.lit(1 << 30)) <
              F.lit(int(fraction * (1 << 30))))
    return df.filter(chosen), df.filter(~chosen)


def holdout_split(df: DataFrame, ids: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Training rows (id not in the list) and hold-out rows (id in the list)."""
    listed = ids.select(on).distinct()
    return df.join(listed, on, "left_anti"), df.join(listed, on, "left_semi")


def complement(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    return df.join(part.select(key), key, "left_anti")
