"""From raw wide rows to an encoded feature set.

Which columns play which part is configuration. What is learned from data (fill values, outlier
limits, category dictionary) is fitted once in a ``FeatureModel`` and then applied to any frame.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.functions.flags import (DATE_FORMATS, NULL_LABELS, Family, biweek_columns, exists_flags,
                                       normalize_labels, prev_delta, slot_totals)
from wideframe.functions.series import SeriesSpec, aligned_window, attach_unit_record
from wideframe.operators.categories import DUMMY_SEP, CategoryDictionary, dummy_vector, fit_dictionary, one_hot, one_hot_long
from wideframe.operators.columns import (align_features, columns_of, drop_columns, drop_matching, keep_numbered,
                                         lower_names, quoted, rename, sanitize_names)
from wideframe.operators.filters import Fill, OutlierBounds, fill_zero, fit_mean, fit_outliers
from wideframe.operators.spatial import polygons_with_points
from wideframe.session import stage
from wideframe.sources.tables import to_sparse_long, write_csv, write_table


@dataclass(frozen=True)
class FeatureConfig:
    """Roles of the columns of a wide table."""

    key: Sequence[str]
    label: str
    group: str
    weight: str | None = None
    renames: Mapping[str, str] = field(default_factory=dict)
    drop_substrings: Sequence[str] = ()
    numbered: tuple[str, range] | None = None
    date_pattern: str | None = None
    date_formats: Sequence[str] = DATE_FORMATS
    flags: Mapping[str, Sequence[str]] = field(default_factory=dict)
    families: Sequence[Family] = ()
    series: SeriesSpec | None = None
    series_names: str | None = None
    deltas: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    exclude: Sequence[str] = ()
    label_dependent: Sequence[str] = ()
    number_labels: Sequence[str] = ()
    null_labels: Sequence[str] = NULL_LABELS
    cap: tuple[str, float] | None = None
    quantiles: tuple[float, float] = (0.002, 0.998)
    include_ids: bool = False

    def meta(self) -> list[str]:
        return list(dict.fromkeys([*self.key, self.group, *([self.weight] if self.weight else [])]))

    def dropped(self) -> list[str]:
        kept = {*self.meta(), self.label}
        return [c for c in (*self.exclude, *self.label_dependent) if c not in kept]

    def statistics_columns(self, df: DataFrame) -> list[str]:
        """Numeric columns that fills and outlier limits are fitted on: features and label, and the
        id and weight columns too with ``include_ids``. Numbers that are labels are left alone."""
        spared = {*self.dropped(), *self.number_labels, *(() if self.include_ids else self.meta())}
        return [c for c in columns_of(df, "numeric") if c not in spared]


def clean(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """Rename, drop unwanted columns, drop numbered columns out of range."""
    df = drop_matching(rename(df, cfg.renames), cfg.drop_substrings)
    return keep_numbered(df, *cfg.numbered) if cfg.numbered else df


def shape(df: DataFrame, cfg: FeatureConfig, biweek: bool = False, drop: bool = False,
          conditional_delta: bool = True) -> DataFrame:
    """Date labels (on request), existence flags, slot totals, aligned series, previous-season deltas."""
    if biweek:
        df = _date_labels(df, cfg, drop)
    df = slot_totals(exists_flags(df, cfg.flags, drop), cfg.families, drop)
    df = _aligned(df, cfg, drop)
    return prev_delta(df, cfg.deltas, conditional_delta, drop)


def _date_labels(df: DataFrame, cfg: FeatureConfig, drop: bool) -> DataFrame:
    dates = [c for c in df.columns if cfg.date_pattern and re.search(cfg.date_pattern, c)]
    return biweek_columns(df, dates, drop, cfg.date_formats) if dates else df


def _aligned(df: DataFrame, cfg: FeatureConfig, drop: bool) -> DataFrame:
    if cfg.series is None:
        return df
    named = lower_names(df, cfg.series_names) if cfg.series_names else df
    return aligned_window(named, replace(cfg.series, drop=drop))


@dataclass
class FeatureSet:
    """One keyed frame with its column roles and the dictionary of its label columns."""

    frame: DataFrame
    key: Sequence[str]
    label: str
    group: str
    weight: str | None
    numeric: Sequence[str]
    labels: Sequence[str]
    dictionary: CategoryDictionary
    complete: bool = False  # the dictionary was fitted on these very rows, so it has all of their labels

    def part(self, name: str) -> DataFrame:
        """A column subset by role (``numeric``, ``labels``, ``label``, ``group``, ``weight``) with the row key."""
        roles = {"numeric": self.numeric, "labels": self.labels, "label": [self.label], "group": [self.group],
                 "weight": [self.weight] if self.weight else []}
        return self.frame.select(*dict.fromkeys([*self.key, *roles[name]]))

    def wide(self) -> DataFrame:
        """Numeric columns and one column per category label."""
        return one_hot(self.frame, self.dictionary)

    def long(self) -> DataFrame:
        """The same as non-zero ``(row key, feature, value)`` triples, for any number of labels."""
        numbers = to_sparse_long(self.frame, self.numeric, self.key)
        return numbers.unionByName(one_hot_long(self.frame, self.labels, self.key, None if self.complete else self.dictionary))

    def vector(self, output: str = "features") -> DataFrame:
        """Row key, roles and one sparse vector of numeric columns and dummies, for any number of labels; NaN stands for null."""
        rows = dummy_vector(self.frame, self.dictionary, "__dummies")
        kept = dict.fromkeys([*self.key, self.label, self.group, *([self.weight] if self.weight else [])])
        parts = VectorAssembler(inputCols=[*self.numeric, "__dummies"], outputCol=output, handleInvalid="keep")
        return parts.transform(rows).select(*[quoted(c) for c in kept], output)

    def features(self) -> list[str]:
        """Names in the order of ``wide`` and ``vector``; refused above ``MAX_DUMMY_COLUMNS`` as ``wide`` is."""
        found = self.dictionary.labels()
        return [*self.numeric, *[f"{c}{DUMMY_SEP}{v}" for c in self.labels for v in found[c]]]

    def write(self, path: str) -> None:
        """Rows, dictionary and roles, each as one table under ``path``."""
        spark = self.frame.sparkSession
        write_table(self.frame, f"{path}/rows")
        write_table(self.dictionary.entries, f"{path}/dictionary")
        roles = json.dumps({"key": list(self.key), "label": self.label, "group": self.group, "weight": self.weight,
                            "numeric": list(self.numeric), "labels": list(self.labels)})
        spark.createDataFrame([(roles,)], "value string").coalesce(1).write.text(f"{path}/roles")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureSet":
        roles = json.loads(spark.read.text(f"{path}/roles").first()["value"])
        dictionary = CategoryDictionary(spark.read.parquet(f"{path}/dictionary"), tuple(roles["labels"]))
        return FeatureSet(spark.read.parquet(f"{path}/rows"), dictionary=dictionary, **roles)


@dataclass(frozen=True)
class FeatureModel:
    """Everything learned from the training rows."""

    cfg: FeatureConfig
    fill: Fill
    bounds: OutlierBounds
    numeric: Sequence[str]
    labels: Sequence[str]
    dictionary: CategoryDictionary

    def transform(self, shaped: DataFrame, drop_outliers: bool = False) -> FeatureSet:
        """Apply to shaped rows; only training tables drop outliers. Stateless, so it also takes a stream."""
        filled = self.fill.apply(shaped)
        rows = self.bounds.apply(filled) if drop_outliers else filled
        kept = list(dict.fromkeys([*self.cfg.meta(), self.cfg.label, *self.numeric, *self.labels]))
        return FeatureSet(normalize_labels(rows.select(*[quoted(c) for c in kept]), self.labels, self.cfg.null_labels),
                          list(self.cfg.key), self.cfg.label, self.cfg.group, self.cfg.weight, list(self.numeric),
                          list(self.labels), self.dictionary)


def fit_features(shaped: DataFrame, cfg: FeatureConfig, fill: str = "mean", outliers: bool = True) -> FeatureModel:
    """Fit fills, outlier limits and dictionary on shaped training rows.

    Each fit is an aggregation over all columns at once; limits are fitted on filled rows and the
    dictionary on the rows that are left.
    """
    columns = cfg.statistics_columns(shaped)
    filler = fit_mean(shaped, columns) if fill == "mean" else Fill({c: 0.0 for c in columns})
    filled = filler.apply(shaped)
    bounds = fit_outliers(filled, columns, cfg.quantiles, cfg.cap) if outliers else OutlierBounds(None)
    gone = {*cfg.dropped(), *cfg.meta(), cfg.label}
    numeric = [c for c in columns_of(shaped, "numeric") if c not in gone and c not in cfg.number_labels]
    labels = [c for c in [*columns_of(shaped, "label"), *cfg.number_labels] if c in shaped.columns and c not in gone]
    kept = normalize_labels(bounds.apply(filled), labels, cfg.null_labels)
    return FeatureModel(cfg, filler, bounds, numeric, labels, fit_dictionary(kept, labels))


def feature_set(df: DataFrame, cfg: FeatureConfig, staged: bool = True) -> FeatureSet:
    """Clean, shape, fill with means, drop outliers, normalise labels, fit the dictionary.

    The shaped rows are read by every fit, so by default they are written once and read back.
    """
    shaped = shape(clean(df, cfg), cfg, drop=True)
    shaped = stage(shaped, "shaped") if staged else shaped
    return replace(fit_features(shaped, cfg).transform(shaped, drop_outliers=True), complete=True)


def encode_raw(df: DataFrame, cfg: FeatureConfig, staged: bool = True) -> FeatureSet:
    """Older order of steps: date labels come after the slot totals (so they survive), deltas are
    unconditional, nulls become zero and no outliers are dropped."""
    shaped = _date_labels(shape(df, cfg, drop=True, conditional_delta=False), cfg, drop=True)
    shaped = stage(shaped, "shaped") if staged else shaped
    return replace(fit_features(shaped, cfg, fill="zero", outliers=False).transform(shaped), complete=True)


def shape_to_csv(df: DataFrame, cfg: FeatureConfig, path: str) -> None:
    """Cleaned and shaped rows with date labels as a typed CSV export."""
    write_csv(drop_columns(shape(clean(df, cfg), cfg, biweek=True, drop=True), cfg.dropped()), path)


def shape_labels(df: DataFrame, group_cols: Sequence[str], ids: Sequence[str] = (),
                 nulls: Sequence[str] = ("none", ""), form: str = "columns") -> DataFrame:
    """Lower-cased labels, dummies of the group columns, ids dropped, nulls to zero, safe names.

    ``form`` is ``columns`` (one per label, refused above ``MAX_DUMMY_COLUMNS``) or ``vector`` (``dummies``, any number of labels).
    """
    lowered = normalize_labels(df, columns_of(df, "string"), nulls)
    dictionary = fit_dictionary(lowered, group_cols)
    hot = dummy_vector(lowered, dictionary).drop(*group_cols) if form == "vector" else one_hot(lowered, dictionary)
    return sanitize_names(fill_zero(drop_columns(hot, ids)))


def shape_group_cells(df: DataFrame, cfg: FeatureConfig) -> tuple[DataFrame, CategoryDictionary]:
    """Cleaned and shaped rows with date labels, and the dictionary of their label columns."""
    shaped = drop_columns(shape(clean(df, cfg), cfg, biweek=True, drop=True), cfg.dropped())
    labels = [c for c in columns_of(shaped, "label") if c not in cfg.meta()]
    rows = normalize_labels(shaped, labels, cfg.null_labels)
    return rows, fit_dictionary(rows, labels)


def dummies_for(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Bring label columns to a model's ``column__DUMMY__label`` features and align the rest.

    The features name the labels, so nothing is fitted and a label the model lacks adds no column.
    Returns the aligned frame and the numeric columns the model does not use.
    """
    wanted = [f.split(DUMMY_SEP, 1) for f in features if DUMMY_SEP in f]
    here = [(c, v) for c, v in wanted if c in df.columns]
    sources = {c for c, _ in here}
    hot = df.select(
        *[quoted(c) for c in df.columns if c not in sources or c in keep],
        *[quoted(c).cast("string").eqNullSafe(F.lit(v)).cast("int").alias(f"{c}{DUMMY_SEP}{v}") for c, v in here])
    return align_features(hot, features, keep)


def assemble_holdout(cells: DataFrame, points: DataFrame, records: DataFrame, features: Sequence[str],
                     cell_id: str, unit: str, record_order: Sequence[str], keep: Sequence[str] = (),
                     nulls: Sequence[str] = ("none", "")) -> tuple[DataFrame, list[str]]:
    """Hold-out rows for a model: cells that hold a point, with their unit's record, aligned to the features.

    All units go through one job.
    """
    held = attach_unit_record(polygons_with_points(cells, points, cell_id), records, [unit], record_order)
    lowered = normalize_labels(held, columns_of(held, "string"), nulls)
    aligned, unknown = dummies_for(lowered, features, [cell_id, unit, *keep])
    return fill_zero(aligned, [f for f in features]), unknown
