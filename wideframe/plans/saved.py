"""Fitted features as a Spark ML stage that can be saved, also inside a pipeline, and read in another session.

What was learned lies in one folder: the roles and fitted numbers as JSON in the stage's metadata, the dictionary of labels as a table beside it, so
that labels of any number are neither held nor written by the driver.
"""

from __future__ import annotations

import dataclasses
import json
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.functions.flags import Family
from wideframe.functions.series import SeriesSpec
from wideframe.operators.categories import CategoryDictionary
from wideframe.operators.filters import Fill, OutlierBounds
from wideframe.plans.features import FeatureConfig, FeatureModel, clean, fit_features, shape
from wideframe.session import stage
from wideframe.sources.tables import write_table

_KINDS = {c.__name__: c for c in (FeatureConfig, Family, SeriesSpec, Fill, OutlierBounds)}


def to_plain(value: Any) -> Any:
    """Nested settings as what JSON can hold; tuples, ranges and the settings classes are named."""
    if type(value).__name__ in _KINDS and dataclasses.is_dataclass(value):
        return {"kind": type(value).__name__, "fields": {f.name: to_plain(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if isinstance(value, range):
        return {"kind": "range", "fields": [value.start, value.stop, value.step]}
    if isinstance(value, tuple):
        return {"kind": "tuple", "fields": [to_plain(v) for v in value]}
    if isinstance(value, dict):
        return {"kind": "dict", "fields": [[to_plain(k), to_plain(v)] for k, v in value.items()]}
    if isinstance(value, list):
        return [to_plain(v) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"cannot save a {type(value).__name__}")


def from_plain(value: Any) -> Any:
    if isinstance(value, list):
        return [from_plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    kind, fields = value["kind"], value["fields"]
    if kind == "range":
        return range(*fields)
    if kind == "tuple":
        return tuple(from_plain(v) for v in fields)
    if kind == "dict":
        return {from_plain(k): from_plain(v) for k, v in fields}
    return _KINDS[kind](**{name: from_plain(v) for name, v in fields.items()})


def feature_settings(model: FeatureModel) -> str:
    """All of a ``FeatureModel`` but its dictionary's entries."""
    return json.dumps({f.name: to_plain(getattr(model, f.name)) for f in dataclasses.fields(FeatureModel) if f.name != "dictionary"}
                      | {"columns": list(model.dictionary.columns)})


def write_features(model: FeatureModel, path: str) -> None:
    """A ``FeatureModel`` in one folder: its settings as text, its dictionary as a table."""
    spark = model.dictionary.entries.sparkSession
    write_table(model.dictionary.entries, f"{path}/dictionary")
    spark.createDataFrame([(feature_settings(model),)], "value string").coalesce(1).write.text(f"{path}/settings")


def read_features(spark: SparkSession, path: str) -> FeatureModel:
    return _model(spark, spark.read.text(f"{path}/settings").first()["value"], f"{path}/dictionary")


def _model(spark: SparkSession, settings: str, dictionary: str) -> FeatureModel:
    found = json.loads(settings)
    columns = tuple(found.pop("columns"))
    return FeatureModel(**{name: from_plain(v) for name, v in found.items()}, dictionary=CategoryDictionary(spark.read.parquet(dictionary), columns))


class FeatureTransformer(Model, HasOutputCol, MLWritable, MLReadable):
    """Raw wide rows to row key, roles and one sparse vector of numbers and dummies, by what was fitted.

    Rows to score need not have the label, which is null then. No row is dropped; labels that the dictionary lacks have no dummy.
    """

    def __init__(self, fitted: FeatureModel | None = None, output: str = "features"):
        super().__init__()
        self.fitted = fitted
        self._set(outputCol=output)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cfg = self.fitted.cfg
        shaped = shape(clean(dataset, cfg), cfg, drop=True)
        unlabelled = cfg.label not in shaped.columns
        shaped = shaped.withColumn(cfg.label, F.lit(None).cast("double")) if unlabelled else shaped
        rows = self.fitted.transform(shaped).vector(self.getOutputCol())
        return rows.withColumn(cfg.label, F.lit(None).cast("double")) if unlabelled else rows

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: FeatureTransformer):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"settings": feature_settings(self.instance.fitted)})
        write_table(self.instance.fitted.dictionary.entries, f"{path}/dictionary")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureTransformer:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        made = self.cls(_model(self.sparkSession, metadata["settings"], f"{path}/dictionary"))
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class FeatureEstimator(Estimator, HasOutputCol):
    """Fits fills, outlier limits and dictionary on raw wide rows, as ``feature_set`` does, to a stage that can be saved."""

    staged = Param(Params._dummy(), "staged", "write the shaped rows once, as every fit reads them", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, cfg: FeatureConfig, outputCol: str = "features", staged: bool = True):
        super().__init__()
        self.cfg = cfg
        self._set(outputCol=outputCol, staged=staged)

    def _fit(self, dataset: DataFrame) -> FeatureTransformer:
        shaped = shape(clean(dataset, self.cfg), self.cfg, drop=True)
        shaped = stage(shaped, "shaped") if self.getOrDefault(self.staged) else shaped
        return self.fit_shaped(shaped)

    def fit_shaped(self, shaped: DataFrame) -> FeatureTransformer:
        """What ``fit`` learns, from rows that went through ``clean`` and ``shape`` already, for callers that need those too."""
        return FeatureTransformer(fit_features(shaped, self.cfg), self.getOutputCol())
