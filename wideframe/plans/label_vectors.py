"""A dummy encoder of any number of labels as a Spark ML stage that is saved, alone or in a pipeline, and read in another session.

The fitted labels are a table: they are never held by the driver, they are joined to the rows, and they are saved beside the stage's metadata.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideframe.operators.categories import DUMMY_SEP, NULL_CLASS, CategoryDictionary, dummy_vector, fit_dictionary
from wideframe.operators.columns import quoted
from wideframe.session import stage
from wideframe.sources.tables import write_table


class LabelVectorizerModel(Model, HasInputCols, HasOutputCol, MLWritable, MLReadable):
    """Label columns to one sparse vector; the columns stay.

    Per column the entries are first nulls, if fitting saw any, and then the labels in binary order. A label that fitting did not see,
    and a null where it saw none, is an all-zero block. No row is dropped.
    """

    def __init__(self, dictionary: CategoryDictionary | None = None, null_classes: Sequence[str] = (), output: str = "dummies"):
        super().__init__()
        self.dictionary, self.null_classes = dictionary, tuple(null_classes)
        self._set(inputCols=list(dictionary.columns) if dictionary else [], outputCol=output)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dummy_vector(dataset, self.dictionary, self.getOutputCol(), null_classes=self.null_classes)

    def sizes(self) -> dict[str, int]:
        """Number of entries of each column."""
        return {c: n + int(c in self.null_classes) for c, n in self.dictionary.sizes().items()}

    def names(self) -> DataFrame:
        """``entry, column, label, feature``, a row for each place of the vector; the label of nulls is null."""
        sizes, offsets, before = self.sizes(), {}, 0
        for c in self.dictionary.columns:
            offsets[c], before = before, before + sizes[c]
        spark = self.dictionary.entries.sparkSession
        starts = spark.createDataFrame([(c, offsets[c], int(c in self.null_classes)) for c in offsets], "column string, start long, shift int")
        labels = self.dictionary.entries.join(F.broadcast(starts), "column").select(  # a row per column
            (F.col("start") + F.col("shift") + F.col("code")).alias("entry"), "column", "label")
        nulls = starts.filter("shift = 1").select(F.col("start").alias("entry"), "column", F.lit(None).cast("string").alias("label"))
        return labels.unionByName(nulls).withColumn("feature", F.concat("column", F.lit(DUMMY_SEP), F.coalesce("label", F.lit(NULL_CLASS))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: LabelVectorizerModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"nullClasses": list(self.instance.null_classes)})
        write_table(self.instance.dictionary.entries, f"{path}/dictionary")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LabelVectorizerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        columns = tuple(metadata["paramMap"]["inputCols"])
        made = self.cls(CategoryDictionary(self.sparkSession.read.parquet(f"{path}/dictionary"), columns), metadata["nullClasses"])
        made._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(made, metadata)
        return made


class LabelVectorizer(Estimator, HasInputCols, HasOutputCol):
    """Fits the labels of ``inputCols``. A column without labels and nulls has no entries; it is an error if no column has any."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str], outputCol: str = "dummies"):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> LabelVectorizerModel:
        cols = self.getInputCols()
        fitted = fit_dictionary(dataset, cols)
        dictionary = CategoryDictionary(stage(fitted.entries, "labels"), fitted.columns)
        seen = dataset.agg(*[F.max(quoted(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        nulls = [c for i, c in enumerate(cols) if seen[f"n{i}"]]
        if not nulls and not any(dictionary.sizes().values()):
            raise ValueError(f"no labels to fit in {cols}")
        return LabelVectorizerModel(dictionary, nulls, self.getOutputCol())
