"""Category dictionaries: fitted on one table, applied to others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import quoted
from wideframe.operators.ranks import BROADCAST_ROWS, broadcast_if_small, running_totals

# How a dummy column is named after its source column and label, and the class of nulls.
DUMMY_SEP = "__DUMMY__"
NULL_CLASS = "__na__"

NULL_CODE = -1
MAP_LABELS = 64
MAX_DUMMY_COLUMNS = 5_000


def column_labels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct ``(column, label)`` pairs without nulls. Duplicates fall away before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("label")) for c in cols])
    return df.select(F.inline(pairs)).filter(F.col("label").isNotNull()).distinct()


@dataclass
class CategoryDictionary:
    """``entries`` has one row per (column, label) with ``code`` 0..k-1 in binary label order."""

    entries: DataFrame
    columns: tuple[str, ...]
    _sizes: dict[str, int] = field(default_factory=dict)
    _bytes: dict[str, int] = field(default_factory=dict)

    def sizes(self) -> dict[str, int]:
        """Number of labels per column."""
        if not self._sizes:
            counted = self.entries.groupBy("column").agg(  # one row per column
                F.count("*").alias("n"), F.sum(F.octet_length("label") + 40).alias("bytes")).collect()
            self._sizes = {c: 0 for c in self.columns} | {r["column"]: r["n"] for r in counted}
            self._bytes = {c: 0 for c in self.columns} | {r["column"]: r["bytes"] for r in counted}
        return self._sizes

    def bytes(self) -> dict[str, int]:
        """Size of each column's labels and codes as rows."""
        self.sizes()
        return self._bytes

    def labels(self, limit: int = MAX_DUMMY_COLUMNS) -> dict[str, list[str]]:
        """The labels themselves, for uses that need one column per label; refused above ``limit``."""
        total = sum(self.sizes().values())
        if total > limit:
            raise ValueError(f"{total} labels are more than {limit} columns; use one_hot_long or dummy_vector")
        found: dict[str, list[str]] = {c: [] for c in self.columns}
        for row in self.entries.orderBy("column", "code").collect():
            found[row["column"]].append(row["label"])
        return found

    def of(self, column: str) -> DataFrame:
        return self.entries.filter(F.col("column") == column).select("label", "code")


def fit_dictionary(df: DataFrame, cols: Sequence[str]) -> CategoryDictionary:
    """Sorted distinct labels of each column with their codes."""
    placed = running_totals(column_labels(df, cols), ["column"], ["label"], out="code")
    return CategoryDictionary(placed.select("column", "label", F.col("code").cast("int").alias("code")), tuple(cols))


def _no_label(df: DataFrame):
    """A join key for a null label that no label has, another one for each row, so that nulls do not meet in one task."""
    return F.concat(F.lit("\u0000"), F.xxhash64(*[quoted(c) for c in df.columns]).cast("string"))


def encode_codes(df: DataFrame, dictionary: CategoryDictionary, unknown: str = "null") -> DataFrame:
    """Replace labels by codes; a null label becomes -1.

    A label the dictionary lacks is treated like null, gets the ``next`` code (number of labels), or
    is an ``error``. Columns with few labels use a literal map. Larger ones are joined, broadcast only
    when their label count allows it.
    """
    if unknown not in ("null", "next", "error"):
        raise ValueError(f"unknown policy: {unknown}")
    sizes = dictionary.sizes()
    small = [c for c in dictionary.columns if 0 < sizes[c] <= MAP_LABELS]
    found = CategoryDictionary(dictionary.entries.filter(F.col("column").isin(*small)), tuple(small)).labels()

    codes = {}
    for c in dictionary.columns:
        label = quoted(c).cast("string")
        if c in small:
            pairs = [F.lit(x) for code, text in enumerate(found[c]) for x in (text, code)]
            codes[c] = F.create_map(*pairs)[label]
        elif sizes[c] == 0:
            codes[c] = F.lit(None).cast("int")
        else:
            lookup = dictionary.of(c).select(F.col("label").alias(f"__label_{c}"), F.col("code").alias(f"__code_{c}"))
            lookup = broadcast_if_small(lookup, sizes[c], dictionary.bytes()[c])
            df = df.join(lookup, F.coalesce(label, _no_label(df)) == F.col(f"`__label_{c}`"), "left").drop(f"__label_{c}")
            codes[c] = quoted(f"__code_{c}")

    missing = {
        "null": lambda c: F.lit(NULL_CODE),
        "next": lambda c: F.lit(sizes[c]),
        "error": lambda c: F.raise_error(F.concat(F.lit(f"unknown label in {c}: "), quoted(c).cast("string"))),
    }[unknown]

    def code(c: str):
        return (F.when(quoted(c).isNull(), F.lit(NULL_CODE)).when(codes[c].isNotNull(), codes[c])
                .otherwise(missing(c)).cast("int").alias(c))

    return df.select(*[code(c) if c in codes else quoted(c) for c in df.columns if not c.startswith("__code_")])


def decode_codes(df: DataFrame, dictionary: CategoryDictionary) -> DataFrame:
    """Replace codes by labels; a code without a label (null, unknown) becomes null."""
    sizes = dictionary.sizes()
    for c in dictionary.columns:
        lookup = dictionary.of(c).select(F.col("code").alias(f"__code_{c}"), F.col("label").alias(f"__label_{c}"))
        # Codes that stand for no label get keys of their own below all codes, so they do not meet in one task.
        code = F.when(quoted(c) >= 0, quoted(c)).otherwise((-2 - F.pmod(F.xxhash64(*[quoted(x) for x in df.columns]), F.lit(10_000))).cast("int"))
        df = df.join(broadcast_if_small(lookup, sizes[c], dictionary.bytes()[c]), code == quoted(f"__code_{c}"), "left")
    return df.select(*[
        quoted(f"__label_{c}").alias(c) if c in dictionary.columns else quoted(c)
        for c in df.columns if not c.startswith(("__code_", "__label_"))
    ])


def unknown_labels(df: DataFrame, dictionary: CategoryDictionary) -> DataFrame:
    """``(column, label)`` pairs of ``df`` that the dictionary lacks; null is no label."""
    return column_labels(df, dictionary.columns).join(
        dictionary.entries.select("column", "label"), ["column", "label"], "left_anti")


def dummy_name(column: str, label: str) -> str:
    return f"{column}{DUMMY_SEP}{label}"


def source_of(feature, sep: str = DUMMY_SEP):
    """Source column of a dummy column's name."""
    return F.substring_index(feature, sep, 1)


def one_hot(df: DataFrame, dictionary: CategoryDictionary, drop_first: bool = False,
            dummy_na: bool = False) -> DataFrame:
    """One 0/1 column per label, named after column and label; the label columns are replaced."""
    labels = dictionary.labels()
    dummies = []
    for c in dictionary.columns:
        text = quoted(c).cast("string")
        dummies += [text.eqNullSafe(F.lit(v)).cast("int").alias(dummy_name(c, v)) for v in labels[c][int(drop_first):]]
        if dummy_na:
            dummies.append(text.isNull().cast("int").alias(dummy_name(c, "nan")))
    return df.select(*[quoted(c) for c in df.columns if c not in dictionary.columns], *dummies)


def one_hot_long(df: DataFrame, cols: Sequence[str], row_id: Sequence[str],
                 dictionary: CategoryDictionary | None = None, drop_first: bool = False) -> DataFrame:
    """Dummies as ``(row id, feature, value)`` triples, for any number of labels.

    Without a dictionary every label counts, which needs no statistics and no shuffle. With one, columns with at most
    ``MAP_LABELS`` labels are looked up in literals, and only the others are joined.
    """
    def long(names: Sequence[str], labels: Sequence[Column]) -> DataFrame:
        cells = df.select(*row_id, F.posexplode(F.array(*labels)).alias("__cell", "label")).filter(F.col("label").isNotNull())
        return cells.select(*row_id, F.get(F.array(*[F.lit(c) for c in names]), F.col("__cell")).alias("column"), "label")

    def triples(rows: DataFrame) -> DataFrame:
        return rows.select(*row_id, F.concat("column", F.lit(DUMMY_SEP), "label").alias("feature"), F.lit(1.0).alias("value"))

    texts = {c: quoted(c).cast("string") for c in cols}
    if dictionary is None:
        return triples(long(list(texts), list(texts.values())))
    sizes, entries = dictionary.sizes(), dictionary.entries.filter(F.col("code") >= int(drop_first))
    few = [c for c in texts if sizes.get(c, 0) <= MAP_LABELS]
    found = CategoryDictionary(entries.filter(F.col("column").isin(*few)), tuple(few)).labels(MAP_LABELS * max(1, len(few))) if few else {}
    parts = [long(few, [F.when(texts[c].isin(*found[c]), texts[c]) for c in few])] if few else []
    many = [c for c in texts if c not in found]
    if many:
        known = broadcast_if_small(entries.filter(F.col("column").isin(*many)).select("column", "label"), sum(sizes[c] for c in many), sum(dictionary.bytes()[c] for c in many))
        parts.append(long(many, [texts[c] for c in many]).join(known, ["column", "label"], "left_semi"))
    return triples(reduce(DataFrame.unionByName, parts))


def dummy_vector(df: DataFrame, dictionary: CategoryDictionary, output: str = "dummies", drop_first: bool = False,
                 null_classes: Sequence[str] = ()) -> DataFrame:
    """Dummies of all label columns as one sparse vector, for any number of labels; the label columns stay.

    Labels become codes by a join and codes become entries by the sizes of the dictionary, so no label
    reaches the driver. A null or unknown label, and with ``drop_first`` the first, is an all-zero block. Entries
    follow the dictionary's columns and codes; in ``null_classes`` nulls have an entry of their own before the labels.
    """
    if output in df.columns:
        raise ValueError(f"column {output} already exists")
    sizes, columns = dictionary.sizes(), list(dictionary.columns)
    classes = {c: sizes[c] + int(c in null_classes) for c in columns}
    known = [c for c in columns if classes[c] > int(drop_first)]
    if not known:
        return df.withColumn(output, array_to_vector(F.array().cast("array<double>")))
    codes = [f"__dummy_{c}" for c in known]
    as_codes = CategoryDictionary(
        dictionary.entries.filter(F.col("column").isin(known)).withColumn("column", F.concat(F.lit("__dummy_"), "column")), tuple(codes))
    coded = encode_codes(df.select("*", *[quoted(c).alias(n) for c, n in zip(known, codes)]), as_codes)
    entries = {c: classes[c] - int(drop_first) for c in known}
    starts = dict(zip(known, accumulate(entries.values(), initial=0)))

    def place(c: str, n: str):
        code = quoted(n)
        if c in null_classes:
            code = F.when(quoted(c).isNull(), F.lit(0)).when(code >= 0, code + 1).otherwise(F.lit(NULL_CODE))
        at = code - int(drop_first)
        return F.when(at >= 0, at + starts[c]).cast("int")

    # Spark ML's encoder would name every entry in the schema, which the driver holds; here the schema has the size, and names as the encoder gives them
    # only up to ``MAX_DUMMY_COLUMNS`` entries.
    size = sum(entries.values())
    names = [{"idx": starts[c] + k, "name": f"__hot_{c}_{k}"} for c in known for k in range(entries[c])] if size <= MAX_DUMMY_COLUMNS else []
    schema = {"ml_attr": ({"attrs": {"binary": names}} if names else {}) | {"num_attrs": size}}
    vector = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    found = F.array_compact(F.array(*[place(c, n) for c, n in zip(known, codes)]))  # ascending, as the blocks are
    return coded.select(*[quoted(c) for c in df.columns], vector(found).alias(output, metadata=schema))


def split_encode(train: DataFrame, test: DataFrame, cols: Sequence[str], exclude: Sequence[str] = (),
                 drop_first: bool = True, form: str = "columns") -> tuple[DataFrame, DataFrame, CategoryDictionary]:
    """Dummies on both sides with the training labels only.

    ``form`` is ``columns`` (one each, refused above ``MAX_DUMMY_COLUMNS``) or ``vector`` (any number of labels).
    """
    train, test = train.drop(*exclude), test.drop(*exclude)
    dictionary = fit_dictionary(train, [c for c in cols if c not in exclude])
    if form == "vector":
        return dummy_vector(train, dictionary, drop_first=drop_first), dummy_vector(test, dictionary, drop_first=drop_first), dictionary
    return one_hot(train, dictionary, drop_first), one_hot(test, dictionary, drop_first), dictionary


def dummy_pipeline(df: DataFrame, cols: Sequence[str], output: str = "dummies") -> tuple[PipelineModel, list[str]]:
    """Fitted dummy encoder as a Spark ML model that is saved and loaded with the trees.

    Nulls seen in fitting are a class of their own, placed first. The indexer puts a label not seen in
    fitting last, and the encoder drops the last class, which leaves an all-zero block. Returns the model and the names of the vector's entries.
    """
    dictionary = fit_dictionary(df, cols)
    found = dictionary.labels(BROADCAST_ROWS)
    nulls = df.agg(*[F.max(quoted(c).isNull().cast("int")).alias(c) for c in cols]).first().asDict()
    labels = [([NULL_CLASS] if nulls[c] else []) + found[c] for c in cols]
    empty = [c for c, known in zip(cols, labels) if not known]
    if empty:
        raise ValueError(f"no labels to fit in {empty}")

    filled, index, hot = ([f"__{kind}_{c}" for c in cols] for kind in ("text", "index", "hot"))
    texts = ", ".join(f"coalesce(cast(`{c}` as string), '{NULL_CLASS}') AS `{f}`" for c, f in zip(cols, filled))
    spaced = ", ".join(f"`{c}`" for c in (*filled, *index, *hot))
    stages = [
        SQLTransformer(statement=f"SELECT *, {texts} FROM __THIS__"),
        *[StringIndexerModel.from_labels(known, f, i, handleInvalid="keep") for known, f, i in zip(labels, filled, index)],
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot, outputCol=output),
        SQLTransformer(statement=f"SELECT * EXCEPT ({spaced}) FROM __THIS__"),
    ]
    names = [dummy_name(c, v) for c, known in zip(cols, labels) for v in known]
    return Pipeline(stages=stages).fit(df.limit(1)), names


class DummyEncoder(Estimator):
    """``dummy_pipeline`` as a pipeline stage: fitted on training rows, it becomes the saved encoder."""

    def __init__(self, cols: Sequence[str], output: str = "dummies"):
        super().__init__()
        self.cols, self.output = list(cols), output

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return dummy_pipeline(dataset, self.cols, self.output)[0]


def feature_pipeline(df: DataFrame, numeric: Sequence[str], labels: Sequence[str] = (), scale: bool = False,
                     output: str = "features") -> tuple[PipelineModel, list[str]]:
    """Numeric columns (optionally standardised) and dummies assembled into one vector.

    Scaling fills nulls and NaN with the column's mean of the fitting rows, which becomes zero; a column
    without any value there cannot be scaled. Without scaling both stay NaN in the vector.
    """
    stages, parts, names = [], [], list(numeric)
    if labels:
        dummies, dummy_names = dummy_pipeline(df, labels)
        stages.append(dummies)
        parts.append("dummies")
        names += dummy_names
    raw = "__numeric" if scale else "__plain"
    inputs = list(numeric)
    if scale and inputs:
        inputs = [f"__filled_{c}" for c in numeric]
        casts = ", ".join(f"cast(`{c}` as double) AS `__number_{c}`" for c in numeric)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(Imputer(inputCols=[f"__number_{c}" for c in numeric], outputCols=inputs, strategy="mean"))
    stages.append(VectorAssembler(inputCols=inputs, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol="__scaled", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["__scaled" if scale else raw, *parts], outputCol=output))
    made = [f"`__{kind}_{c}`" for kind in ("number", "filled") for c in numeric] if scale else []
    spare = ", ".join([raw, *(["__scaled"] if scale else []), *made, *parts])
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({spare}) FROM __THIS__"))
    return Pipeline(stages=stages).fit(df), names


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(value - mean) / population sd per column; a constant column becomes zero."""
    stats = df.agg(*[f(quoted(c)).alias(f"{n}{i}") for i, c in enumerate(cols)
                     for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if cols else None
    at = {c: i for i, c in enumerate(cols)}

    def scaled(c: str):
        mean, sd = stats[f"m{at[c]}"], stats[f"s{at[c]}"]
        return ((quoted(c) - F.lit(mean)) / F.lit(sd if sd else 1.0)).alias(c)

    return df.select(*[scaled(c) if c in at else quoted(c) for c in df.columns])
