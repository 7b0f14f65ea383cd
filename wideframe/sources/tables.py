"""Scans and sinks. Every reader takes an explicit schema or a self-describing format: schema
inference would cost one more pass over the input."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideframe.operators.columns import match_columns


def read_cells(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = "\t",
               nrows: int | None = None, spread: int | None = None) -> DataFrame:
    """Delimited text with a header line, whose names say which column is which, in any order.

    The header of the first file decides the order, and a file with another header fails, as does a row that
    does not fit the schema. A gzip file is one split whatever its size, so ``spread`` redistributes its rows
    for the work that follows. ``nrows`` reads the first rows only, as a look at a file.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    head = spark.read.csv(path, sep=sep, header=True, inferSchema=False).columns
    if sorted(head) != sorted(wanted.names):
        raise ValueError(f"the header has {head}, the schema {wanted.names}")
    df = spark.read.csv(path, schema=T.StructType([wanted[c] for c in head]), sep=sep, header=True, nullValue="", emptyValue="",
                        enforceSchema=False, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.select([f"`{c}`" for c in wanted.names])
    if nrows is not None:
        df = df.limit(nrows)
    return df.repartition(spread) if spread else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet sink. With ``partition_by`` a later filter on those columns skips whole folders."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sorted_write(df: DataFrame, by: Sequence[str], path: str, mode: str = "errorifexists") -> None:
    """Write ordered by ``by`` (descending on the first column, ascending on the rest)."""
    first, *rest = by
    df.orderBy(F.col(first).desc(), *rest).write.mode(mode).option("header", True).csv(path)


def jdbc_options(url: str, table: str, predicate: str | None = None, partition_column: str | None = None,
                 bounds: tuple | None = None, partitions: int = 32, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for a partitioned database scan; ``predicate`` becomes part of the source query."""
    source = f"(SELECT * FROM {table} WHERE {predicate}) src" if predicate else table
    options = {"url": url, "dbtable": source, "fetchsize": str(fetch_size)}
    if partition_column:
        if bounds is None:
            raise ValueError("bounds are needed to split the scan by partition_column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Database table scan; needs the driver jar of the database on the session's class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def parameter_filter(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; bound as literals, so sources can take the filter."""
    for name, value in equal.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def read_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One-column id file with a header line, as distinct longs."""
    ids = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(name, T.LongType())]))
    return ids.filter(F.col(name).isNotNull()).distinct()


def catalogue(df: DataFrame, types: Iterable[str] = ("string",), include: Iterable[str] = (),
              exclude_patterns: Iterable[str] = (), exclude_names: Iterable[str] = ()) -> list[str]:
    """Sorted column names picked by type or by name, minus patterns (SQL LIKE) and names."""
    wanted, named = set(types), {n.lower() for n in include}
    barred = {n.lower() for n in exclude_names} | set(match_columns(df.columns, like=exclude_patterns))
    return sorted(
        f.name for f in df.schema.fields
        if (f.dataType.simpleString() in wanted or f.name.lower() in named)
        and f.name not in barred and f.name.lower() not in barred
    )


def read_units(spark: SparkSession, glob: str, id_regex: str, id_name: str = "unit",
               schema: T.StructType | None = None) -> DataFrame:
    """All unit files in one scan; the unit id is taken from each file's name."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(glob)
    return df.withColumn(id_name, F.regexp_extract(F.col("_metadata.file_name"), id_regex, 1).cast("long"))


#: Fixed spellings in text cells: null, an empty text, a line feed, a carriage return and a backslash.
CSV_NULL, CSV_EMPTY, CSV_LINE, CSV_RETURN, CSV_BACKSLASH = r"\N", r"\e", r"\n", r"\r", r"\b"
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _spelled(text):
    out = F.replace(text, F.lit("\\"), F.lit(CSV_BACKSLASH))
    out = F.replace(F.replace(out, F.lit("\n"), F.lit(CSV_LINE)), F.lit("\r"), F.lit(CSV_RETURN))
    return F.when(text.isNull(), CSV_NULL).when(text == "", CSV_EMPTY).otherwise(out)


def _read_back(text):
    out = F.replace(F.replace(text, F.lit(CSV_LINE), F.lit("\n")), F.lit(CSV_RETURN), F.lit("\r"))
    out = F.replace(out, F.lit(CSV_BACKSLASH), F.lit("\\"))
    return F.when(text == CSV_NULL, F.lit(None)).when(text == CSV_EMPTY, F.lit("")).otherwise(out)


def _texts(schema: T.StructType) -> set[str]:
    return {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gzip CSV with a header and, beside it, the schema as JSON, so that rows come back as they were.

    A row is one line: line breaks, nulls, empty texts and backslashes in text cells are spelled as above, and
    padding stays. Times keep their microseconds.
    """
    spark, texts = df.sparkSession, _texts(df.schema)
    cells = df.select(*[_spelled(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
    cells.write.mode(mode).options(**CSV_OPTIONS).csv(f"{path}/rows", compression="gzip")
    spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/types")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/types").first()["value"]))
    rows = spark.read.options(**CSV_OPTIONS).csv(f"{path}/rows", schema=schema, enforceSchema=False, mode="FAILFAST")
    texts = _texts(schema)
    return rows.select(*[_read_back(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in schema.names])


def to_sparse_long(df: DataFrame, features: Sequence[str], row_id: Sequence[str] | str) -> DataFrame:
    """Non-zero cells as ``(row id, feature, value)`` triples: the exchange form of a sparse matrix.

    Null cells count as zero. A map-side explode; no shuffle. Rows become arrays of plain doubles, and a cell gets its name
    once it is known to stay: an array of named cells would be filtered cell by cell by an interpreted function.
    """
    keys = [row_id] if isinstance(row_id, str) else list(row_id)
    cells = df.select(*keys, F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in features])).alias("__cell", "value"))
    kept = cells.filter(F.coalesce("value", F.lit(0.0)) != 0.0)
    return kept.select(*keys, F.get(F.array(*[F.lit(c) for c in features]), F.col("__cell")).alias("feature"), "value")


def save_model(model: PipelineModel, path: str) -> None:
    """Fitted pipeline with its category dictionary stages, as one folder."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def typed_reader_schema(kinds: Mapping[str, str]) -> T.StructType:
    """A reader schema from a name-to-kind map (see ``operators.columns.infer_kinds``)."""
    made = {"numeric": T.DoubleType(), "enum": T.StringType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, made[kind]) for name, kind in kinds.items()])

