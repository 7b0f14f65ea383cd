"""Column selection, renaming and typing. All of it is decided from the schema: no data is read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIND_TYPES = {
    "numeric": (T.NumericType,),
    "label": (T.StringType, T.BooleanType),
    "boolean": (T.BooleanType,),
    "string": (T.StringType,),
}


def quoted(name: str):
    return F.col(f"`{name}`")


def match_columns(names: Iterable[str], contains: Iterable[str] = (), like: Iterable[str] = ()) -> list[str]:
    """Names holding any of the substrings or fitting any SQL LIKE pattern; letter case is ignored."""
    parts = [p.lower() for p in contains]
    shapes = [re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in p), re.I)
              for p in like]
    return [n for n in names
            if any(p in n.lower() for p in parts) or any(s.fullmatch(n) for s in shapes)]


def columns_of(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, KIND_TYPES[kind])]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the named columns; names that are not there are ignored."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_matching(df: DataFrame, substrings: Iterable[str]) -> DataFrame:
    return drop_columns(df, match_columns(df.columns, contains=substrings))


def keep_numbered(df: DataFrame, pattern: str, numbers: range) -> DataFrame:
    """Among columns that fit ``pattern``, drop those whose captured number is not in ``numbers``."""
    found = {n: re.match(pattern, n, re.IGNORECASE) for n in df.columns}
    return drop_columns(df, [n for n, m in found.items() if m and int(m.group(1)) not in numbers])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that are present. A new name that is already there replaces that column."""
    present = {old: new for old, new in names.items() if old in df.columns}
    clash = [new for old, new in present.items() if new in df.columns and new != old]
    return df.drop(*clash).withColumnsRenamed(present)


def _distinct_names(names: Sequence[str], case_sensitive: bool = False) -> list[str]:
    seen: dict[str, str] = {}
    for name in names:
        key = name if case_sensitive else name.lower()
        if key in seen:
            raise ValueError(f"column names collide: {seen[key]!r} and {name!r}")
        seen[key] = name
    return list(names)


def lower_names(df: DataFrame, pattern: str) -> DataFrame:
    """Lower-case the names that fit ``pattern``; two names that become equal are an error."""
    return df.toDF(*_distinct_names(
        [n.lower() if re.match(pattern, n, re.IGNORECASE) else n for n in df.columns]))


def sanitize_names(df: DataFrame) -> DataFrame:
    """Replace every character outside ``0-9a-zA-Z_`` by two underscores."""
    return df.toDF(*_distinct_names([re.sub(r"[^0-9a-zA-Z_]", "__", n) for n in df.columns]))


def infer_kinds(schema: T.StructType, overrides: Mapping[str, str] | None = None,
                label_numbers: Iterable[str] = (), text: Iterable[str] = ()) -> dict[str, str]:
    """Name-to-kind map: numbers are ``numeric`` unless they are labels in disguise; the rest is
    ``enum``, or ``string`` for the columns in ``text``."""
    as_label, as_text = set(label_numbers), set(text)

    def kind(field: T.StructField) -> str:
        if isinstance(field.dataType, T.NumericType) and field.name not in as_label:
            return "numeric"
        return "string" if field.name in as_text else "enum"

    return {f.name: kind(f) for f in schema.fields} | dict(overrides or {})


def enforce_kinds(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Cast each listed column to its kind in one projection; text that is no number becomes null."""
    def cast(name: str):
        kind = kinds.get(name)
        if kind == "numeric" and not isinstance(df.schema[name].dataType, T.NumericType):
            return quoted(name).try_cast("double").alias(name)
        if kind in ("enum", "string") and not isinstance(df.schema[name].dataType, T.StringType):
            return quoted(name).cast("string").alias(name)
        return quoted(name)

    return df.select(*[cast(n) for n in df.columns])


def column_diff(left: Iterable[str], right: Iterable[str]) -> tuple[list[str], list[str]]:
    """Names only on the left and names only on the right, each sorted."""
    a, b = set(left), set(right)
    return sorted(a - b), sorted(b - a)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), fill: float = 0.0
                   ) -> tuple[DataFrame, list[str]]:
    """Bring a frame to a model's feature list.

    Missing features become ``fill``, columns the model does not know are left out and returned by
    name, and the order is the model's. Columns in ``keep`` come first, unchanged.
    """
    unknown, missing = column_diff([c for c in df.columns if c not in keep], features)
    absent = set(missing)
    aligned = [F.lit(fill).alias(f) if f in absent else quoted(f) for f in features]
    return df.select(*[quoted(k) for k in keep], *aligned), unknown


def drop_sparse_columns(df: DataFrame, max_null: float = 0.9) -> tuple[DataFrame, list[str]]:
    """Drop columns whose share of nulls is above ``max_null``; one aggregation over all columns."""
    from wideframe.operators.profile import null_shares

    shares = null_shares(df)
    dropped = [n for n, share in shares.items() if share is not None and share > max_null]
    return df.drop(*dropped), dropped


def with_row_id(df: DataFrame, order_by: Sequence[str] | None = None, name: str = "row_id") -> DataFrame:
    """Add a row id: opaque when no order is asked for, else the 0-based position in that order.

    Rows that tie in the order are told apart by a running id, so the range slices stay even however many tie.
    The rows are written once, in slices; a row's position is its place in its slice plus the slices before.
    """
    if not order_by:
        return df.withColumn(name, F.monotonically_increasing_id())
    from wideframe.session import stage

    order = [*[quoted(c) for c in order_by], F.col("__tie")]
    cut = stage(df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order)
                .withColumn("__slice", F.spark_partition_id()), "row-ids")
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = cut.groupBy("__slice").agg(F.count("*").alias("__n")).select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__slice").orderBy(*order)
    return cut.join(F.broadcast(starts), "__slice").select(
        *[quoted(c) for c in df.columns], (F.col("__start") + F.row_number().over(inside) - 1).cast("long").alias(name))
