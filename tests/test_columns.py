import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wideframe.operators import columns, profile
from wideframe.sources import tables


def test_drop_and_keep_numbered(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, `Cost$` int, seedCOST int, Wk13Gdd int, wk14rain int")
    assert columns.drop_columns(df, ["a", "nope"]).columns == ["Cost$", "seedCOST", "Wk13Gdd", "wk14rain"]
    assert columns.drop_matching(df, ["$", "cost"]).columns == ["a", "Wk13Gdd", "wk14rain"]
    assert "Wk13Gdd" not in columns.keep_numbered(df, r"^wk(\d\d?)(gdd|rain)$", range(14, 40)).columns


def test_rename_replaces_an_existing_column(spark):
    df = spark.createDataFrame([(1, 2)], "YearId int, b int")
    assert columns.rename(df, {"YearId": "YearUnit", "zz": "y"}).columns == ["YearUnit", "b"]
    assert columns.rename(df, {"YearId": "b"}).collect()[0].asDict() == {"b": 1}


def test_name_collisions_raise(spark):
    df = spark.createDataFrame([(1, 2)], T.StructType([T.StructField("a b", T.IntegerType()), T.StructField("a-b", T.IntegerType())]))
    with pytest.raises(ValueError, match="collide"):
        columns.sanitize_names(df)
    mixed = spark.createDataFrame([(1, 2)], "Wk1a int, x int").toDF("Wk1a", "wk1A")
    with pytest.raises(ValueError, match="collide"):
        columns.lower_names(mixed, r"^wk\d+a$")


def test_kinds(spark):
    df = spark.createDataFrame([("1.5", 3, True, "x"), ("bad", None, None, "y")], "n string, code int, flag boolean, t string")
    kinds = columns.infer_kinds(df.schema, {"n": "numeric"}, label_numbers=["code"], text=["t"])
    assert kinds == {"n": "numeric", "code": "enum", "flag": "enum", "t": "string"}
    rows = columns.enforce_kinds(df, kinds).collect()
    assert [r["n"] for r in rows] == [1.5, None]
    assert [r["code"] for r in rows] == ["3", None] and rows[0]["flag"] == "true"
    assert [f.dataType for f in tables.typed_reader_schema(kinds)] == [T.DoubleType()] + [T.StringType()] * 3


def test_align_features_reports_unknown(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, b double, zz double")
    aligned, unknown = columns.align_features(df, ["a", "b"], keep=["id"])
    assert aligned.columns == ["id", "a", "b"] and unknown == ["zz"]
    assert tuple(aligned.first()) == (1, 0.0, 2.0)


def test_catalogue_by_type_and_pattern(spark):
    df = spark.createDataFrame([("a", 1, "b", "c", "d")], "z string, n int, `Total$` string, seedCost string, UID string")
    assert tables.catalogue(df, include=["n"], exclude_patterns=["%$%", "%cost"], exclude_names=["uid"]) == ["n", "z"]


def test_sparse_columns_and_empty_input(spark):
    df = spark.createDataFrame([(i, None if i else 1) for i in range(20)], "a int, b int")
    assert columns.drop_sparse_columns(df)[1] == ["b"]
    empty = df.limit(0)
    assert columns.drop_sparse_columns(empty)[1] == []
    assert profile.null_profile(empty).count() == 2


def test_row_ids(spark):
    df = spark.range(50).withColumn("v", (F.col("id") * 7) % 50)
    placed = {r["v"]: r["row_id"] for r in columns.with_row_id(df, ["v"]).collect()}
    assert placed == {v: v for v in range(50)}
    assert columns.with_row_id(df).select("row_id").distinct().count() == 50
