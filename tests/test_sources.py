import gzip

import pytest

from wideframe.sources import tables


def test_read_cells_from_gzip(spark, tmp_path):
    path = tmp_path / "cells.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("id\tname\tv\n1\ta\t1.5\n2\t\t\n3\tc\t2.5\n")
    df = tables.read_cells(spark, str(path), "id long, name string, v double", spread=3)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a", 1.5), (2, None, None), (3, "c", 2.5)]
    assert tables.read_cells(spark, str(path), "id long, name string, v double", nrows=2).count() == 2


def test_tables_csv_and_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 2.5, True), (2, None, None, False)], "year int, s string, v double, f boolean")
    tables.write_table(df, str(tmp_path / "t"), partition_by=["year"])
    assert tables.parameter_filter(tables.read_table(spark, str(tmp_path / "t"), ["s", "year"]), year=1).first()["s"] == "x"
    tables.write_csv(df, str(tmp_path / "c"))
    back = tables.read_csv(spark, str(tmp_path / "c"))
    assert [f.dataType for f in back.schema] == [f.dataType for f in df.schema] and back.exceptAll(df).count() == 0
    (tmp_path / "ids.csv").write_text("YearID\n5\n7\n5\n")
    assert {r[0] for r in tables.read_id_list(spark, str(tmp_path / "ids.csv")).collect()} == {5, 7}
    tables.sorted_write(df, ["year"], str(tmp_path / "s"))
    assert "2" == spark.read.csv(str(tmp_path / "s"), header=True).first()["year"]


def test_units_from_file_names(spark, tmp_path):
    for unit in (11, 12):
        spark.createDataFrame([(unit * 1.0,)], "v double").coalesce(1).write.parquet(str(tmp_path / f"w{unit}"))
        part = next((tmp_path / f"w{unit}").glob("part-*.parquet"))
        (tmp_path / f"{unit}_unit.parquet").write_bytes(part.read_bytes())
    df = tables.read_units(spark, str(tmp_path / "*_unit.parquet"), r"^(\d+)_")
    assert {tuple(r) for r in df.select("unit", "v").collect()} == {(11, 11.0), (12, 12.0)}


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x:y", "t", "label > 0", "id", (1, 1000), partitions=8)
    assert options["dbtable"] == "(SELECT * FROM t WHERE label > 0) src"
    assert (options["partitionColumn"], options["numPartitions"], options["upperBound"]) == ("id", "8", "1000")
    with pytest.raises(ValueError, match="bounds"):
        tables.jdbc_options("u", "t", partition_column="id")


def test_sparse_long_drops_zero_and_null(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, None, 0.0)], "id int, a double, b double")
    assert [tuple(r) for r in tables.to_sparse_long(df, ["a", "b"], "id").collect()] == [(1, "b", 2.0)]


def test_typed_csv_gives_every_row_back(spark, tmp_path):
    texts = [None, "", " pad ", "a\nb", "c\r\nd", 'say "x"', "\\N", "\\e", "\\", "\\\\n", ",", "\t", "#", "'", "null", "ä漢😀"]
    df = spark.createDataFrame([(i, t, None if i % 3 else i / 7) for i, t in enumerate(texts)], "id int, t string, x double")
    tables.write_csv(df, str(tmp_path / "typed"))
    back = tables.read_csv(spark, str(tmp_path / "typed"))
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_cells_follow_their_header(spark, tmp_path):
    (tmp_path / "cells.tsv").write_text("b\ta\n x \t1\n\t2\n")
    rows = tables.read_cells(spark, str(tmp_path / "cells.tsv"), "a int, b string").collect()
    assert [tuple(r) for r in rows] == [(1, " x "), (2, None)]
    with pytest.raises(ValueError, match="header"):
        tables.read_cells(spark, str(tmp_path / "cells.tsv"), "a int, c string")
    (tmp_path / "bad.tsv").write_text("a\tb\nten\tx\n")
    with pytest.raises(Exception):
        tables.read_cells(spark, str(tmp_path / "bad.tsv"), "a int, b string").collect()
