"""The matrix's passes: names and literals instead of joins, and rows that are shaped once."""

from pyspark.sql import functions as F

from wideframe.catalogue import fixtures as fx
from wideframe.catalogue import queries as catalogue
from wideframe.functions.flags import DATE_SPELLINGS, biweek
from wideframe.operators import categories as cats
from wideframe.plans import features as plan
from wideframe.sources.tables import to_sparse_long


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_become_rows_without_interpreted_functions(spark):
    df = spark.createDataFrame([(1, 2.0, None, 3), (2, 0.0, float("nan"), None)], "id int, a double, `b.c` double, d int")
    made = to_sparse_long(df, ["a", "b.c", "d"], "id")
    assert "lambda" not in _plan(made)
    assert sorted((r["id"], r["feature"], str(r["value"])) for r in made.collect()) == [(1, "a", "2.0"), (1, "d", "3.0"), (2, "b.c", "nan")]


def test_dummies_of_few_labels_are_not_joined(spark):
    rows = [(i, "ab"[i % 2], f"L{i}", None) for i in range(100)]
    fitted = cats.fit_dictionary(spark.createDataFrame(rows, "id int, p string, q string, r string"), ["p", "q", "r"])
    df = spark.createDataFrame([(1, "a", "L7", "x"), (2, "zz", "L100", None), (3, None, None, None), (4, "b", "L99", "x")], "id int, p string, q string, r string")
    few = cats.one_hot_long(df, ["p", "r"], ["id"], fitted)
    assert "Join" not in _plan(few) and "lambda" not in _plan(few)
    assert sorted((r["id"], r["feature"]) for r in few.collect()) == [(1, "p__DUMMY__a"), (4, "p__DUMMY__b")]
    whole = cats.one_hot_long(df, ["p", "q", "r"], ["id"], fitted, drop_first=True)
    assert "Join" in _plan(whole)
    assert sorted((r["id"], r["feature"]) for r in whole.collect()) == [(1, "q__DUMMY__L7"), (4, "p__DUMMY__b"), (4, "q__DUMMY__L99")]


def test_the_older_matrix_takes_its_own_labels_without_a_join(spark, sf):
    season = plan.clean(fx.season_wide(spark, sf), catalogue.SEASON)
    made = plan.encode_raw(season, catalogue.SEASON_RAW)
    assert made.complete and "Join" not in _plan(made.long())


def test_the_round_trip_shapes_its_rows_once(spark, sf):
    assert "Join" not in _plan(catalogue.QUERIES["feature_model_round_trip"](spark, sf))


def test_distinct_labels_are_found_without_interpreted_functions(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), (None, 2)], "p string, q int")
    made = cats.column_labels(df, ["p", "q"])
    assert "lambda" not in _plan(made) and {tuple(r) for r in made.collect()} == {("p", "a"), ("q", "1"), ("q", "2")}


def test_the_reading_of_a_date_is_found_once(spark):
    made = spark.createDataFrame([("2020-1-20",), ("1/20/2020 4:05",), ("fall",), ("",), (None,), ("20.1.2020",)], "d string").select(biweek(F.col("d")).alias("b"))
    assert _plan(made).count(DATE_SPELLINGS[0][0]) == 1
    assert [r["b"] for r in made.collect()] == ["2", "_1/20/2020 4:05_", "_fall_", "", None, "_20.1.2020_"]
