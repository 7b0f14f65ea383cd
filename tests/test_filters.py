import numpy as np

from wideframe.operators import filters


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string")
    assert [r["x"] for r in filters.nan_to_null(df).collect()] == [None, 1.0]


def test_base_and_range_filter(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, 5.0), (1, "a", 0.0), (3, "a", 5.0)], "k int, s string, y double")
    assert filters.base_filter(df, {"k": [1, 2]}, ["s"], ["y"]).count() == 1
    assert filters.range_filter(df, "k", 2, 3).count() == 2
    assert filters.base_filter(df).count() == 4


def test_outliers_bounds_are_fitted_once_on_capped_rows(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=2000), rng.exponential(size=2000)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)], "x double, y double, none double")
    kept = filters.remove_outliers(df, q=(0.05, 0.95), cap=("y", 2.0))
    inside = y <= 2.0
    lo, hi = (np.quantile(v[inside], [0.05, 0.95]) for v in (x, y))
    want = inside & (x >= lo[0]) & (x <= lo[1]) & (y >= hi[0]) & (y <= hi[1])
    assert kept.count() == int(want.sum())
    assert 0 < filters.remove_outliers(df, q=(0.05, 0.95), cap=("y", 2.0), approx=True).count() < 2000


def test_outliers_drop_nulls_in_bounded_columns_and_allow_empty(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert filters.remove_outliers(df, q=(0.0, 1.0)).count() == 2
    assert filters.remove_outliers(df.limit(0)).count() == 0


def test_winsorize_fitted_on_training_rows(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "y double")
    limits = filters.fit_winsor(train, "y", k=1)
    assert (limits.low, limits.high) == (1.0, 5.0)
    out = filters.winsorize(spark.createDataFrame([(-9.0,), (4.0,), (99.0,), (None,)], "y double"), "y", 1, fit_on=train)
    assert [r["y"] for r in out.collect()] == [1.0, 4.0, 5.0, None]
    assert filters.fit_winsor(train, "y", k=9).low == 0


def test_fills(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    assert [r["a"] for r in filters.fill_mean(df).collect()] == [1.0, 2.0, 3.0]
    assert [r["b"] for r in filters.fill_mean(df).collect()] == [None] * 3
    assert [r["b"] for r in filters.fill_zero(df).collect()] == [0.0] * 3


def test_samples(spark):
    df = spark.range(1000)
    assert filters.sample_n(df, 10, 1).distinct().count() == 10
    part, rest = filters.sample_frac(df, 0.3, ["id"], 5)
    assert 200 < part.count() < 400
    assert part.count() + rest.count() == 1000 and part.intersect(rest).count() == 0
    again = filters.sample_frac(df.repartition(7), 0.3, ["id"], 5)[0]
    assert again.exceptAll(part).count() == 0


def test_holdout_split_keeps_rows_without_id_in_training(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "r int, unit int")
    train, held = filters.holdout_split(df, spark.createDataFrame([(2,), (2,), (7,)], "unit int"), "unit")
    assert {r["r"] for r in train.collect()} == {1, 3} and {r["r"] for r in held.collect()} == {2}
    assert filters.complement(df, held, "unit").count() == 2
    before, after = filters.time_split(df, "r", 2)
    assert (before.count(), after.count()) == (1, 2)


def test_filter_reaches_the_scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    bounds = filters.fit_outliers(lines, ["l_quantity"], q=(0.1, 0.9))
    plan = bounds.apply(lines).select("l_quantity")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "ReadSchema: struct<l_quantity:double>" in plan
