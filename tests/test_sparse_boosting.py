"""Boosted trees with learned sides for missing values against a plain loop, and against trees on filled values."""

import numpy as np
import pytest
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from wideframe.plans import models
from wideframe.plans import sparse_boosting as sb

NAMES = ["a", "b", "c"]


def frame(spark, n, seed=1):
    """Missing values of ``a`` have the label of small ones."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(0, 10, n), rng.integers(0, 5, n), rng.normal(size=n)])
    y = np.where(x[:, 0] < 3, 5.0, -5.0) + x[:, 1] + rng.normal(size=n) * 0.1
    gone = (x[:, 0] < 3) & (rng.random(n) < 0.6)
    x[gone, 0] = np.nan
    x[::13, 2] = np.nan
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    return VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(df).repartition(3), x, y


def leaf(model, root, row):
    node = root
    while model.tested[node] >= 0:
        v = row[model.tested[node]]
        left = bool(model.missing_left[node]) if np.isnan(v) else v <= model.cut[node]
        node = model.left[node] if left else model.right[node]
    return node


def test_leaves_are_gradient_sums(spark, monkeypatch):
    monkeypatch.setattr(sb, "ROUNDS", 2)  # some predictions are written, some followed
    monkeypatch.setattr(sb, "SUMS", 60)
    df, x, y = frame(spark, 500)
    model = sb.fit_sparse_boosting(df, "y", 5, max_depth=3, rate=0.5, columns=0.67)
    assert model.base == pytest.approx(y.mean()) and len(model.roots) == 5
    p = np.full(len(y), model.base)
    for t, root in enumerate(model.roots):
        at = np.array([leaf(model, root, r) for r in x])
        for node in set(at):
            rows = at == node
            assert model.value[node] == pytest.approx(0.5 * (y - p)[rows].sum() / (rows.sum() + 1.0))
        end = model.roots[t + 1] if t + 1 < 5 else len(model.depth)
        assert len({model.tested[n] for n in range(root, end)} - {-1}) <= 2  # two of three inputs
        p = p + np.array([model.value[n] for n in at])
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    np.testing.assert_allclose([got[i] for i in range(500)], p)
    trace = {r["round"]: r for r in model.errors_by_round(df, "y").collect()}
    assert sorted(trace) == [1, 2, 3, 4, 5] and trace[5].abs_mean == pytest.approx(np.abs(y - p).mean()) and trace[5].abs_std == pytest.approx(np.abs(y - p).std())


def test_missing_values_find_their_side(spark):
    df, _, _ = frame(spark, 1500)
    test, _, _ = frame(spark, 600, seed=2)
    own = sb.fit_sparse_boosting(df, "y", 8, max_depth=2, rate=0.5)
    means = Imputer(inputCols=NAMES, outputCols=NAMES).fit(df)
    filled = lambda rows: VectorAssembler(inputCols=NAMES, outputCol="features").transform(means.transform(rows.drop("features")))
    spark_ml = models.boosted("y", maxIter=8, maxDepth=2, stepSize=0.5).fit(filled(df))  # takes no missing values
    off = lambda frame_: np.mean([abs(r.y - r.prediction) for r in frame_.select("y", "prediction").collect()])
    assert off(own.transform(test)) < 0.8 * off(spark_ml.transform(filled(test)))
    assert any(t == 0 and m for t, m in zip(own.tested, own.missing_left))


def test_ends_early(spark, monkeypatch):
    monkeypatch.setattr(sb, "ROUNDS", 3)
    df, _, _ = frame(spark, 300)
    test, _, _ = frame(spark, 100, seed=3)
    model = sb.fit_sparse_boosting(df, "y", 30, max_depth=2, rate=1.0, validation=test, patience=2)
    trace = [r.abs_mean for r in model.errors_by_round(test, "y").orderBy("round").collect()]
    assert 1 <= len(model.roots) < 30 and trace[-1] == min(trace)


def test_few_and_no_rows(spark):
    df, _, y = frame(spark, 4)
    assert sb.fit_sparse_boosting(df.filter("false"), "y", 3).roots == []
    one = sb.fit_sparse_boosting(df.filter("id = 0"), "y", 2)
    assert one.tested == [-1, -1] and one.transform(df).first().prediction == pytest.approx(y[0])
    lost = df.withColumn("features", df.features)
    assert sb.fit_sparse_boosting(lost, "y", 1, least=2.0).transform(df).count() == 4


def test_rows_with_the_same_bins_are_added_up_once(spark):
    """Levels read one row per combination of bins, and the trees are those of the rows themselves."""
    df = spark.range(5_000).selectExpr("array(double(id % 7), if(id % 3 = 0, double('NaN'), double(id % 2))) AS v", "double(id % 7) * 2 + id % 3 AS y").select(
        array_to_vector("v").alias("features"), "y")
    binned, ends = sb._binned(df, "y", "features", 32)
    assert binned.count() == 7 * 3 and tuple(binned.selectExpr("sum(n)", "sum(s)").first()) == tuple(df.selectExpr("count(*)", "sum(y)").first())
    model = sb.fit_sparse_boosting(df, "y", rounds=1, max_depth=1, rate=1.0, penalty=0.0)
    first = model.value[model.left[0]], model.value[model.right[0]]
    low = F.get(vector_to_array("features"), F.lit(model.tested[0])) <= model.cut[0]
    means = {r["low"]: r["m"] for r in df.groupBy(low.alias("low")).agg(F.avg(F.col("y") - model.base).alias("m")).collect()}
    assert model.tested[0] == 0 and first == pytest.approx((means[True], means[False]))
