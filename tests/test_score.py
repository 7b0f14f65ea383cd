import numpy as np
import pytest
from pyspark.sql import functions as F

from wideframe.operators import score as s


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    y = rng.uniform(50, 250, 3000)
    rows = [("hot" if i % 3 == 0 else f"u{i % 7}", float(v), float(v + e)) for i, (v, e) in enumerate(zip(y, rng.normal(0, 9, 3000)))]
    return spark.createDataFrame(rows, "unit string, y double, pred double").cache()


def _numpy(y, p):
    e = np.abs(y - p)
    pct = e / y * 100
    return {
        "sq_mean": np.mean((y - p) ** 2), "r2": 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), "abs_mean": e.mean(),
        "abs_std": e.std(), "abs_max": e.max(), "abs_std_3": e.mean() + 3 * e.std(), "percent_mean": pct.mean(),
        "percent_std": pct.std(), "percent_max": pct.max(), "abs_median": np.median(e),
        "abs_p90": np.percentile(e, 90), "abs_p95": np.percentile(e, 95), "abs_p99": np.percentile(e, 99)}


@pytest.mark.parametrize("small", [10**6, 300])
def test_report_whole_and_by_unit(preds, small):
    data = preds.toPandas()
    whole = s.score(preds, small=small).first().asDict()
    for k, v in _numpy(data["y"].to_numpy(), data["pred"].to_numpy()).items():
        assert whole[k] == pytest.approx(v, rel=1e-9), k
    rows = s.score(preds, by=["unit"], small=small).collect()
    assert len(rows) == data["unit"].nunique()
    for row in rows:
        part = data[data["unit"] == row["unit"]]
        for k, v in _numpy(part["y"].to_numpy(), part["pred"].to_numpy()).items():
            assert row[k] == pytest.approx(v, rel=1e-9), k


def test_zero_label_and_empty_input(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.0)], "y double, pred double")
    row = s.score(df).first()
    assert (row["percent_mean"], row["abs_mean"], row["n_samples"]) == (10.0, 1.0, 2)
    assert s.score(df.limit(0)).first()["n_samples"] == 0
    assert s.score(df.withColumn("u", F.lit(1)).limit(0), by=["u"]).count() == 0


def test_constant_label_has_no_r2(spark):
    assert s.score(spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, pred double")).first()["r2"] is None


def test_holdout_stats(preds):
    data = preds.toPandas()
    e = np.abs(data["y"] - data["pred"])
    row = s.holdout_stats(preds).first()
    assert row["abs_p95"] == pytest.approx(np.percentile(e, 95))
    assert row["percent_p95"] == pytest.approx(np.percentile(e / data["y"] * 100, 95))
    assert s.holdout_stats(preds, by=["unit"]).count() == data["unit"].nunique()


def test_baselines(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "y double")
    test = spark.createDataFrame([(2.0,), (8.0,)], "y double")
    assert s.baseline_score(train, test).first()["abs_mean"] == 3.0
    assert s.baseline_score(train, test, mean_from="test").first()["abs_mean"] == 3.0
    assert s.baseline_score(train, test, mean_from="all").first()["abs_max"] == 4.5
    df = spark.createDataFrame([(0, 2.0), (0, 4.0), (1, 10.0)], "fold int, y double")
    rows = {r["fold"]: r["abs_mean"] for r in s.baseline_folds(df, "fold").collect()}
    assert rows == {0: 7.0, 1: 7.0}


def test_summary_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 3), ("b", 1.0, 3), ("b", 2.0, 4)], "p string, score double, it int")
    rows = {r["p"]: r for r in s.cv_summary(df, ["p"], "score", "it").collect()}
    assert (rows["a"]["best_iteration"], rows["b"]["best_iteration"]) == (2, 4)
    assert s.best_params(s.cv_summary(df, ["p"])).first()["p"] == "b"


def test_importance(spark):
    a = spark.createDataFrame([("x__DUMMY__1", 2), ("x__DUMMY__2", 3), ("z", 1)], "feature string, weight long")
    b = spark.createDataFrame([("q", 4)], "feature string, weight long")
    merged = s.merge_importance([s.importance_by_source(a), b])
    assert {tuple(r) for r in merged.collect()} == {("x", 5), ("z", 1), ("q", 4)}


def test_stop_epoch(spark):
    rows = [("a", 0, 10.0), ("a", 1, 9.9), ("a", 2, 5.0), ("a", 3, 4.99), ("b", 0, 3.0), ("b", 1, 2.0)]
    out = {r["run"]: r for r in s.stop_epoch(spark.createDataFrame(rows, "run string, epoch int, score double"), 0.5, 3).collect()}
    assert (out["a"]["stop_epoch"], out["a"]["kept_epochs"], out["a"]["score"]) == (4, 3, 5.0)
    assert (out["b"]["stop_epoch"], out["b"]["kept_epochs"], out["b"]["score"]) == (None, 2, 2.0)


def test_score_table_and_pooled(preds):
    table = s.score_table(s.score(preds, by=["unit"]))
    row = table.first()
    assert row["abs_3std_99"] == pytest.approx(row["abs_mean"] + 3 * row["abs_std"])
    halves = [preds.filter("unit = 'hot'"), preds.filter("unit <> 'hot'")]
    assert s.score_pooled(halves).first()["abs_p99"] == pytest.approx(s.score(preds).first()["abs_p99"])
