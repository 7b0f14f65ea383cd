import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wideframe.catalogue import fixtures as fx
from wideframe.catalogue.queries import NUMERIC, SEASON
from wideframe.operators import folds
from wideframe.plans import features as plan
from wideframe.plans import models, validation, whatif
from wideframe.session import stage


@pytest.fixture(scope="module")
def learn(spark, sf):
    rows = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(fx.learn(spark, sf))
    return rows.withColumn("id", F.monotonically_increasing_id()).cache()


@pytest.fixture(scope="module")
def season(spark, sf):
    return stage(fx.season_wide(spark, sf), "season")


def test_feature_set_round_trip(spark, season, tmp_path):
    made = plan.feature_set(season, SEASON)
    made.write(str(tmp_path / "set"))
    back = plan.FeatureSet.load(spark, str(tmp_path / "set"))
    assert back.features() == made.features()
    assert back.wide().count() == made.frame.count()
    assert back.part("weight").columns == ["o_orderkey", "n_lines"]
    assert back.part("label").columns == ["o_orderkey", "o_totalprice"]
    assert not set(back.numeric) & {"rate7", "o_totalprice", "n_lines", "o_custkey", "year"}
    assert "year" in back.labels


def test_feature_model_applies_training_statistics(season):
    shaped = stage(plan.shape(plan.clean(season, SEASON), SEASON, drop=True), "shaped")
    old, new = shaped.filter("year < 1999"), shaped.filter("year >= 1999")
    fitted = plan.fit_features(old, SEASON)
    out = fitted.transform(new)
    assert out.frame.count() == new.count()
    assert out.frame.filter(F.col("Wk00A").isNull()).count() == 0
    assert out.dictionary.labels() == fitted.dictionary.labels()


def test_shape_to_csv_and_include_ids(spark, season, tmp_path):
    from dataclasses import replace

    from wideframe.sources.tables import read_csv

    plan.shape_to_csv(season, SEASON, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert "date1" not in back.columns and "date1_biweek" in back.columns
    assert "Line_Count" in back.columns and "rate7" not in back.columns
    shaped = plan.shape(season, SEASON, drop=True)
    assert "o_custkey" in replace(SEASON, include_ids=True).statistics_columns(shaped)


def test_dummies_for_known_features_only(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "zz", None)], "id int, s string, v double")
    out, unknown = plan.dummies_for(df, ["s__DUMMY__a", "s__DUMMY__b", "w"], ["id"])
    assert out.columns == ["id", "s__DUMMY__a", "s__DUMMY__b", "w"] and unknown == ["v"]
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 1, 0, 0.0), (2, 0, 0, 0.0)]


def test_whatif_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 7.0)], "id int, x double")
    sweep = whatif.Sweep(0, 10, 5)
    flat = whatif.whatif(df, lambda x: F.lit(1.0), "x", sweep, ["id"])
    assert {tuple(r) for r in flat.collect()} == {(1, 0.0, 1.0), (2, 0.0, 1.0)}
    curve = whatif.sweep_curve(df, lambda x: x * 2, "x", sweep, ["id"])
    assert sorted(tuple(r) for r in curve.collect()) == [(1, 0.0, 0.0), (1, 5.0, 10.0), (2, 0.0, 0.0), (2, 5.0, 10.0)]
    assert "Exchange" not in flat._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="empty"):
        whatif.Sweep(5, 5, 1).values()


def test_sweep_bounds_use_the_sample_deviation(spark):
    df = spark.createDataFrame([(20.0,), (30.0,), (99.0,)], "x double")
    sweep = whatif.sweep_bounds(df, "x", 10, 40, 5, k=1)
    assert (sweep.low, sweep.high) == (round(25 - np.std([20, 30], ddof=1)), round(25 + np.std([20, 30], ddof=1)))


def test_grid_and_patience():
    grid = models.param_grid({"a": [1, 2], "b": [3, 4]})
    assert grid[1] == {"a": 1, "b": 4} and len(grid) == 4
    assert models.random_search(grid, 2, 1) == models.random_search(grid, 2, 1)
    assert models.best_iteration([5, 4, 3, 3.5, 3.4, 1], patience=2) == 3
    assert models.best_iteration([5, 4, 3, 3.5, 3.4, 1], patience=9) == 6


def test_model_beats_the_mean_and_saves(learn, tmp_path):
    train, test = folds.train_test(learn, 0.3, ["id"])
    model = models.boosted("y", maxIter=8, maxDepth=4).fit(train)
    evaluator = models.AbsStdEvaluator("y")
    mean = train.agg(F.avg("y")).first()[0]
    assert evaluator.evaluate(model.transform(test)) < evaluator.evaluate(test.withColumn("prediction", F.lit(mean)))
    assert not evaluator.isLargerBetter()
    trace = models.error_trace(model, {"train": train, "test": test}).toPandas()
    assert trace.groupby("dataset").size().to_dict() == {"train": 8, "test": 8}


def test_early_stopping_column(learn):
    marked = learn.withColumn("held", F.col("l_linenumber") == 1)
    model = models.boosted("y", maxIter=40, maxDepth=3, stepSize=1.0, validation="held", validationTol=0.5).fit(marked)
    assert model.getNumTrees < 40


def test_importance_by_splits(spark, learn):
    model = models.boosted("y", maxIter=3, maxDepth=3).fit(learn)
    counted = {r["feature"]: r["weight"] for r in models.importance(model, NUMERIC, spark).collect()}
    assert set(counted) <= set(NUMERIC) and counted["l_quantity"] > 0
    splits = sum(t.numNodes // 2 for t in model.trees)
    assert sum(counted.values()) == splits
    gain = models.importance(model, NUMERIC, spark, kind="gain").agg(F.sum("weight")).first()[0]
    assert gain == pytest.approx(1.0)


def test_decision_paths_reach_the_models_prediction(spark, learn):
    model = models.boosted("y", maxIter=3, maxDepth=3).fit(learn)
    paths = models.decision_paths(model, learn, NUMERIC, ["id"])
    weights = F.create_map(*[F.lit(x) for i, w in enumerate(model.treeWeights) for x in (i, float(w))])
    replayed = paths.filter("leaf_prediction is not null").groupBy("id").agg(
        F.sum(F.col("leaf_prediction") * weights[F.col("tree")]).alias("replayed"), F.count("*").alias("leaves"))
    both = replayed.join(model.transform(learn), "id")
    assert both.filter(F.abs(F.col("replayed") - F.col("prediction")) > 1e-9).count() == 0
    assert both.filter("leaves <> 3").count() == 0
    tests = paths.filter("leaf_prediction is null")
    assert tests.filter("(sign = '<=') <> (value <= threshold) or feature is null").count() == 0
    assert paths.filter("leaf_prediction is not null and (feature is not null or threshold is not null)").count() == 0


def s_loss(df):
    from wideframe.operators.score import abs_std_loss

    return abs_std_loss(df, "y", "prediction").first()["loss"]


def test_grown_forest_keeps_gaining_epochs(learn):
    train, test = folds.train_test(learn, 0.3, ["id"])
    grown = models.grow_forest(train, test, "y", step=2, max_epochs=3, tol=1e9, min_epochs=2, maxDepth=4)
    assert len(grown.scores) == 1 and [m.getNumTrees for m in grown.models] == [2]
    more = models.grow_forest(train, test, "y", step=3, max_epochs=3, tol=-1e9, maxDepth=4)
    assert [m.getNumTrees for m in more.models] == [3, 3, 3]
    assert s_loss(more.transform(test)) == pytest.approx(more.scores[-1])


def test_staged_errors_are_those_of_shorter_models(learn):
    train, test = folds.train_test(learn, 0.3, ["id"])
    whole = models.boosted("y", maxIter=4, maxDepth=3).fit(train)
    staged = models.staged_errors(whole, test, "y")
    for k in (1, 3, 4):
        short = models.boosted("y", maxIter=k, maxDepth=3).fit(train)
        assert s_loss(short.transform(test)) == pytest.approx(staged[k - 1]["loss"])


def test_nested_cv(learn):
    result = validation.nested_cv(learn, "y", "l_suppkey", ["id"], models.param_grid({"maxDepth": [2, 4]}), NUMERIC,
                                  outer=2, inner=2, rounds=4, patience=2, holdout=learn.filter("l_linenumber = 7"))
    outer = result.outer.collect()
    assert len(outer) == 2 and result.inner.count() == 8
    assert all(r["test_abs"] < r["guess_abs"] and r["holdout_score"] > 0 for r in outer)
    tested = result.predictions
    assert tested.count() == learn.count() and tested.select("id").distinct().count() == learn.count()
    assert folds.fold_leakage(tested, "l_suppkey").count() == 0
    assert result.importance.select("fold").distinct().count() == 2 and len(result.models) == 2


def test_stacking_and_leaderboard(learn):
    base = {"boosted": models.boosted("y", maxIter=3, maxDepth=3), "forest": models.forest("y", numTrees=4, maxDepth=4)}
    model, oof = validation.stack(learn, "y", "l_suppkey", ["id"], base, k=2, meta={"maxIter": 3})
    assert oof.count() == learn.count() and oof.select("id").distinct().count() == learn.count()
    assert {"boosted", "forest", "prediction"} <= set(model.transform(learn).columns)
    board = validation.leaderboard(learn, "y", "l_suppkey", ["id"], models.candidates(["elastic_net", "boosted"], "y", params={
        "boosted": {"maxIter": 5}}), k=2)
    assert [r["model"] for r in board.collect()] == ["boosted", "elastic_net"]
    one = validation.leaderboard(learn, "y", "l_suppkey", ["id"], base, k=2, max_models=1)
    assert one.count() == 1


def test_whatif_with_a_model_finds_the_planted_optimum(learn):
    from pyspark.ml import PipelineModel

    assembler = VectorAssembler(inputCols=NUMERIC, outputCol="features")
    plain = learn.drop("features")
    model = models.boosted("y", maxIter=10, maxDepth=4).fit(assembler.transform(plain))
    best = whatif.whatif(plain, PipelineModel([assembler, model]), "l_quantity", whatif.Sweep(1, 50, 5), ["id"])
    assert best.count() == plain.count()
    assert best.filter("best between 20 and 40").count() > 0.9 * plain.count()


def test_paths_of_category_splits_and_original_values(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer

    rows = [(i, "abcdef"[i % 6], float(i % 7), 10.0 * (i % 6 in (1, 4)) + i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, kind string, x double, y double")
    steps = [StringIndexer(inputCol="kind", outputCol="code"), VectorAssembler(inputCols=["code", "x"], outputCol="raw"),
             VectorIndexer(inputCol="raw", outputCol="features", maxCategories=6)]
    made = Pipeline(stages=steps).fit(df).transform(df)
    model = models.boosted("y", maxIter=2, maxDepth=3).fit(made)
    paths = models.decision_paths(model, made, ["code", "x"], ["id"], originals={"code": "kind"})
    assert paths.filter("categories is not null").count() > 0
    assert paths.filter("categories is not null and (sign = 'in') <> array_contains(categories, value)").count() == 0
    kinds = {r.id: r.kind for r in made.collect()}
    assert all(r.original == kinds[r.id] for r in paths.filter("feature = 'code'").collect())
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    replayed = paths.filter("leaf_prediction is not null").groupBy("id").agg(F.sum(F.col("leaf_prediction") * F.get(weights, F.col("tree"))).alias("sum"))
    assert replayed.join(model.transform(made), "id").filter(F.abs(F.col("sum") - F.col("prediction")) > 1e-9).count() == 0


def test_vector_form_holds_what_the_long_form_holds(season):
    made = plan.feature_set(season, SEASON)
    names = made.features()
    from pyspark.ml.functions import vector_to_array

    cells = made.vector().select(*made.key, F.posexplode(vector_to_array("features")).alias("at", "value")).filter("value <> 0 and not isnan(value)")
    named = cells.select(*made.key, F.get(F.array(*[F.lit(n) for n in names]), F.col("at")).alias("feature"), "value")
    long = made.long()
    assert named.exceptAll(long).count() == 0 and long.exceptAll(named).count() == 0


def test_label_form_of_any_number_of_labels(spark):
    df = spark.range(6_000).select("id", F.concat(F.lit("L"), "id").alias("name"), F.lit(None).cast("double").alias("x"))
    with pytest.raises(ValueError, match="6000 labels"):
        plan.shape_labels(df, ["name"])
    made = plan.shape_labels(df, ["name"], ids=["id"], form="vector")
    assert made.columns == ["x", "dummies"] and made.first()["dummies"].size == 6_000 and made.filter("x = 0").count() == 6_000
