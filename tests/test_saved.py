"""Fitted features that are saved, and read in another session."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from wideframe.catalogue import fixtures as fx
from wideframe.catalogue.queries import SEASON
from wideframe.plans import features as plan
from wideframe.plans import models, saved
from wideframe.plans.features import FeatureConfig
from wideframe.session import stage


@pytest.fixture(scope="module")
def season(spark, sf):
    return fx.season_wide(spark, sf)


def rows_of(df):
    return {tuple(r[:-1]): r[-1] for r in df.collect()}


def test_settings_come_back():
    for cfg in (SEASON, FeatureConfig(["a"], "y", "g", numbered=("wk", range(3, 9, 2)), cap=("y", 2.5), renames={"x": "z"}, deltas={"d": ("p", "q")})):
        assert saved.from_plain(saved.to_plain(cfg)) == cfg
    with pytest.raises(TypeError, match="set"):
        saved.to_plain({"a": {1}})


def test_stage_in_another_session(spark, season, tmp_path):
    even, odd = season.filter("o_orderkey % 2 = 0"), season.filter("o_orderkey % 2 = 1")
    fitted = saved.FeatureEstimator(cfg=SEASON, outputCol="vec").fit(even)
    path = str(tmp_path / "stage")
    fitted.write().overwrite().save(path)
    other = spark.newSession()
    again = saved.FeatureTransformer.load(path)
    assert again.uid == fitted.uid and again.getOutputCol() == "vec" and again.fitted.cfg == SEASON
    assert again.fitted.fill == fitted.fitted.fill and again.fitted.bounds == fitted.fitted.bounds
    elsewhere = saved._model(other, saved.feature_settings(fitted.fitted), f"{path}/dictionary")
    assert elsewhere.dictionary.labels() == fitted.fitted.dictionary.labels()
    expected = rows_of(fitted.transform(odd))
    assert expected and rows_of(again.transform(odd)) == expected
    # Labels that training has not seen have no dummy, and rows to score need no label.
    blind = again.transform(odd.drop(SEASON.label)) if SEASON.label in odd.columns else None
    if blind is not None:
        assert blind.filter(F.col(SEASON.label).isNotNull()).count() == 0 and blind.count() == len(expected)


def test_inside_a_pipeline(spark, season, tmp_path):
    pipeline = Pipeline(stages=[saved.FeatureEstimator(cfg=SEASON, outputCol="vec"), models.forest(SEASON.label, "vec", numTrees=2, maxDepth=2)])
    dense = season.filter("o_orderkey % 3 = 0")
    features = saved.FeatureEstimator(cfg=SEASON, outputCol="vec").fit(dense)
    usable = features.transform(dense).filter(F.col(SEASON.label).isNotNull())
    whole = PipelineModel([features])
    whole.write().overwrite().save(str(tmp_path / "pipeline"))
    assert rows_of(PipelineModel.load(str(tmp_path / "pipeline")).transform(dense)) == rows_of(features.transform(dense))
    assert len(pipeline.getStages()) == 2 and usable.count() > 0


def test_model_in_a_folder(spark, season, tmp_path):
    shaped = stage(plan.shape(plan.clean(season, SEASON), SEASON, drop=True), "shaped")
    model = plan.fit_features(shaped, SEASON)
    saved.write_features(model, str(tmp_path / "model"))
    again = saved.read_features(spark, str(tmp_path / "model"))
    for name in ("cfg", "fill", "bounds", "numeric", "labels"):
        assert getattr(again, name) == getattr(model, name), name
    assert again.dictionary.labels() == model.dictionary.labels()
