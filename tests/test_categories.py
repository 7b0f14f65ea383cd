import pytest
from pyspark.sql import functions as F

from wideframe.operators import categories as cats


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([("b", "x"), ("a", None), (None, None), ("b", "x")], "p string, q string")


@pytest.fixture(scope="module")
def test_rows(spark):
    return spark.createDataFrame([(1, "a", "x"), (2, "zz", "x"), (3, None, "new")], "id int, p string, q string")


def test_dictionary(train):
    fitted = cats.fit_dictionary(train, ["p", "q"])
    assert fitted.labels() == {"p": ["a", "b"], "q": ["x"]}
    assert fitted.sizes() == {"p": 2, "q": 1}
    with pytest.raises(ValueError, match="labels"):
        fitted.labels(limit=1)


def test_all_null_column_has_no_labels(spark):
    df = spark.createDataFrame([(None, "a")], "n string, a string")
    fitted = cats.fit_dictionary(df, ["n", "a"])
    assert fitted.sizes() == {"n": 0, "a": 1}
    assert cats.encode_codes(df, fitted).first()["n"] == -1
    assert cats.fit_dictionary(df.limit(0), ["n"]).entries.count() == 0


def test_code_policies(train, test_rows):
    fitted = cats.fit_dictionary(train, ["p", "q"])
    assert [tuple(r) for r in cats.encode_codes(test_rows, fitted).orderBy("id").collect()] == [(1, 0, 0), (2, -1, 0), (3, -1, -1)]
    assert [r["p"] for r in cats.encode_codes(test_rows, fitted, "next").orderBy("id").collect()] == [0, 2, -1]
    with pytest.raises(Exception, match="unknown label in (p: zz|q: new)"):
        cats.encode_codes(test_rows, fitted, "error").collect()
    decoded = cats.decode_codes(cats.encode_codes(test_rows, fitted), fitted).orderBy("id").collect()
    assert [tuple(r) for r in decoded] == [(1, "a", "x"), (2, None, "x"), (3, None, None)]


def test_large_dictionary_is_joined(spark, monkeypatch, train, test_rows):
    monkeypatch.setattr(cats, "MAP_LABELS", 0)
    fitted = cats.fit_dictionary(train, ["p", "q"])
    joined = cats.encode_codes(test_rows, fitted, "next").orderBy("id")
    assert [tuple(r) for r in joined.collect()] == [(1, 0, 0), (2, 2, 0), (3, -1, 1)]


def test_unknown_labels(train, test_rows):
    fitted = cats.fit_dictionary(train, ["p", "q"])
    assert {tuple(r) for r in cats.unknown_labels(test_rows, fitted).collect()} == {("p", "zz"), ("q", "new")}


def test_one_hot_forms_agree(train, test_rows):
    fitted = cats.fit_dictionary(train, ["p", "q"])
    wide = cats.one_hot(test_rows, fitted, dummy_na=True)
    assert wide.columns == ["id", "p__DUMMY__a", "p__DUMMY__b", "p__DUMMY__nan", "q__DUMMY__x", "q__DUMMY__nan"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(1, 1, 0, 0, 1, 0), (2, 0, 0, 0, 1, 0), (3, 0, 0, 1, 0, 0)]
    assert cats.one_hot(test_rows, fitted, drop_first=True).columns == ["id", "p__DUMMY__b"]
    long = cats.one_hot_long(test_rows, ["p", "q"], ["id"], fitted).collect()
    assert {(r["id"], r["feature"]) for r in long} == {(1, "p__DUMMY__a"), (1, "q__DUMMY__x"), (2, "q__DUMMY__x")}
    assert cats.one_hot_long(test_rows, ["p"], ["id"]).count() == 2
    source = wide.select(cats.source_of(F.lit("p__DUMMY__a"))).first()[0]
    assert source == "p"


def test_split_encode_uses_training_labels(train, test_rows):
    a, b, fitted = cats.split_encode(train, test_rows, ["p", "q"], exclude=["q"])
    assert a.columns == ["p__DUMMY__b"] and b.columns == ["id", "p__DUMMY__b"]
    assert fitted.columns == ("p",)


def test_dummy_model_is_saved_and_loaded(spark, train, test_rows, tmp_path):
    from wideframe.sources.tables import load_model, save_model

    model, names = cats.dummy_pipeline(train, ["p", "q"])
    assert names == ["p__DUMMY____na__", "p__DUMMY__a", "p__DUMMY__b", "q__DUMMY____na__", "q__DUMMY__x"]
    save_model(model, str(tmp_path / "m"))
    out = load_model(str(tmp_path / "m")).transform(test_rows).orderBy("id").collect()
    assert [r["dummies"].toArray().tolist() for r in out] == [[0, 1, 0, 0, 1], [0, 0, 0, 0, 1], [1, 0, 0, 0, 0]]
    assert "p" in out[0].asDict() and not [c for c in out[0].asDict() if c.startswith("__")]


def test_encoder_as_a_pipeline_stage(train, test_rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    stages = [cats.DummyEncoder(["p"], "hot"), VectorAssembler(inputCols=["hot"], outputCol="features")]
    out = Pipeline(stages=stages).fit(train).transform(test_rows).orderBy("id").collect()
    assert [r["features"].toArray().tolist() for r in out] == [[0, 1, 0], [0, 0, 0], [1, 0, 0]]


def test_feature_pipeline_scales_numbers_only(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, s string")
    model, names = cats.feature_pipeline(df, ["x"], ["s"], scale=True)
    rows = model.transform(df).orderBy("x").collect()
    assert names == ["x", "s__DUMMY__a", "s__DUMMY__b"]
    assert rows[0]["features"].toArray().tolist()[1:] == [1.0, 0.0]
    assert rows[0]["features"][0] == pytest.approx(-rows[1]["features"][0])


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert [tuple(r) for r in cats.standardize(df, ["x", "c"]).orderBy("x").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.mark.parametrize("labels", [6_000, 150_000])
def test_dummies_beyond_any_number_of_columns(spark, labels):
    df = spark.range(labels).select(F.concat(F.lit("v"), "id").alias("v"), "id")
    dictionary = cats.fit_dictionary(df, ["v"])
    odd = spark.createDataFrame([(None, -1), ("new", -2)], "v string, id long")
    rows = cats.dummy_vector(df.filter(F.col("id") % 997 == 0).union(odd), dictionary).collect()
    places = {r.id: (r.dummies.size, list(r.dummies.indices)) for r in rows}
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(labels)))}
    assert places == {r.id: (labels, [order[r.v]] if r.id >= 0 else []) for r in rows}
    train, test, _ = cats.split_encode(df, odd, ["v"], form="vector")
    assert test.first()["dummies"].size == labels - 1 and train.filter("v = 'v0'").first()["dummies"].numNonzeros() == 0


def test_scaled_pipeline_fills_nulls(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    model, _ = cats.feature_pipeline(df, ["x"], scale=True)
    values = [r.features[0] for r in model.transform(df).collect()]
    assert values[2] == values[3] == pytest.approx(0) and values[0] == pytest.approx(-values[1])
