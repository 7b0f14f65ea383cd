"""The encoder that keeps its labels in a table: entries, saving, many labels, odd columns."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from wideframe.operators import categories as cats
from wideframe.plans.label_vectors import LabelVectorizer, LabelVectorizerModel


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame([("b", "x", None), ("a", None, None), (None, "x", None), ("a", "__na__", None), ("c\nd", "é", None)], "p string, q string, r string")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "a", "x", None), (2, "zz", "x", "new"), (3, None, None, None), (4, "c\nd", "__na__", "x"), (4, "c\nd", "__na__", "x")],
                                 "id int, p string, q string, r string")


def place(train, row):
    """Entries of a row by hand: nulls first where training has them, then the labels in order."""
    out, before = [], 0
    for i, c in enumerate("pqr"):
        seen = {r[i] for r in train}
        classes = ([None] if None in seen else []) + sorted(seen - {None})
        if row[c] in classes:
            out.append(before + classes.index(row[c]))
        before += len(classes)
    return before, out


@pytest.mark.parametrize("small", [True, False])
def test_entries_after_saving_in_a_pipeline(spark, train, rows, tmp_path, monkeypatch, small):
    if not small:
        monkeypatch.setattr(cats, "MAP_LABELS", 0)
        monkeypatch.setattr("wideframe.operators.ranks.BROADCAST_ROWS", -1)
    model = Pipeline(stages=[LabelVectorizer(inputCols=["p", "q", "r"], outputCol="hot")]).fit(train)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].uid == model.stages[0].uid and again.stages[0].getOutputCol() == "hot"
    learned = [tuple(r) for r in train.collect()]
    for fitted in (model, again):
        out = fitted.transform(rows).collect()
        assert len(out) == 5 and fitted.transform(rows).columns == ["id", "p", "q", "r", "hot"]
        for r in out:
            size, at = place(learned, r)
            assert r["hot"].size == size and [i for i, v in enumerate(r["hot"].toArray()) if v] == at, r
    names = again.stages[0].names().orderBy("entry").collect()
    assert [r["entry"] for r in names] == list(range(size))
    assert [r["feature"] for r in names[:4]] == ["p__DUMMY____na__", "p__DUMMY__a", "p__DUMMY__b", "p__DUMMY__c\nd"]
    assert again.stages[0].sizes() == {"p": 4, "q": 4, "r": 1}


def test_more_labels_than_a_driver_should_hold(spark, tmp_path):
    """Above the 100,000 labels that the encoder with labels in its metadata accepts; one label holds a third of the rows."""
    rows = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("label "), "id")).alias("p"))
    with pytest.raises(ValueError):
        cats.dummy_pipeline(rows, ["p"])
    model = LabelVectorizer(inputCols=["p"]).fit(rows)
    model.save(str(tmp_path / "m"))
    again = LabelVectorizerModel.load(str(tmp_path / "m"))
    hits = again.transform(rows).select("id", F.explode(F.unwrap_udt("dummies")["indices"]).alias("entry"))
    got = hits.join(again.names(), "entry").join(rows, "id").agg(F.count("*"), F.count_distinct("entry"), F.count_if(F.col("label") != F.col("p"))).first()
    assert tuple(got) == (300_000, 200_001, 0)


def test_no_labels_and_no_rows(spark, train, rows):
    with pytest.raises(ValueError):
        LabelVectorizer(inputCols=["p"]).fit(train.limit(0))
    model = LabelVectorizer(inputCols=["r"]).fit(train)
    assert [r["dummies"].toArray().tolist() for r in model.transform(rows).orderBy("id").collect()] == [[1], [0], [1], [0], [0]]
    assert model.transform(rows.limit(0)).count() == 0


def test_schema_does_not_grow_with_the_labels(spark):
    """The driver holds the schema: it has the vector's size, and names only as far as there may be one column per label."""
    rows = spark.range(cats.MAX_DUMMY_COLUMNS + 1).select(F.concat(F.lit("v"), "id").alias("p"))
    for n in (cats.MAX_DUMMY_COLUMNS, cats.MAX_DUMMY_COLUMNS + 1):
        some = rows.limit(n)
        made = LabelVectorizer(inputCols=["p"]).fit(some).transform(some)
        attrs = made.schema["dummies"].metadata["ml_attr"]
        assert attrs["num_attrs"] == n == made.agg(F.count_distinct(F.unwrap_udt("dummies")["indices"][0])).first()[0]
        assert len(attrs.get("attrs", {}).get("binary", [])) == (n if n <= cats.MAX_DUMMY_COLUMNS else 0)
    with pytest.raises(ValueError):
        cats.dummy_vector(rows.withColumn("dummies", F.lit(1)), cats.fit_dictionary(rows, ["p"]))
