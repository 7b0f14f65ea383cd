"""Each stage takes effect on what the one before left, and odd tables pass through."""

import corpus_pipeline
import pytest
from llm.odd import TEXTS, no_documents, odd_documents, prose
from wideframe.llm import quality, secrets
from wideframe.llm.decontaminate import contaminated
from wideframe.llm.near_duplicates import near_duplicates

BY = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, prose(k, 60) + ("" if k % 4 else " $$$"), "en", "src1", 1) for k in range(100, 160)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(100, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, TEXTS[9])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mixture"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, folder, name):
    for docs in (odd_documents(spark), no_documents(spark)):
        out = BY[name](spark, docs, folder)
        assert name == "mixture" or out.dtypes == docs.dtypes
        assert out.count() <= 3 * (len(TEXTS) + 3)


def test_quality_keeps_what_the_network_accepts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in BY["quality"](spark, docs, sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.quality(docs, labels).filter("predicted = 1").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_one_document_of_each_group_stays(spark, folder):
    docs = odd_documents(spark)
    kept = sorted(r.doc_id for r in BY["near_duplicates"](spark, docs, folder).collect() if r.doc_id is not None)
    assert kept == sorted({r.component_id for r in near_duplicates(docs).collect() if r.doc_id is not None})
    assert len(kept) == len(set(kept))


def test_contaminated_documents_go_and_clean_ones_stay(spark, folder):
    docs = odd_documents(spark)
    bad = {r.doc_id for r in contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    left = BY["decontaminate"](spark, docs, folder)
    assert 9 in bad and left.filter("doc_id = 9").count() == 0
    assert left.count() == docs.filter(~docs.doc_id.isin(list(bad)) | docs.doc_id.isNull()).count()


@pytest.mark.parametrize("bound", [100_000, -1])
def test_secrets_are_redacted_and_other_texts_stay(spark, folder, monkeypatch, bound):
    from wideframe.llm import stages

    monkeypatch.setattr(stages, "BROADCAST_SPANS", bound)
    docs = spark.createDataFrame([(1, 'x password = "hunter22" y', 9), (1, 'x password = "hunter22" y', 9), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    rows = sorted((r.doc_id, r.text, r.n_chars) for r in BY["secrets"](spark, docs, folder).fillna("-").collect() if r.doc_id < 3)
    assert rows == [(1, 'x [SECRET]" y', 13), (1, 'x [SECRET]" y', 13), (2, "clean", 5)]
    assert secrets.found_secrets(BY["secrets"](spark, docs, folder)).filter("size(base) > 0").count() == 0


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "text", "epoch"} <= set(rows[0].asDict())
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
