"""Held-out accuracy of both classifiers, and that scores depend on a text's bytes alone."""

import random
import zlib

import pytest
from llm.odd import TEXTS, no_documents, odd_documents, prose
from wideframe.llm.labelled import labelled_sample
from wideframe.llm.quality import accepted, quality
from wideframe.llm.toxicity import toxicity, windows

BAD = ["$$$", "%%%", "&&&", "###"]
MEAN = ["stupid", "worthless", "idiot", "scum"]


def corpus(spark, n=420):
    rng = random.Random(6)
    docs, labels = [], []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 3 == 0
        ws = prose(k + 50, rng.randrange(60, 200)).split()
        if bad:
            ws = [w + rng.choice(BAD) for w in ws]
        if toxic:
            for _ in range(len(ws) // 12):
                ws[rng.randrange(len(ws))] = rng.choice(MEAN)
        docs.append((k, " ".join(ws)))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def given(spark):
    docs, labels = corpus(spark)
    return docs.cache(), labels.cache()


@pytest.mark.parametrize("operator,label,folds,fold", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, given, operator, label, folds, fold):
    docs, labels = given
    rows = {r.doc_id: r for r in operator(docs, labels).collect()}
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == len(truth)
    held = [k for k in rows if zlib.crc32(str(k).encode()) % folds == fold]
    assert {k for k, r in rows.items() if r.held_out} == set(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert sum(rows[k].predicted == truth[k] for k in held) >= 0.93 * len(held)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_depend_on_the_text_alone(spark, given, operator):
    docs, labels = given
    one = {r.doc_id: r.score for r in operator(docs, labels).collect()}
    two = {r.doc_id - 10**6: r.score for r in operator(docs.union(docs.selectExpr("doc_id + 1000000", "text")).repartition(7), labels).filter("doc_id >= 1000000").collect()}
    assert one == pytest.approx(two)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_documents(spark, given, operator):
    docs, labels = given
    more = docs.selectExpr("doc_id + 5000 doc_id", "text")
    odd = odd_documents(spark)
    rows = operator(odd.unionByName(more, allowMissingColumns=True), labels.selectExpr("doc_id + 5000 doc_id", "quality", "toxic")).filter("doc_id is null or doc_id < 5000").collect()
    assert len(rows) == len(TEXTS) + 3
    scores = {r.doc_id: r.score for r in rows if r.doc_id is not None}
    assert scores[4] == scores[5] and all(0 <= s <= 1 for s in scores.values())
    assert not any(r.held_out for r in rows if r.doc_id is None)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_no_documents_and_no_labels(spark, given, operator):
    docs, labels = given
    assert operator(no_documents(spark), labels).count() == 0
    assert operator(odd_documents(spark), labels.filter("false")).count() == len(TEXTS) + 3


def test_sample_is_bounded_and_leaves_the_held_out_fold_alone(spark, given):
    docs, labels = given
    assert len(labelled_sample(docs, labels, "quality", 5, 0, 50)) == 50
    texts = {t for t, _ in labelled_sample(docs, labels, "quality", 5, 0, 10_000)}
    assert len(texts) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(420))
    assert labelled_sample(docs, labels, "quality", 5, 0, 50) == labelled_sample(docs.repartition(9), labels.repartition(2), "quality", 5, 0, 50)


def test_long_texts_and_repeated_ids_reach_the_fit(spark):
    long = "".join(f"ä{k:06d} " for k in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "a"), (2, "b"), (2, ""), (3, None), (4, "x" * 40_000)] + [(5, f"t{k}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 5)] + [(2, 0), (2, 1)], "doc_id long, quality int")
    got = labelled_sample(docs.repartition(7), labels, "quality", 1, 5, 10)
    assert got == labelled_sample(docs.repartition(2), labels.repartition(3), "quality", 1, 5, 10) and len(got) == 4
    assert got[1] == ("b", 0) and got[3] == ("t99", 1) and set(got[2][0]) == {"x", "\n"}
    text = got[0][0]
    assert 32_000 < len(text) <= 32_768 and long.startswith(text[:200]) and long.endswith(text[-200:])
    places = [int(line[line.index("ä") + 1:][:6]) for line in text.split("\n")]
    assert len(places) == 32 and max(b - a for a, b in zip(places, places[1:])) < 800 and places[-1] > 19_000


def test_scores_equal_a_plain_loop(given):
    """The network, byte by byte, and each window with a compressor of its own."""
    import math

    import numpy as np
    import zstandard
    from wideframe.llm import quality as q, toxicity as t

    docs, labels = given
    texts = [r.text for r in docs.orderBy("doc_id").limit(6).collect()] + ["", "x", "ab" * 700]
    model = q.fit(labelled_sample(docs, labels, "quality", 5, 0, 60))
    (embedding, filters, bias), (weights, *scales) = model
    seen = q.scores(texts, model)
    for text, score in zip(texts, seen):
        data, answers = text.encode(), []
        for start in range(0, max(1, len(data) - (q.CHUNK - q.STEP)), q.STEP):
            chunk = (data[start:start + q.CHUNK] + bytes(q.CHUNK))[:q.CHUNK]
            best = [max(sum(float(embedding[chunk[p + i]][d]) * float(filters[i * q.DEPTH + d][f]) for i in range(q.WIDTH) for d in range(q.DEPTH))
                        for p in range(0, q.CHUNK - q.WIDTH + 1, q.STRIDE)) for f in range(q.FILTERS)]
            answers.append([max(0.0, b + float(c)) for b, c in zip(best, bias)])
        pooled = np.hstack([np.mean(answers, 0), np.max(answers, 0)])[None]
        assert score == pytest.approx(float(q.probability(pooled, model[1])[0]), abs=1e-3)
    ordinary, toxic, last = t.fit(labelled_sample(docs, labels, "toxic", 4, 2, 200))
    distance = t.Distances(ordinary, toxic)

    def length(window, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, level=t.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for text in texts:
        folded = t.folded(text)
        z = [length(folded[i:i + t.WINDOW], ordinary) - length(folded[i:i + t.WINDOW], ordinary + toxic) for i in range(0, max(1, len(folded) - 8), t.STEP)]
        got = distance.features(text)
        assert got[0] == pytest.approx(sum(z) / len(z), abs=1.0) and got[-1] == math.log(len(z))


def test_accepted_keeps_rows_as_they_are(spark, given):
    docs, labels = given
    wide = docs.selectExpr("*", "'x' as score", "1.5 as net")
    kept = {r.doc_id: r for r in accepted(wide, labels).collect()}
    assert {k for k, r in {r.doc_id: r for r in quality(docs, labels).collect()}.items() if r.predicted} == set(kept)
    assert all(r.score == "x" for r in kept.values())


def test_windows_cover_everything():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        text = bytes(range(65, 91)) * 40
        ws = windows(text[:n])
        covered = set()
        for k, w in enumerate(ws):
            covered.update(range(k * 24, k * 24 + len(w)))
        assert covered == set(range(n))
