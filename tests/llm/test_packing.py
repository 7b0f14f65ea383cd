"""Packing against the tokenizer's library, and its constraints."""

import random
import struct
import zlib

import public_tokenizers
import pytest
from llm.odd import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wideframe.llm import packing as p
from wideframe.llm.queries import op13_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, limits, cut):
    """Every sequence is gapless and within its capacities."""
    places = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and r.start == r.piece * cut and 1 <= r.length <= cut
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= limits[0] and len(place) <= limits[1] and sum(n * n for _, n in place) <= limits[2]
    return len(places)


def whole(rows):
    """The ids of each document, put together again."""
    out = {}
    for r in sorted(rows, key=lambda r: r.piece):
        out.setdefault(r.doc_id, []).extend(struct.unpack(f"<{r.length}I", r.ids))
    return out


WORDS = ["It's 12.50€ (net), NAÏVE Σίσυφος, <|endoftext|>x<|startoftext|> y", "a b c é ́ Å ﬁ", "漢字かな 😀👩‍👩‍👧 'll 's can't", "\x00 \x0b\x0c tab\tnew\nline",
         "ÀÉ " * 3000, "w" * 5000, "x y " * 4000, "don't DON'T we'll next", "İSTANBUL ǅ ß"]


@pytest.mark.parametrize("capacities", [p.Capacities(), p.Capacities(documents=5), p.Capacities(attention=1_200_000), p.Capacities(attention=1_200_000, documents=4, choice="dot"),
                                        p.Capacities(tokens=512, weights=(1.0, 2.0, 0.5))])
def test_texts_come_back_whole(spark, capacities):
    texts = list(TEXTS.values()) + WORDS + ["short one"] * 300 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = p.pack(docs, VOCABULARY, capacities).collect()
    assert whole(rows) == dict(enumerate(library(texts)))
    number = check(rows, capacities.limits(), capacities.longest())
    assert number >= sum(r.length for r in rows) / capacities.tokens
    joined = p.sequences(p.pack(docs, VOCABULARY, capacities)).collect()
    assert len(joined) == number and sorted(zlib.crc32(r.ids) for r in joined) == sorted(
        zlib.crc32(b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.offset) if r.sequence_id == s)) for s in {r.sequence_id for r in rows})


def test_shuffled_counts_and_small_memo(spark, monkeypatch):
    monkeypatch.setattr(p, "BROADCAST_COUNTS", -1)
    monkeypatch.setattr(p, "MEMO_WORDS", 3)
    monkeypatch.setattr(p, "BATCH", 5)
    texts = WORDS + ["a b c d e f g h"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = p.pack(docs, VOCABULARY).collect()
    assert whole(rows) == dict(enumerate(library(texts))) and check(rows, p.Capacities().limits(), 2048)


def test_odd_documents(spark):
    rows = p.pack(odd_documents(spark), VOCABULARY).collect()
    assert check(rows, p.Capacities().limits(), 2048) and sum(r.piece == 0 for r in rows) == len(TEXTS) + 3
    assert sum(r.piece == 0 and r.doc_id is None for r in rows) == 2 and sum(r.piece == 0 and r.doc_id == 1 for r in rows) == 2
    assert p.pack(no_documents(spark), VOCABULARY).count() == 0


def test_a_very_long_text(spark):
    text = "one two three, " * 200_000  # 3 MB
    rows = p.pack(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), VOCABULARY).collect()
    assert len(whole(rows)[1]) == 800_001 and check(rows, p.Capacities().limits(), 2048) == 391


def naive(lengths, capacities):
    """Best fit one piece at a time."""
    limits, bins = capacities.limits(), []
    for n in sorted(lengths, reverse=True):
        asks = (n, 1, n * n)
        fits = [b for b in bins if all(x >= y for x, y in zip(b, asks))]
        norm = lambda b: sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(capacities.weights, b, asks, limits))
        best = min(fits, key=norm) if fits else None
        if best is None:
            best = [int(c) for c in limits]
            bins.append(best)
        best[:] = [x - y for x, y in zip(best, asks)]
    return len(bins)


def test_plan_is_best_fit():
    rng = random.Random(3)
    for seed in range(12):
        lengths = [min(2048, int(rng.paretovariate(0.6) * 20)) for _ in range(700)] + [rng.choice([300, 900, 1100])] * 150
        capacities = p.Capacities(documents=None if seed % 2 else 12, attention=None if seed % 3 else 2_000_000)
        lengths = [min(n, capacities.longest()) for n in lengths]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows, number = p.plan(counts, capacities)
        used = {n: 0 for n in counts}
        for length, first, copies, each, _, _ in rows.tolist():
            assert first == used[length]
            used[length] += copies * each
        assert used == counts
        assert abs(number - naive(lengths, capacities)) <= 1 + 0.01 * number
    assert p.plan({}, p.Capacities())[1] == 0 and p.plan({2048: 10**9, 1: 2048 * 10**6}, p.Capacities())[1] == 10**9 + 10**6


def test_plan_does_not_grow_with_the_rows():
    rng = random.Random(5)
    counts = {n: rng.randrange(1, 10**7) for n in range(1, 2049)}
    rows, number = p.plan(counts, p.Capacities())
    total = sum(n * c for n, c in counts.items())
    assert len(rows) < 40_000 and number <= total / 2048 * 1.01 + 1


def test_query(spark, sf):
    rows = op13_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    ids = dict(zip(texts, library(texts.values())))
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        here = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(here)}I", *here)) and len(here) == r.length
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    number = len({r.sequence_id for r in rows})
    assert number <= -(-sum(map(len, ids.values())) // 2048) + 2
    assert spark.createDataFrame(rows).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
