"""Repeated passages against brute force, and what the method promises of its symbols."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from llm.odd import TEXTS, no_documents, odd_documents, words
from wideframe.llm import recompression, repeats
from wideframe.llm.words import Words, gram_hashes, slices


def brute(texts, n=13):
    w = {k: words(t) for k, t in texts.items()}
    first = {}
    for k in sorted(w):
        for i in range(len(w[k]) - n + 1):
            first.setdefault(tuple(w[k][i:i + n]), k)
    out = {}
    for k, ws in w.items():
        gone = set()
        for i in range(len(ws) - n + 1):
            if first[tuple(ws[i:i + n])] < k:
                gone.update(range(i, i + n))
        out[k] = (len(ws), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(ws) if i not in gone).encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_odd_documents(spark):
    rows = repeats.repeated_passages(odd_documents(spark), digest_only=True).collect()
    assert len(rows) == len(TEXTS) + 3
    expected = brute(TEXTS)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]
    # An unknown id is larger than any other, so its copy of a known text goes.
    assert sorted((r.n_words, r.n_removed) for r in rows if r.doc_id is None) == [(0, 0), (80, 80)]


def test_no_documents(spark):
    assert repeats.repeated_passages(no_documents(spark)).count() == 0


@pytest.mark.parametrize("chunk", [200, 4 << 20])
def test_small_alphabet(spark, monkeypatch, chunk):
    """Runs, periods and repeats everywhere, over many chunks and over one."""
    monkeypatch.setattr(repeats, "slices", lambda b: slices(b, most=chunk))
    rng = random.Random(1)
    texts = {k: " ".join(rng.choice("ab") if rng.random() < 0.9 else "a a a a a a a" for _ in range(rng.randrange(0, 90))) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert got(repeats.repeated_passages(df, digest_only=True)) == brute(texts)


def test_texts_come_back(spark):
    df = spark.createDataFrame([(1, "a\tb  c\n" * 10), (2, "x a b c a b c a b c a b c a b c y")], "doc_id long, text string")
    rows = {r.doc_id: r.kept_text for r in repeats.repeated_passages(df).collect()}
    assert rows == {1: " ".join("abc" * 10), 2: "x y"}


def test_equal_windows_have_equal_symbols():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(400)) for _ in range(20)] + ["a " * 300, "a b " * 200]
    w = Words(pa.array(texts))
    hashes = w.hashes()
    starts, _, prints = recompression.window_symbols(w, hashes, 13)
    by = {}
    for g, p in zip(gram_hashes(hashes, 13)[starts].tolist(), prints.tolist()):
        assert by.setdefault(g, p) == p


def test_words_are_those_of_the_pattern():
    texts = ["", "a", " a", None, "a b", "b\x0b\x0cc\r\n", "ä ö  ü", "end", "next"]
    w = Words(pa.array(texts))
    found = [[bytes(w.data[w.starts[i]:w.ends[i]]).decode() for i in w.text_of(k)] for k in range(len(texts))]
    assert found == [words(t) for t in texts]
    h = w.hashes()
    assert len(np.unique(h)) == len({x for r in found for x in r})
