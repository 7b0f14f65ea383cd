"""Ranked lexical search against a plain loop, and the quadtree against sums over columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import differences, duck
from llm.odd import TEXTS, no_documents, odd_documents, prose
from wideframe.llm import lexical, treap
from wideframe.llm.oracles import ORACLES
from wideframe.llm.queries import op12_lexical_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None and terms(t)]
    number, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, c in docs:
            m = 50 + 50 * sum(c.values()) * number // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def check(spark, docs, items, k=50):
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.lexical_search(table, asked, k).collect())
    assert got == brute(docs, items, k)
    return got


DOCS = [(k, prose(900 + k, 5 + 13 * k % 90) + (" rare" * (k % 3)) + (f" w{k % 11} Çà" if k % 2 else "")) for k in range(300)]
DOCS += [(1000 + k, prose(7, 30)) for k in range(150)]  # a third are one text
ITEMS = [(1, prose(7, 12)), (2, "rare W3 alpha"), (3, "nothing here fits"), (4, None), (5, "..."), (6, prose(8, 400) + " w1 w2 w10"), (None, "alpha"), (7, "beta"),
         (7, "gamma beta"), (8, "çà ÇÀ, rare/rare")]


@pytest.mark.parametrize("bounds", [{}, {"DOCUMENTS": 7, "START": 20}, {"POINTS": 30, "PAIRS": 12}, {"START": 60}])
def test_ties_blocks_and_passes(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(lexical, name, value)
    for k in (3, 50):
        assert check(spark, DOCS, ITEMS, k)


def test_small_queues(spark, monkeypatch):
    monkeypatch.setattr(treap, "STEP", 1)
    monkeypatch.setattr(treap, "WAITING", 40)
    assert check(spark, DOCS, ITEMS, 5)


def test_odd_documents(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    items = [(1, TEXTS[1]), (2, "one TWO x 漢字"), (3, ""), (4, "ab")]
    table = odd_documents(spark)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.lexical_search(table, asked).collect())
    assert got == brute(rows, items, 50) and got
    assert lexical.lexical_search(no_documents(spark), asked).count() == 0
    assert lexical.lexical_search(table, asked.filter("false")).count() == 0


def test_a_very_long_text(spark):
    check(spark, [(1, "alpha beta " * 150_000), (2, "beta"), (3, "x" * 2_000_000 + " alpha"), (4, "gamma")], [(1, "alpha beta"), (2, "gamma")])


def test_query(spark, sf):
    assert not differences(op12_lexical_search(spark, sf), duck(sf), ORACLES["op12_lexical_search"])


def test_quadtree():
    rng = np.random.default_rng(1)
    for rows, columns, points in [(1, 1, 1), (5, 3, 7), (40, 100, 900), (300, 20, 2000), (64, 64, 0), (17, 1000, 5000)]:
        row, column = np.divmod(rng.choice(rows * columns, size=points, replace=False), columns)
        impact = rng.integers(0, 30, points)
        tree = treap.Treap(row, column, impact, rows, columns)
        for _ in range(20):
            asked, k, least = rng.choice(rows, size=min(rows, 6), replace=False), int(rng.integers(1, 9)), int(rng.integers(0, 40))
            sums = np.zeros(columns, np.int64)
            mine = np.isin(row, asked)
            np.add.at(sums, column[mine], impact[mine])
            high = sorted(-sums[sums >= max(least, 1)])
            cut = -high[k - 1] if len(high) >= k else max(least, 1)
            at, found = tree.best(asked, least, k)
            assert set(zip(at.tolist(), found.tolist())) == {(int(c), int(sums[c])) for c in np.flatnonzero(sums >= cut)}
