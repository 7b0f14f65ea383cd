"""Largest inner products against brute force."""

import math
import random

import pytest
from wideframe.llm import search


def brute(vectors, queries, k):
    best = {}
    for v, x in vectors:
        if v is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            best[v] = min(best.get(v, x), x)
    out = []
    for q in sorted(set(queries) & set(best)):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(best[q], x)), v) for v, x in best.items() if v != q)
        out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores[:k])]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(v, x, "p") for v, x in vectors], "vec_id long, vector array<double>, pivot string").repartition(3)


def check(spark, vectors, queries, k=5, part=search.PART):
    df = frame(spark, vectors)
    found = search.top_products(df, df.filter(df.vec_id.isin(queries)), k, part)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(vectors, queries, k)


@pytest.mark.parametrize("part,slots", [(192, 4096), (16, 3)])
def test_clusters_ties_and_a_hot_vector(spark, monkeypatch, part, slots):
    monkeypatch.setattr(search, "QUERIES", slots)
    monkeypatch.setattr(search, "SAMPLE", 40)
    monkeypatch.setattr(search, "PIVOTS", 6)
    rng = random.Random(4)
    centres = [[rng.randrange(-300, 300) for _ in range(8)] for _ in range(7)]
    vectors = [(i, [float(c + rng.randrange(-20, 20)) for c in rng.choice(centres)]) for i in range(400)]
    vectors += [(1000 + i, [float(c) for c in centres[0]]) for i in range(200)]  # a third are one vector
    vectors += [(2000 + i, [0.0] * 8) for i in range(20)]
    check(spark, vectors, [0, 10, 20, 1000, 1010, 2000, 399], part=part)


def test_odd_vectors(spark):
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [3.0]), (None, [1.0, 1.0]),
               (7, [-1.0, -2.0]), (0, [1.0, 2.0]), (0, [-1.0, 9.0]), (10, [2.0**60, 0.0]), (8, [1e9, 1e9]), (9, [2.0**30, 2.0**30])]
    check(spark, vectors, [0, 1, 5, 7], k=3)
    with pytest.raises(ValueError, match="64 bits"):
        search.top_products(frame(spark, [(0, [1e200]), (1, [1.0])]), frame(spark, [(0, [1e200])]))


def test_few_and_none(spark):
    check(spark, [(0, [1.0]), (50, [2.0])], [0, 50])
    check(spark, [(0, [1.0])], [0])
    check(spark, [], [0])


def test_quantised(spark):
    cells = [[0.1, -0.001, 0.999], [2.0**60, -(2.0**70)], [None, 1.0], [float("nan")], [float("inf")], [], None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "vec_id long, embedding array<double>")
    got = [r.v for r in df.orderBy("vec_id").select(search.quantised().alias("v")).collect()]
    assert got == [[25.0, -1.0, 255.0], [2.0**68, -(2.0**78)], None, None, None, [], None]
