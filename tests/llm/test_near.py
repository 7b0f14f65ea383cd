"""Near duplicates and components against brute force."""

import random
import re

import pytest
from llm.odd import TEXTS, no_documents, odd_documents
from wideframe.llm import near_duplicates as near
from wideframe.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = smallest(sets, links)
    return {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_odd_documents(spark):
    rows = near.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    expected = brute(TEXTS)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None} == expected
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_repeated_ids_with_other_texts(spark):
    """Rows of one id are one document: components of rows that are alike or share an id."""
    rng = random.Random(8)
    bases = [[f"b{g}x{i}" for i in range(40)] for g in range(12)]
    rows = []
    for k in range(150):
        words = list(rng.choice(bases))
        words[rng.randrange(40)] = f"e{k}"
        rows.append((rng.randrange(60) if k % 5 else 7, rng.choice([" ".join(words), " ".join(words), "", None])))
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and (
        rows[a][0] == rows[b][0] or 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))]
    root = smallest(range(len(rows)), links)
    name = {}
    for k, (i, _) in enumerate(rows):
        if sets[k]:
            name[root[k]] = min(name.get(root[k], i), i)
    of = {i: name[root[k]] for k, (i, _) in enumerate(rows) if sets[k]}
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = near.near_duplicates(df).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((i, len(s), of.get(i, i)) for (i, _), s in zip(rows, sets))


def test_no_documents(spark):
    assert near.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("block_rows", [512, 7])
def test_messy_group(spark, monkeypatch, block_rows):
    """Many edits of one text: a graph that stars alone do not connect, in blocks of any size."""
    monkeypatch.setattr(near, "BLOCK_ROWS", block_rows)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for k in range(90):
        t = list(base)
        for _ in range(rng.randrange(0, 7)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts[k + 10] = " ".join(t)
    for k in range(40):
        texts[k + 500] = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30)) + " " + " ".join(base[:30])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(near.near_duplicates(df)) == brute(texts)


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    docs = odd_documents(spark).filter("doc_id is not null")
    assert got(near.near_duplicates(docs)) == brute(TEXTS)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 240)]
    edges += [(5, 5), (7, None), edges[0]]
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = {x for e in real for x in e}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == smallest(nodes, real)


def test_no_link_is_lost_in_a_large_messy_group(spark):
    """Copies of one text with up to a third of it changed, and copies of those copies: links of all strengths, many of them lone."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(140)]
    texts = {}
    for k in range(700):
        t = texts[rng.randrange(k)].split() if k > 5 and rng.random() < 0.6 else list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        texts[k] = " ".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert got(near.near_duplicates(df)) == brute(texts)
