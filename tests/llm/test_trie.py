"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from compare import differences, duck
from wideframe.llm import trie
from wideframe.llm.oracles import ORACLES
from wideframe.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, depth int, words string"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    convs = {c: [x[2] for x in sorted(t)] for c, t in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(convs.get(head, [])[:h] + own[h:])
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + (len(nodes[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    ends = {p: ",".join(str(c) for c in sorted(cs) if paths[c] == p) for p, cs in nodes.items()}
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else -10**9, len(cs), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
                  for p, cs in nodes.items())


def found(spark, rows):
    df = spark.createDataFrame([r + ("i", 3, "w") for r in rows], SCHEMA).repartition(3)
    out = trie.prefix_trie(trie.with_borrowed_heads(trie.coded_turns(df))).collect()
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        text = lambda: " ".join(rng.choice("a b cc\n".split(" ")) for _ in range(rng.randrange(4)))
        rows += [(c * rng.choice([1, 1, 7]), t, rng.choice(["user", "assistant", None]), text()) for t in range(rng.randrange(5))]
    rows += [(5000 + c, t, "user", "the same") for c in range(n // 2) for t in range(3)]  # a third are one conversation
    return rows


@pytest.mark.parametrize("bounds", [{}, {"PATHS": 1, "SLICE": 2}, {"PATHS": 9, "BROADCAST_NODES": -1}, {"PATHS": 30, "RANGES": 2}])
def test_against_prefixes(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(trie, name, value)
    rows = conversations(len(bounds), 120)
    assert found(spark, rows) == brute(rebuilt(rows))


def test_odd_conversations(spark):
    rows = [(0, None, None, None), (0, 1, "", ""), (0, 1, "", ""), (None, 1, "user", "x"), (1, 5, "user", None), (-7, 2, "a", "b"), (-7, 2, "a", "b"), (-7, None, "ab", ""),
            (20, 1, "u", "long " * 300_000), (39, 1, "u", "x"), (40, 3, "u", "y"), (2**40, 1, "u", "z")]
    rows += [(60, k, "u", "deep") for k in range(3000)] + [(61, k, "u", "deep") for k in range(2990)] + [(61, 9999, "v", "end")]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert found(spark, []) == []
    assert found(spark, [(7, 1, "user", "alone")]) == brute(rebuilt([(7, 1, "user", "alone")]))


def test_query(spark, sf):
    assert not differences(op11_prefix_trie(spark, sf), duck(sf), ORACLES["op11_prefix_trie"])


def test_ternary_tree():
    rng = random.Random(2)
    paths = sorted({tuple(rng.randrange(40) for _ in range(rng.randrange(6))) for _ in range(2000)})
    tree = trie.TernaryTree(paths)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(tree.turn) == len(prefixes) == len(tree.order()) == len(set(tree.order()))
    for p in prefixes:
        node = tree.find(p)
        assert tree.depth[node] == len(p) and all(x[:len(p)] == p for x in paths[tree.begin[node]:tree.end[node]])
        assert (tree.ending[node] >= 0) == (p in paths[tree.begin[node]:tree.end[node]][:1])
    assert tree.find((41,)) == tree.find((0, 99)) == -1
    one = trie.TernaryTree([(k,) for k in range(1023)])
    steps = {0: 0}
    for node in one.order():
        for below in (one.low[node], one.high[node], one.down[node]):
            steps[below] = steps[node] + 1
    assert max(v for k, v in steps.items() if k >= 0) == 10  # balanced
