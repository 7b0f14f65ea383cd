"""Budgets down the tree and seeded prefixes against a plain reckoning."""

import hashlib
import random
from collections import defaultdict

import pytest
from llm.odd import TEXTS, no_documents, odd_documents, words
from wideframe.llm import mixing


def fill(budget, children):
    """{name: (capacity, weight)} to shares: the next to be full is always the one with the least capacity per weight."""
    out, rest, left = {}, budget, dict(children)
    for name in sorted(children, key=lambda n: (children[n][0] / children[n][1], n)):
        capacity, weight = children[name]
        whole = sum(w for _, w in left.values())
        if capacity * whole > rest * weight:
            break
        out[name], rest = capacity, rest - capacity
        del left[name]
    run, whole = 0, sum(w for _, w in left.values())
    for name in sorted(left, key=lambda n: (children[n][0] / children[n][1], n)):
        before, run = run, run + left[name][1]
        out[name] = rest * run // whole - rest * before // whole
    return out


def brute(rows, seed=0, part=mixing.PART_OF_TOKENS, epochs=mixing.EPOCHS):
    leaves = defaultdict(int)
    for _, *leaf, tokens in rows:
        leaves[tuple(leaf)] += tokens
    weights = (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        caps = defaultdict(int)
        for leaf, tokens in leaves.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] += tokens * epochs
        shares = fill(budget, {n: (c, weights[depth].get(n, mixing.DEFAULT_WEIGHT)) for n, c in caps.items()})
        return {k: v for n, b in shares.items() for k, v in down((*prefix, n), b).items()}

    targets = down((), sum(leaves.values()) * part[0] // part[1])
    assert sum(targets.values()) == min(sum(leaves.values()) * part[0] // part[1], epochs * sum(leaves.values()))
    out = []
    for leaf, target in targets.items():
        own = [(d, t) for d, *at, t in rows if tuple(at) == leaf]
        full, rest = divmod(target, leaves[leaf])
        by = defaultdict(int)
        for d, t in own:
            by[hashlib.md5(f"{seed}:{full}:{d}".encode()).hexdigest()] += t
        run, taken = 0, set()
        for h in sorted(by):
            run += by[h]
            if run <= rest:
                taken.add(h)
        for d, t in own:
            more = hashlib.md5(f"{seed}:{full}:{d}".encode()).hexdigest() in taken
            out += [(d, *leaf, t, e) for e in range(full + more)]
    return sorted(out)


def domain(source):
    digits = ""
    for c in reversed(source or ""):
        if not c.isdigit():
            break
        digits = c + digits
    return mixing.DOMAINS[int(digits[-9:]) % 4] if digits else "other"


def result(df):
    return sorted((r.doc_id, r.domain, r.lang, r.source, r.tokens, r.epoch) for r in df.collect())


@pytest.mark.parametrize("seed,bound", [(0, 50_000), (3, -1)])
def test_random_tree_with_a_hot_leaf(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", bound)
    rng = random.Random(seed)
    docs = [(k, "w " * rng.randrange(1, 30), rng.choice(["en", "en", "de", "fr", "xx"]), "src0" if k % 3 else f"src{rng.randrange(9)}") for k in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    rows = [(d, domain(s), l, s, len(words(t))) for d, t, l, s in docs]
    assert result(mixing.mixed(df, seed)) == brute(rows, seed)


def test_odd_documents(spark):
    rows = [(k, domain(None if k % 5 == 0 else f"src{k % 4}"), "unknown" if k % 7 == 0 else "en", "unknown" if k % 5 == 0 else f"src{k % 4}", len(words(t))) for k, t in TEXTS.items()]
    rows.append((1, domain("src1"), "en", "src1", 80))
    assert result(mixing.mixed(odd_documents(spark))) == brute([r for r in rows if r[4]])
    assert mixing.mixed(no_documents(spark)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    """One language of a domain is short: the other takes its part, and the domain's total is as the weights have it."""
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "de", "a", 1000), ("books", "en", "b", 1000)], "mix_domain string, mix_lang string, mix_source string, tokens long")
    got = {(r.mix_domain, r.mix_lang): r.target for r in mixing.budgets(leaves, 650, 1).collect()}
    assert got == {("web", "en"): 10, ("web", "de"): 390, ("books", "en"): 250}
    got = {(r.mix_domain, r.mix_lang): r.target for r in mixing.budgets(leaves, 1900, 1).collect()}
    assert got == {("web", "en"): 10, ("web", "de"): 1000, ("books", "en"): 890}
