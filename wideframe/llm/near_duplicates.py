"""Near-duplicate documents: universal hash minima in bands, signature and set verification, components by stars.

Plan. Texts are read once for signatures; equal shingle sets form classes and only a class's smallest document goes on. Every
band bucket is first a star around its smallest member. A document checks the one centre with which it shares most bands, by
signature and then by full sets, and the links give components. Buckets of two whose pair was not that one are checked alike. Larger
buckets that still hold several components are compared in full, in blocks of bounded size, where a task keeps only links that join components that it has not joined yet. So no group of
copies is written out as pairs, and no pair of a bucket whose ends are in different components goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .components import components
from .words import Words, gram_hashes, gram_starts, mixed, slices

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band in 5 of a million cases
#: Equal minima below which a pair is not looked at further; at the threshold that happens in 1 of a million cases.
LEAST_EQUAL = 72
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20
#: Ids that may be broadcast (about 50 bytes each in memory, 25 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and the place of each text's first."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    starts, owner = gram_starts(words.first, n)
    grams = gram_hashes(hashes, n)[starts]
    counts = np.diff(words.first)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole sequence is the one shingle
        short = np.array([gram_hashes(hashes[words.first[k]:words.first[k + 1]], int(counts[k]))[0] + np.uint64(counts[k]) for k in few], np.uint64)
        grams, owner = np.concatenate([grams, mixed(short)]), np.concatenate([owner, few])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            grams, first = shingle_sets(part.column("text"))
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            minima = np.zeros((part.num_rows, BANDS * ROWS), np.uint32)
            sums = np.zeros((2, part.num_rows), np.uint64)
            if len(some):
                at = first[:-1][some]
                high = np.empty_like(grams)
                for k in range(BANDS * ROWS):
                    np.multiply(grams, _FACTORS[k], out=high)
                    np.add(high, _SHIFTS[k], out=high)
                    np.right_shift(high, np.uint64(32), out=high)
                    minima[some, k] = np.minimum.reduceat(high, at)
                for k in (0, 1):
                    sums[k, some] = np.add.reduceat(mixed(grams ^ _SHIFTS[k]), at)
            signature = [row.tobytes() if n else None for row, n in zip(minima, sizes)]
            yield pa.record_batch([part.column("doc_id"), part.column("digest"), pa.array(sizes, pa.int64()), pa.array(sums[0].view(np.int64)),
                                   pa.array(sums[1].view(np.int64)), pa.array(signature, pa.binary())],
                                  names=["doc_id", "digest", "n_shingles", "one", "two", "signature"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts those whose full shingle sets are similar enough."""
    for batch in batches:
        for part in slices(batch, "text_a"):
            one, first = shingle_sets(part.column("text_a"))
            two, second = shingle_sets(part.column("text_b"))
            keep = [_similar(one[first[k]:first[k + 1]], two[second[k]:second[k + 1]]) for k in range(part.num_rows)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Forest:
    """Which nodes are joined so far inside one block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one bucket (or inside one) that join components: exact, and no more of them than nodes."""
    left, right = group[group.block == group.i.iloc[0]], group[group.block == group.j.iloc[0]]
    a, b = (np.frombuffer(b"".join(side.signature), np.uint32).reshape(len(side), -1) for side in (left, right))
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(BANDS * ROWS):
        equal += a[:, k, None] == b[None, :, k]
    apart = left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :]
    rows, columns = np.nonzero((equal >= LEAST_EQUAL) & apart)
    order = np.argsort(-equal[rows, columns], kind="stable")
    texts = {}
    forest, found = _Forest(), []
    nodes = left.node.to_numpy(), right.node.to_numpy()
    parts = left.component.to_numpy(), right.component.to_numpy()
    sides = []
    for side, use in ((left, rows), (right, columns)):
        need = np.unique(use)
        grams, first = shingle_sets(pa.array(side.text.iloc[need], pa.large_string()))
        sides.append({int(k): grams[first[p]:first[p + 1]] for p, k in enumerate(need)})
    del texts
    for r, c in zip(rows[order].tolist(), columns[order].tolist()):
        x, y = int(parts[0][r]), int(parts[1][c])
        if forest.root(x) != forest.root(y) and _similar(sides[0][r], sides[1][c]):
            forest.join(x, y)
            found.append((int(nodes[0][r]), int(nodes[1][c])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _among(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``node, text`` for ``places`` (``node, doc_id, digest``), which is broadcast only if it is small."""
    places = places if places.count() > BROADCAST_IDS else F.broadcast(places)
    return docs.join(places, ["doc_id", "digest"]).groupBy("node").agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``, which needs ``doc_id`` (whole number) and ``text``.

    Words are lower-cased (A to Z) and split at blanks; a document's set holds its distinct shingles of five words, or its whole
    sequence if it is shorter. Documents whose sets share three quarters of their union are linked, ``component_id`` is the
    smallest ``doc_id`` reachable and ``kept`` marks that document.

    Null, empty and blank texts have no shingles and are linked with nothing. A null ``doc_id`` has no component and is kept.
    Rows that repeat a ``doc_id`` are one document: should their texts differ, each of them is linked with what is like it, and all
    that is linked with any of them is one component. Other columns are ignored. An empty table gives no rows. A long text is held whole by
    the task that reads it.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    signed = stage(docs.mapInArrow(_signatures, "doc_id long, digest long, n_shingles long, one long, two long, signature binary"), "signatures")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    # Small sides of joins are staged where they were grouped by the join's key: a join over a fresh exchange on either side
    # lets adaptive execution split a key that holds many rows, a class of copies or a bucket of near copies.
    classes = usable.groupBy("one", "two").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    classes = stage(classes.select("one", "two", F.monotonically_increasing_id().alias("node"), "first.*"), "classes")
    members = stage(usable.select("doc_id", "one", "two").join(classes.select("one", "two", "node"), ["one", "two"]).select("doc_id", "node").distinct(), "members")
    nodes = usable.join(classes, ["one", "two", "doc_id", "digest"]).dropDuplicates(["node"])
    nodes = stage(nodes.select("node", "doc_id", "digest", "signature"), "nodes")
    # Several sets of shingles under one id: versions of a document.
    versions = stage(members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a"), "versions")
    versions = members.join(versions, "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keys = nodes.select("node", "signature", band.alias("band"))
    keys = keys.select("node", F.xxhash64(F.expr(f"substring(signature, band * {4 * ROWS} + 1, {4 * ROWS})"), "band").alias("key"))
    centres = stage(keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1"), "centres")
    buckets = stage(keys.join(centres, "key"), "buckets")

    # A star around each bucket's smallest member; each document checks the centre it shares most bands with.
    shared = buckets.filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", F.negative("centre").alias("c"))).alias("m")).select(F.negative("m.c").alias("a"), F.col("node").alias("b"))
    equal = F.expr(" + ".join(f"int(substring(sa, {4 * k + 1}, 4) = substring(sb, {4 * k + 1}, 4))" for k in range(BANDS * ROWS)))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs ``a, b`` the links: by signature, then by full sets."""
        signs = nodes.select("node", "signature")
        likely = stage(pairs.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b").filter(equal >= LEAST_EQUAL).select("a", "b"), "pairs")
        ends = likely.select("a").union(likely.select("b")).distinct().toDF("node")
        texts = stage(_among(docs, nodes.select("node", "doc_id", "digest").join(ends, "node", "left_semi")), "texts")
        return stage(likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").mapInArrow(_verified, "a long, b long"), "links")

    best = stage(best, "best")
    links = stage(confirmed(best).union(versions), "first-links")
    labels = stage(components(links), "labels")
    label = F.coalesce("component", "node")

    # Buckets of two: their pair, unless it was the one checked or its ends are joined by now.
    twos = buckets.filter("size = 2 and node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct().join(best, ["a", "b"], "left_anti")
    ends = [labels.toDF(n, f"c{n}") for n in ("a", "b")]
    twos = twos.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.union(confirmed(twos))

    # Buckets of three and more that still hold several components: all their pairs, in blocks.
    open_ = buckets.filter("size > 2").join(labels, "node", "left").select("key", "node", "size", label.alias("component"))
    several = (open_.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content"), F.max("size").alias("size"))
               .filter("low < high").groupBy("content", "size").agg(F.min("key").alias("key")).select("key"))
    rest = stage(open_.join(several, "key", "left_semi"), "open")
    texts = _among(docs, nodes.select("node", "doc_id", "digest").join(rest.select("node").distinct(), "node", "left_semi"))
    full = stage(rest.join(nodes.select("node", "signature"), "node").join(texts, "node"), "blocks")
    sizes = full.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    full = full.join(stage(sizes, "sizes"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("key", "node", "component", "signature", "text", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    more = full.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long")
    labels = components(stage(links.union(more), "links"))

    # A component's name is its smallest document, which is the first of one of its classes.
    labels = stage(labels, "labels")
    own = classes.select("node", F.col("doc_id").alias("first")).join(labels, "node", "left")
    names = stage(own.filter("component is not null").groupBy("component").agg(F.min("first").alias("name")), "names")
    named = stage(own.join(names, "component", "left").select("node", F.coalesce("name", "first").alias("component")), "named")
    found = members.join(named, "node").groupBy("doc_id").agg(F.min("component").alias("component"))
    return (signed.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
