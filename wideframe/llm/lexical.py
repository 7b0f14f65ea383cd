"""Ranked lexical search: every document against each item, through quadtrees over blocks of documents.

Documents are cut into ranges. The terms that the items use and the documents of a range make a grid whose points are impacts, what a
term adds to a document's score. ``treap`` holds it as a compressed quadtree with the largest impact of every cell; an item's terms are rows whose paths
go down together over ranges of documents, the most promising first, until none can reach the item's best so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .treap import Treap
from .words import slices, text_bytes

#: Signs that end a term, as a pattern for the JVM and as bytes: ASCII other than digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: (item, term) pairs in one pass over the documents; what is sent to each executor is about 40 bytes a pair. More items take more passes.
PAIRS = 500_000
#: A block of documents is searched when it has so many documents or points: about 100 MB.
DOCUMENTS, POINTS = 1 << 14, 1 << 20
#: Documents, about, from which the thresholds start; the search itself covers all.
START = 1 << 15
#: The saturation of term counts and the share of length in it, in whole numbers of the score's formula.
LENGTH, SCALE = 50, 1_000_000_000

_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item long, doc_id long, score long"

_INSIDE, _SMALL = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL[65:91] += 32


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats; A to Z in small letters, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0))


def _posted(vocabulary: pa.Array):
    """For each document its number of terms, and of those in the vocabulary which it has how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, at = text_bytes(batch.column("text"))
                inside = np.append(_INSIDE[data], False)
                edges = at[(at > 0) & (at < len(data))]
                begins = inside & ~np.append(False, inside[:-1])
                begins[edges] = inside[edges]  # a term does not run on into the next text
                starts = np.flatnonzero(begins)
                first = np.searchsorted(starts, at)
                offsets = np.searchsorted(np.flatnonzero(inside), np.append(starts, len(data))).astype(np.int64)
                content = pa.py_buffer(_SMALL[data[inside[:-1]]])
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), content])
                term = pc.index_in(words, value_set=vocabulary)
                hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
                owner = np.searchsorted(first, hit, "right") - 1
                key, counts = np.unique(owner * len(vocabulary) + term.drop_null().to_numpy().astype(np.int64), return_counts=True)
                doc, term = np.divmod(key, max(len(vocabulary), 1))
                offsets = pa.array(np.searchsorted(doc, np.arange(len(at))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, counts)]
                yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
    return run


def _searched(items: list[np.ndarray], weights: np.ndarray, least: np.ndarray, number: int, total: int, k: int):
    """Each item's best documents of a task, block after block; what it has found so far bounds the later blocks."""
    # Rows go by weight, so that cells hold terms of like impact.
    row_of = np.empty(len(weights), np.int64)
    row_of[np.argsort(-weights, kind="stable")] = np.arange(len(weights))

    def search(blocks: list[tuple[np.ndarray, ...]], best: list[tuple[np.ndarray, np.ndarray]]) -> None:
        doc_id, n, sizes, term, count = (np.concatenate(x) for x in zip(*blocks))
        owner = np.repeat(np.arange(len(doc_id)), sizes)
        m = 100 - LENGTH + (LENGTH * n * number) // total
        impact = weights[term] * ((SCALE * count) // (1000 * count + 20 * m[owner]))
        treap = Treap(row_of[term], owner, impact, len(weights), len(doc_id))
        for i, rows in enumerate(items):
            docs, scores = best[i]
            at, found = treap.best(row_of[rows], max(int(least[i]), int(scores[-1]) if len(scores) == k else 1), k)
            docs, scores = np.append(docs, doc_id[at]), np.append(scores, found)
            order = np.lexsort((docs, -scores))[:k]
            best[i] = docs[order], scores[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best, blocks, docs, points = [(none, none)] * len(items), [], 0, 0
        for batch in batches:
            at = 0
            ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
            while at < batch.num_rows:
                room = int(np.searchsorted(ends, ends[at] + POINTS - points, "right")) - 1
                stop = min(max(room, at + 1), at + DOCUMENTS - docs, batch.num_rows)
                part = batch.slice(at, stop - at)
                columns = [part.column(c) for c in ("doc_id", "n", "terms", "counts")]
                blocks.append((*(c.to_numpy().astype(np.int64) for c in columns[:2]), np.diff(ends[at:stop + 1]), *(c.flatten().to_numpy().astype(np.int64) for c in columns[2:])))
                docs, points, at = docs + stop - at, points + int(ends[stop] - ends[at]), stop
                if docs >= DOCUMENTS or points >= POINTS or room <= at < batch.num_rows:
                    search(blocks, best)
                    blocks, docs, points = [], 0, 0
        if blocks:
            search(blocks, best)
        item = np.repeat(np.arange(len(best)), [len(d) for d, _ in best])
        if len(item):
            yield pa.record_batch([pa.array(item), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*best))], names=["item", "doc_id", "score"])
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents by the terms they share, equal scores by ``doc_id``; only scores above 0.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` ``item_id`` and ``text``. A term weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
    adds ``w * (10^9 tf div (1000 tf + 20 m))`` with ``m = 50 + 50 n N div L``, in whole numbers; ``n`` are a document's terms, ``L`` those of all, ``N``
    the documents that have any.

    Null texts have no terms; documents and items without terms have no rows. Null ids take no part. The texts of rows that repeat an item's id are read
    as one item; rows that repeat a document's id are documents of their own. Texts of any length are read whole, items of any number are dealt
    over passes of ``PAIRS`` terms. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    asked = items.select(F.col("item_id").cast("long"), F.explode(terms_of(F.col("text"))).alias("term")).filter("item_id is not null").distinct()
    asked = stage(asked, "item-terms")
    passes = max(1, math.ceil(asked.count() / PAIRS))
    found = [_one_pass(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p), k) for p in range(passes)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _one_pass(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    pairs = asked.orderBy("item_id", "term").collect()  # about PAIRS rows
    if not pairs:
        return None
    names = sorted({r["term"] for r in pairs})
    number_of = {t: i for i, t in enumerate(names)}
    ids = sorted({r["item_id"] for r in pairs})
    rows: dict[int, list[int]] = {i: [] for i in ids}
    for r in pairs:
        rows[r["item_id"]].append(number_of[r["term"]])
    rows_of = [np.array(rows[i], np.int64) for i in ids]
    vocabulary = pa.array([t.encode("utf-8") for t in names], pa.large_binary())

    postings = stage(docs.mapInArrow(_posted(vocabulary), _POSTINGS).filter("n > 0"), "postings")
    number, total = postings.agg(F.count("*"), F.sum("n")).first()
    if not number:
        return None
    frequency = np.zeros(len(names), np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row per term asked
        frequency[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * number + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)

    def searched(part: DataFrame, least: np.ndarray) -> DataFrame:
        return part.mapInArrow(_searched(rows_of, weights, least, number, total, k), _FOUND)

    least = np.ones(len(ids), np.int64)
    share = math.ceil(number / START)
    if share > 1:
        # The k-th best score among some documents bounds that of all from below.
        some = _best(searched(postings.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), least), k).filter(F.col("rank") == k)
        for r in some.collect():  # a row per item
            least[r["item"]] = r["score"]
    named = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "item long, item_id long")
    return _best(searched(postings, least), k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
