"""Exact largest inner products through pivots: sorted distances to the nearest pivot, and the triangle inequality.

Vectors get one more component that brings all to the same length, so that the largest inner product is the smallest distance.
Every vector belongs to its nearest pivot and lies on an annulus around it. Of a vector ``v`` of pivot ``p`` and a query ``q`` it
is known that ``d(q, v) >= |d(q, p) - d(v, p)|``. A query expands each pivot's annuli from its own distance outwards and stops where
this bound passes the distance of its k-th best so far.

Pivots are fitted on a bounded sample, the index holds every vector. A pivot's vectors are dealt by hash into parts of bounded
size, each with vectors of all annuli, so a vector that fills a third of the table is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage

#: Bounds of what the driver reads to fit the index and to start the thresholds.
SAMPLE, PIVOTS = 4096, 32
PART, ANNULUS, QUERIES = 192, 32, 4096


def _rows(cells: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of float64, shorter ones filled up with zeros."""
    sizes = np.diff(cells.offsets.to_numpy())
    values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats where they cannot round, else in integers."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a], np.int64).reshape(len(a), len(b))


def _pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Vectors of the sample far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < number and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _assigned(pivots: np.ndarray, longest: float, width: int):
    """Each vector's nearest pivot and its distance in the space where all vectors have the length ``longest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column("vector"), width)
            lifted = np.hstack([rows, np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))[:, None]])
            distance = np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * lifted @ pivots.T, 0))
            near = distance.argmin(1) if len(pivots) else np.zeros(len(rows), int)
            yield pa.record_batch([batch.column("vec_id"), pa.array(near.astype(np.int32)),
                                   pa.array(distance[np.arange(len(rows)), near] if len(rows) else np.zeros(0)),
                                   pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "pivot", "distance", "vector"])
    return run


def _started(sample_ids: np.ndarray, sample: np.ndarray, pivots: np.ndarray, width: int, k: int):
    """Queries with their distances to all pivots and the k-th best score in the sample, below which nothing can matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            rows = _rows(batch.column("vector"), width)
            scores = _products(rows, sample)
            least = np.full(len(rows), np.iinfo(np.int64).min)
            for r in range(len(rows)):
                other = scores[r][sample_ids != ids[r]]
                if len(other) >= k:
                    least[r] = np.partition(other, len(other) - k)[len(other) - k]
            lifted = np.hstack([rows, np.zeros((len(rows), 1))])
            distance = np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * lifted @ pivots.T, 0))
            yield pa.record_batch([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(least),
                                   pa.array((rows**2).sum(1)), pa.array(list(distance), pa.list_(pa.float64()))],
                                  names=["query_id", "query", "least", "norm", "distances"])
    return run


def _radius(norms: np.ndarray, longest: float, least: np.ndarray) -> np.ndarray:
    """The distance beyond which scores are below ``least``, with room for rounding."""
    square = norms + longest**2 - 2 * least.astype(np.float64)
    return np.sqrt(np.maximum(square, 0) + 1e-6 * (norms + longest**2) + 1e-6)


def _search(longest: float, width: int, k: int):
    columns = ["query_id", "vec_id", "score"]

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        vectors = vectors.sort_values(["distance", "vec_id"])
        table = np.frombuffer(b"".join(vectors.vector), np.float64).reshape(-1, width)
        ids, distance = vectors.vec_id.to_numpy(), vectors.distance.to_numpy()
        asked = np.frombuffer(b"".join(queries["query"]), np.float64).reshape(-1, width)
        own, least = queries.query_id.to_numpy(), queries.least.to_numpy().copy()
        here, norms = queries.distance.to_numpy(), (asked**2).sum(1)
        begins = np.arange(0, len(ids), ANNULUS)
        low, high = distance[begins], distance[np.minimum(begins + ANNULUS, len(ids)) - 1]
        gap = np.maximum(np.maximum(low[None, :] - here[:, None], here[:, None] - high[None, :]), 0)
        order = np.argsort(gap, axis=1, kind="stable")
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        for turn in range(len(begins)):
            ring = order[:, turn]
            alive = np.flatnonzero(gap[np.arange(len(own)), ring] <= _radius(norms, longest, least))
            if not len(alive):
                break
            for b in np.unique(ring[alive]):
                some = alive[ring[alive] == b]
                at = slice(begins[b], begins[b] + ANNULUS)
                scores = _products(asked[some], table[at])
                for r, q in enumerate(some.tolist()):
                    ok = np.flatnonzero((scores[r] >= least[q]) & (ids[at] != own[q]))
                    if len(ok):
                        best[q] = sorted(best[q] + list(zip((-scores[r][ok]).tolist(), ids[at][ok].tolist())))[:k]
                        if len(best[q]) == k:
                            least[q] = max(least[q], -best[q][-1][0])
        found = [(int(own[q]), v, -s) for q, rows in enumerate(best) for s, v in rows]
        return pd.DataFrame(found, columns=columns, dtype="int64")
    return run


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, part: int = PART) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` largest inner products with other rows, ties to the smaller id.

    Both tables have ``vec_id`` (whole number) and ``vector`` (array of whole numbers held as doubles); the result is exact for any
    data, the index only decides what need not be multiplied. A row is compared with all rows of another id.

    Null vectors and ids, and vectors with null or non-finite components, take no part. A score beyond 64 bits fails. Shorter vectors count as filled up with zeros. Rows
    that repeat an id count once, with their smallest vector. Fewer than ``k`` rows give what there is; no rows give none.
    """
    spark = vectors.sparkSession

    def usable(df):
        return df.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>")).filter(
            F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    # One vector for each id, in the table and in the index alike.
    vectors = stage(usable(vectors).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    queries = usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    fact = vectors.agg(F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    width, longest = max(fact.width or 0, 1), math.sqrt(fact.square or 0.0) * (1 + 1e-9)
    if not math.isfinite(width * longest**2):
        raise ValueError("components are too large for their products to be whole numbers of 64 bits")
    sample = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect()
    sample_ids = np.array([r.vec_id for r in sample], np.int64)
    rows = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        rows[i, :len(r.vector)] = r.vector
    lifted = np.hstack([rows, np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))[:, None]])
    pivots = _pivots(lifted, PIVOTS)
    index = stage(vectors.mapInArrow(_assigned(pivots, longest, width), "vec_id long, pivot int, distance double, vector binary"), "index")
    # One row per pivot: how many vectors it has and between which distances.
    rings = index.groupBy("pivot").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()
    if not rings:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rings = spark.createDataFrame([(r.pivot, math.ceil(r.n / part), r.low, r.high) for r in rings], "pivot int, parts int, low double, high double")
    asked = queries.mapInArrow(_started(sample_ids, rows, pivots, width, k), "query_id long, query binary, least long, norm double, distances array<double>")
    slots = max(1, math.ceil(queries.count() / QUERIES))
    # A pivot is asked only if some distance on its annuli may still matter.
    asked = asked.select("query_id", "query", "least", "norm", F.posexplode("distances").alias("pivot", "distance")).join(F.broadcast(rings), "pivot")
    gap = F.greatest(F.col("low") - F.col("distance"), F.col("distance") - F.col("high"), F.lit(0.0))
    reach = F.col("norm") + F.lit(longest**2)
    asked = asked.filter(gap * gap <= reach - 2 * F.col("least").cast("double") + 1e-4 * (reach + 1))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("slot", F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int"))
    held = index.join(F.broadcast(rings), "pivot").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    held = held.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    group = ["pivot", "part", "slot"]
    hits = (asked.select(*group, "query_id", "query", "least", "distance").groupBy(*group)
            .cogroup(held.select(*group, "vec_id", "distance", "vector").groupBy(*group))
            .applyInPandas(_search(longest, width, k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embedding: str = "embedding", scale: int = 256):
    """A vector column with each component turned into ``floor(scale * x)``; null if a component is null or not finite."""
    cells = F.col(embedding).cast("array<double>")
    fine = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Doubles from 2^52 on are whole numbers, and beyond 2^63 there is no integer to round down to.
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return F.when(fine, F.transform(cells, lambda x: whole(F.lit(float(scale)) * x)))
