"""Document quality from bytes: a convolutional network in numpy over overlapping chunks that cover the whole text.

Bytes become small learned vectors, learned filters slide over every chunk, and the strongest answer of each filter in a chunk is
pooled. The mean and the maximum of these over the chunks of a text go into one logistic unit. Embedding and filters are learned by
back-propagation on single chunks with their document's label, the last unit on whole documents that the filters have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample, logistic, probability
from .words import slices, text_bytes

#: Most labelled rows that the fit reads; it takes those that come first by a hash of the id.
TRAINING_ROWS = 4000
CHUNK, STEP = 256, 224
DEPTH, WIDTH, FILTERS, STRIDE = 4, 6, 16, 2
#: Least chunks of a text that an epoch reads; it reads more of a long text, so that all epochs together read every chunk.
CHUNKS_PER_EPOCH = 8
EPOCHS, BATCH, RATE = 12, 128, 0.01
#: Least steps of a fit. A few dozen texts give some three steps an epoch, which teach little; the epochs are read again until there are as many.
LEAST_STEPS = 300
BLOCK = 512  # chunks at once in scoring
PREDICTED_FROM = 0.3


def chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of texts that begin at ``at`` and the first chunk of each text; every byte is in one, an empty text has an empty one."""
    sizes = np.diff(at)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STEP)) // STEP))
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    return at[:-1][owner] + (np.arange(first[-1]) - first[owner]) * STEP, first


def _bytes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The chunks' bytes; 0 behind a text's end."""
    place = starts[:, None] + np.arange(CHUNK)
    inside = place < stops[:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)


def _columns(vectors: np.ndarray) -> np.ndarray:
    """All positions of a filter: (chunks, positions, WIDTH * DEPTH)."""
    n, length, depth = vectors.shape
    shape = n, (length - WIDTH) // STRIDE + 1, WIDTH * depth
    s = vectors.strides
    return np.lib.stride_tricks.as_strided(vectors, shape, (s[0], s[1] * STRIDE, s[2]))


def _answers(x: np.ndarray, net) -> np.ndarray:
    """The strongest answer of each filter in each chunk."""
    embedding, filters, bias = net
    columns = _columns(np.ascontiguousarray(embedding[x]))
    return np.maximum((columns.reshape(-1, columns.shape[2]) @ filters).reshape(len(x), -1, FILTERS).max(1) + bias, 0)


def _pooled(data: np.ndarray, at: np.ndarray, net) -> np.ndarray:
    """Mean and maximum of the chunks' answers for every text."""
    starts, first = chunks(at)
    stops = np.repeat(at[1:], np.diff(first))
    answers = np.concatenate([_answers(_bytes(data, starts[k:k + BLOCK], stops[k:k + BLOCK]), net) for k in range(0, len(starts), BLOCK)])
    return np.hstack([np.add.reduceat(answers, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(answers, first[:-1])]).astype(np.float64)


def _epochs(first: np.ndarray, rng) -> list[np.ndarray]:
    """The chunks that each epoch reads, of texts with the chunks ``first[k]`` to ``first[k + 1]``: the next ones in an order drawn for each text."""
    epochs: list[list[np.ndarray]] = [[] for _ in range(EPOCHS)]
    for begin, end in zip(first[:-1], first[1:]):
        order, count = begin + rng.permutation(end - begin), end - begin
        each = min(count, max(CHUNKS_PER_EPOCH, -(-count // EPOCHS)))
        for k in range(EPOCHS):
            epochs[k].append(order[(k * each + np.arange(each)) % count])
    return [np.concatenate(e or [np.zeros(0, int)]).astype(int) for e in epochs]


def _network(x: np.ndarray, y: np.ndarray, epochs: list[np.ndarray], rng) -> tuple:
    """Embedding, filters and biases, by Adam on the log loss of single chunks; both labels weigh alike."""
    net = [rng.normal(0, 0.5, (256, DEPTH)), rng.normal(0, 0.3, (WIDTH * DEPTH, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), np.zeros(1)]
    net = [p.astype(np.float32) for p in net]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net]
    if not len(x):
        return tuple(net[:3])
    share = y[epochs[0]].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    step = 0
    passes = -(-LEAST_STEPS // max(1, sum(-(-len(e) // BATCH) for e in epochs)))
    for epoch in epochs * passes:
        order = epoch[rng.permutation(len(epoch))]
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            b, target = x[some], y[some]
            embedding, filters, bias, out, shift = net
            columns = _columns(embedding[b])
            z = (columns.reshape(-1, WIDTH * DEPTH) @ filters).reshape(len(b), -1, FILTERS)
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + bias
            h = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ out + shift, -30, 30)))
            error = ((p - target) * weight[some] / len(b)).astype(np.float32)
            dh = np.where(top > 0, error[:, None] * out, 0)
            picked = np.take_along_axis(columns, best[:, :, None], 1)  # (n, FILTERS, WIDTH * DEPTH)
            d_filters = np.einsum("nf,nfd->df", dh, picked)
            d_columns = (dh[:, :, None] * filters.T[None]).reshape(len(b), FILTERS, WIDTH, DEPTH)
            place = best[:, :, None] * STRIDE + np.arange(WIDTH)
            d_embedding = np.zeros_like(embedding)
            np.add.at(d_embedding, b[np.arange(len(b))[:, None, None], place], d_columns)
            grads = [d_embedding, d_filters, dh.sum(0), h.T @ error, error.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[i] = (net[i] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tuple(net[:3])


def fit(sample: list[tuple[str, int]]) -> tuple:
    """The network and the last unit: two thirds of the distinct texts teach the filters, the others the last unit."""
    rng = np.random.default_rng(11)
    distinct = sorted(set(sample))
    order = rng.permutation(len(distinct))
    data, at = text_bytes(pa.array([distinct[i][0] for i in order], pa.large_string()))
    y = np.array([distinct[i][1] for i in order], np.float32)
    starts, first = chunks(at)
    teach = np.arange(len(order)) % 3 < 2
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(order)), sizes)
    picked = np.flatnonzero(teach[owner]) if len(order) else np.zeros(0, int)
    x = _bytes(data, starts[picked], at[1:][owner[picked]]) if len(picked) else np.zeros((0, CHUNK), np.uint8)
    net = _network(x, y[owner[picked]], _epochs(np.concatenate([[0], np.cumsum(sizes[teach])]), rng), rng)
    if teach.all():
        return net, (np.zeros(2 * FILTERS + 1), 0.0, 1.0)
    pooled = _pooled(data, at, net)
    return net, logistic(pooled[~teach], y[~teach])


def scores(texts, model) -> np.ndarray:
    data, at = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    return probability(_pooled(data, at, model[0]), model[1])


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(scores(part.column("text"), model))], names=["doc_id", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs``, which needs ``doc_id`` and ``text``.

    ``labels`` has ``doc_id`` and ``quality``; at most ``rows`` of it, none of fold ``held_out``, fit the network. Every text is
    scored whole, from its bytes alone. Null and empty texts count as one empty chunk. Without labels of both kinds scores say
    little, but every row has one. A null id is never held out. Other columns are ignored.
    """
    model = fit(labelled_sample(docs, labels, "quality", folds, held_out, rows))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.mapInArrow(_scored(model), "doc_id long, score double")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the network does not reject; scored where they lie, without a join."""
    model = fit(labelled_sample(docs, labels, "quality", folds, held_out, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores(part.column("text"), model) >= PREDICTED_FROM))

    return docs.mapInArrow(run, docs.schema)
