"""Bounded samples of labelled documents, for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Signs of one text in a fit. Of a longer text PIECES pieces are taken at equal distances over its whole length; scoring takes it whole.
MOST_SIGNS, PIECES = 32_768, 32


def spread_pieces(text: Column, most_signs: int = MOST_SIGNS) -> Column:
    """The text, or pieces from its start to its end, a line each, that have at most ``most_signs`` signs together."""
    size = most_signs // PIECES - 1
    gap = (F.char_length(text) - size) / F.lit(PIECES - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, F.floor(k * gap).cast("int") + 1, F.lit(size)))
    return F.when(F.char_length(text) <= most_signs, text).otherwise(F.array_join(pieces, "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, most_signs: int = MOST_SIGNS) -> list[tuple[str, int]]:
    """At most ``rows`` texts with their labels (0 or 1), in an order that does not depend on the partitioning.

    Rows with ``crc32(doc_id as text) mod folds = held_out`` are never among them, nor null texts, ids and labels. The sample follows
    a hash of the id. An id that repeats counts once, with its largest text and smallest label. A text above ``most_signs`` signs is in it with
    pieces from its whole length, so the sample has at most ``rows * most_signs`` signs.
    """
    wanted = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
              .filter(F.crc32(F.col("doc_id").cast("string")) % folds != held_out))
    # Ids first: no task and no exchange holds more texts than the sample has.
    ids = wanted.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", spread_pieces(F.col("text"), most_signs).alias("text"))
    found = found.groupBy("doc_id", "label").agg(F.max("text").alias("text")).collect()  # a row per id, of at most ``rows``
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def logistic(features, labels, penalty: float = 1e-2, rounds: int = 60):
    """Weights of a logistic model on standardised features, bias first, with the means and scales; Newton's method."""
    import numpy as np

    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack([np.ones(len(features)), (features - mean) / scale])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (p - labels) + keep * w)
        w = w - np.clip(step, -5, 5)
    return w, mean, scale


def probability(features, model):
    import numpy as np

    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(w[0] + (features - mean) / scale @ w[1:], -30, 30)))
