"""Toxicity by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text.

Both dictionaries are made by zstandard's own trainer. The ordinary one comes from windows of ordinary texts. The toxic one comes
from the stretches of toxic texts whose byte sequences are confidently more frequent there, put behind the ordinary one, so that what
both kinds of text share shortens a window alike. A window's distance is the difference of its two compressed lengths; how many
windows pass thresholds, and how far, gives a probability through a calibrated logistic model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .labelled import labelled_sample, logistic, probability
from .words import slices

#: Most labelled rows that the fit reads; it takes those that come first by a hash of the id.
TRAINING_ROWS = 8000
WINDOW, STEP = 32, 24
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2048
GRAM, LEAST_SHARE, LEAST_ODDS = 6, 0.02, 1.0
THRESHOLDS = (3, 5, 7)
LEVEL = 3
PREDICTED_FROM = 0.3

# Small letters, and blanks for what is neither a letter, a digit nor part of a longer character.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows over the whole text; an empty text has one."""
    return [text[i:i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)]


def _grams(text: bytes) -> set[bytes]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Byte sequences whose odds of being in a toxic text are higher even at the lower end of a two-sigma interval."""
    a = Counter(g for t in toxic for g in _grams(t))
    a = {g: n for g, n in a.items() if n >= max(3, LEAST_SHARE * len(toxic))}
    b = Counter(g for t in ordinary for g in _grams(t) if g in a)

    def odds(g):
        x, y = a[g] + 0.5, b[g] + 0.5
        return math.log(x / (len(toxic) + 1)) - math.log(y / (len(ordinary) + 1)) - 2 * math.sqrt(1 / x + 1 / y)

    return {g for g in a if odds(g) > LEAST_ODDS}


def _stretches(text: bytes, telling: set[bytes]) -> list[bytes]:
    at = [i for i in range(len(text) - GRAM + 1) if text[i:i + GRAM] in telling]
    out, k = [], 0
    while k < len(at):
        end = k
        while end + 1 < len(at) and at[end + 1] - at[end] <= 2:
            end += 1
        out.append(text[at[k]:at[end] + GRAM])
        k = end + 1
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary by zstandard's trainer, which needs a number of samples: fewer are given to it several times. Samples of a few bytes altogether give none."""
    times = 1
    while samples and times * len(samples) <= 4096:
        try:
            return zstandard.train_dictionary(size, samples * times).as_bytes()
        except zstandard.ZstdError:
            times *= 2
    return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 4096 else b""


class Distances:
    """Both compressors; made where they are used, as only the dictionaries' bytes travel."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = (self._compressor(d) for d in (ordinary, ordinary + toxic))

    @staticmethod
    def _compressor(content: bytes):
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=content, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, text: str) -> list[float]:
        ordinary, toxic = self.ordinary.compress, self.toxic.compress
        z = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(folded(text))], float)
        over = [z >= t for t in THRESHOLDS]
        return [z.mean(), np.maximum(z, 0).mean(), *(o.mean() for o in over), *(math.log1p(o.sum()) for o in over[1:]), min(z.max(), 12.0), math.log(len(z))]


def fit(sample: list[tuple[str, int]]) -> tuple[bytes, bytes, tuple]:
    """Dictionaries and the calibrated model; half of the texts make the dictionaries and the other half the calibration."""
    rng = np.random.default_rng(5)
    distinct = sorted(set(sample))
    order = rng.permutation(len(distinct))
    build, tune = [distinct[i] for i in order[::3]] + [distinct[i] for i in order[1::3]], [distinct[i] for i in order[2::3]]
    toxic, ordinary = ([folded(t) for t, y in build if y == k] for k in (1, 0))
    base = [w for t in ordinary for w in windows(t)]
    base = [base[i] for i in rng.permutation(len(base))]
    telling = _telling(toxic, ordinary)
    marks = [s for t in toxic for s in _stretches(t, telling)]
    marks = [marks[i] for i in rng.permutation(len(marks))]
    marks = [b"".join(marks[i:i + 4]) for i in range(0, len(marks), 4)]
    dictionaries = _trained(ORDINARY_BYTES, base), _trained(TOXIC_BYTES, marks)
    if not tune:
        return *dictionaries, (np.zeros(len(THRESHOLDS) + 7), 0.0, 1.0)
    distance = Distances(*dictionaries)
    x, y = np.array([distance.features(t) for t, _ in tune]), np.array([k for _, k in tune], float)
    return *dictionaries, logistic(x, y)


def _scored(ordinary: bytes, toxic: bytes, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distances(ordinary, toxic)
        for batch in batches:
            for part in slices(batch):
                x = np.array([distance.features(t or "") for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(probability(x, model))], names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs``, which needs ``doc_id`` and ``text``.

    ``labels`` has ``doc_id`` and ``toxic``; at most ``rows`` of it, none of fold ``held_out``, fit the dictionaries and the calibration.
    Every text is scored whole, from its bytes alone. Null and empty texts count as one empty window. Without labels of both
    kinds scores say little, but every row has one. A null id is never held out. Other columns are ignored.
    """
    model = fit(labelled_sample(docs, labels, "toxic", folds, held_out, rows))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.mapInArrow(_scored(*model), "doc_id long, score double")
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    return scored.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
