"""Words and their hashes for whole Arrow columns of text, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The six bytes that end a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = (32, 9, 10, 11, 12, 13)

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Odd multipliers of the polynomial hashes; two of them make 128 bits.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each text; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, a longer text alone, so that memory follows the longest text."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Where the words of some texts lie, with one 64-bit hash for each.

    ``starts`` and ``ends`` are byte positions in ``data``; text ``k`` has the words ``first[k]`` to ``first[k + 1]``.
    A word is a run of bytes other than the six of ``BLANKS``; ``lower`` folds A to Z only.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        data, at = text_bytes(texts)
        self.data = _LOWER[data] if lower else data
        inside = ~_BLANK[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < len(data))]  # a word does not run on into the next text
        begins[edges] = inside[edges]
        stops[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, at)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        terms = powers(BASES[which], int(sizes.max()))[place] * (self.data[self.inside].astype(np.uint64) + np.uint64(1))
        return mixed(np.add.reduceat(terms, begin) + sizes.astype(np.uint64))

    def text_of(self, k: int) -> np.ndarray:
        """Word numbers of text ``k``."""
        return np.arange(self.first[k], self.first[k + 1])


def gram_hashes(words: np.ndarray, n: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """The hash of every run of ``n`` words, by its first word; runs over the end of a text are the caller's to leave out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, n):
        out = out * base + words[k:k + count]
    return mixed(out)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs of ``n`` words that lie inside a text, and the text of each."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return first[:-1][owner] + np.arange(int(counts.sum())) - begin[owner], owner
