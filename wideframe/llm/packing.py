"""Documents packed into as few training sequences as possible by vector best-fit over three capacities.

A sequence has room for tokens, for pieces of documents and for attention cost (the sum of squared piece lengths). A piece goes to the
sequence whose weighted residual vector fits it best and which has room in every component.

What a piece asks for depends on its length only, and lengths are whole numbers up to the capacity. So the fit runs over the number of
pieces of each length: sequences with the same filling are one class with a multiplicity, and a whole run of equal pieces meets a whole class
at once. That takes a histogram of at most ``tokens`` rows and gives a plan of bounded size however many documents there are. The
pieces are then numbered within their length, by running counts per partition, and each finds its place in the plan by its number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread, stage
from .words import Words, slices

#: The token behind every document.
END = 0
#: Words whose ids a task remembers, and their bytes: about 150 MB at most. Beyond them it starts anew.
MEMO_WORDS, MEMO_BYTES = 600_000, 32 << 20
#: Words that go to the tokenizer's library as one text.
TOGETHER = 64
#: Signs that are a word of their own behind an ASCII letter or digit.
TAILS = b".,;:!?"
#: Pieces in one Arrow batch; 32 MB at 2,048 tokens.
BATCH = 4096
#: Rows of the table of counts per partition and length that may be broadcast (about 100 bytes each in memory, 30 MB); more are joined by a shuffle.
BROADCAST_COUNTS = 300_000

_TAIL, _STEM = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(TAILS)] = True
_STEM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True

_PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, seen long"


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds: tokens, pieces, and the sum of the squared lengths of its pieces; ``None`` sets what the tokens imply anyway.

    ``weights`` are those of the three components in the choice of a sequence. ``choice`` is ``norm`` (the smallest weighted norm of what is
    left behind, after the piece) or ``dot`` (the largest weighted product of what is left and what the piece asks).
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    choice: str = "norm"

    def limits(self) -> np.ndarray:
        most = [self.tokens, self.tokens if self.documents is None else self.documents,
                self.tokens**2 if self.attention is None else self.attention]
        if min(most) < 1 or self.choice not in ("norm", "dot"):
            raise ValueError("capacities are 1 or more, the choice is norm or dot")
        return np.array(most, np.int64)

    def longest(self) -> int:
        """Pieces are cut at this length, so that one of them always fits an empty sequence."""
        return min(self.tokens, math.isqrt(int(self.limits()[2])))


def plan(counts: Mapping[int, int], capacities: Capacities) -> tuple[np.ndarray, int]:
    """Where pieces go, from their number per length: rows ``length, first, copies, each, sequence, offset``, and the number of sequences.

    Of a length's pieces, numbered from 0, those from ``first`` on are dealt ``each`` to one of ``copies`` sequences, numbered from ``sequence`` on,
    and lie there from ``offset`` on. Lengths are taken from the longest down. A length adds at most two classes of open sequences and two
    of new ones, so the plan has at most four rows per length and per length that fits beside it.
    """
    limits = capacities.limits()
    scale, weights = 1.0 / limits, np.array(capacities.weights)
    # Classes of equal residuals: their residual vector, and stacks of (filling, number of sequences).
    left = np.zeros((0, 3), np.int64)
    stacks: list[list[list[int]]] = []
    where: dict[tuple[int, ...], int] = {}
    fillings: list[tuple[int, int, int]] = [(-1, 0, 0)]  # (the filling before, length, pieces of it)

    def add(residual: np.ndarray, filling: int, number: int) -> None:
        nonlocal left
        key = tuple(residual.tolist())
        if key not in where:
            where[key] = len(stacks)
            left = np.vstack([left, residual])
            stacks.append([])
        stacks[where[key]].append([filling, number])

    for length in sorted(counts, reverse=True):
        number = int(counts[length])
        asks = np.array([length, 1, length * length], np.int64)
        while number:
            open_ = np.flatnonzero((left >= asks).all(1))
            open_ = np.array([k for k in open_ if stacks[k]], np.int64)
            if len(open_):
                rest = left[open_] * scale
                worth = (weights * rest * (asks * scale)).sum(1) if capacities.choice == "dot" else -(weights * (rest - asks * scale) ** 2).sum(1)
                best = int(open_[worth.argmax()])
                residual, stack = left[best], stacks[best]
                filling, there = stack[-1]
            else:
                residual, stack, filling, there = limits, None, 0, number
            # By norm the sequence just chosen stays the best one until it is full; by product the next one is.
            each = int((residual // asks).min()) if capacities.choice == "norm" or stack is None else 1
            each = min(each, number)
            taken = min(there, number // each)
            if stack is not None:
                stack[-1][1] -= taken
                if not stack[-1][1]:
                    stack.pop()
            fillings.append((filling, length, each))
            add(residual - each * asks, len(fillings) - 1, taken)
            number -= taken * each

    rows, next_piece, sequence = [], dict.fromkeys(counts, 0), 0
    for filling, copies in ((f, n) for stack in stacks for f, n in stack):
        offset = 0
        while fillings[filling][0] >= 0:
            filling, length, each = fillings[filling]
            rows.append((length, next_piece[length], copies, each, sequence, offset))
            next_piece[length] += copies * each
            offset += each * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequence


class _Encoder:
    """Ids of whole columns of text: every distinct word is encoded once, words are what white space parts.

    A full stop or the like behind an ASCII letter or digit is a word of its own, as no pattern of the vocabulary goes on there.
    """

    def __init__(self, model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        words = self.tokenizer.get_vocab()
        #: Ids that end a word; of letters alone, each word ends with one.
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.tails = not any(set(t.content) & set(TAILS.decode()) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.bytes, self.flat, self.begin = 0, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Words of letters go to the library many at a time, as a call costs more than a word."""
        out: list[list[int]] = [[]] * len(words)
        plain = [k for k, w in enumerate(words) if w.isalpha()]
        rest = [k for k, w in enumerate(words) if not w.isalpha()]
        groups = [plain[k:k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self._each([" ".join(words[k] for k in g) for g in groups])):
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # a letter to the interpreter need not be one to the library
                rest += group
                continue
            for k, begin, stop in zip(group, [0, *stops[:-1].tolist()], stops.tolist()):
                out[k] = ids[begin:stop]
        for k, ids in zip(rest, self._each([words[k] for k in rest])):
            out[k] = ids
        return out

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The place of each word's ids in ``flat``; new ones are encoded and remembered."""
        if len(self.memo) + len(words) > MEMO_WORDS or self.bytes > MEMO_BYTES:
            self.forget()
        new = [w for w in words if w not in self.memo]
        coded = self._coded([w.decode("utf-8") for w in new])
        self.memo.update(zip(new, range(len(self.begin) - 1, len(self.begin) - 1 + len(new))))
        self.bytes += sum(map(len, new))
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum([len(c) for c in coded], dtype=np.int64))
        self.flat = np.append(self.flat, np.fromiter((i for c in coded for i in c), np.uint32))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin; the end of the last is the last entry."""
        words = Words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first, size, content = words.first, words.ends - words.starts, words.data[words.inside]
        at = np.append(0, np.cumsum(size))
        if self.tails:
            tail = (size > 1) & _TAIL[content[at[1:] - 1]] & _STEM[content[np.maximum(at[1:] - 2, 0)]]
            first = first + np.append(0, np.cumsum(tail))[first]
            at = np.insert(at, np.flatnonzero(tail) + 1, at[1:][tail] - 1)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(content)])
        coded = column.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begin, each = self.begin[number], np.diff(self.begin)[number]
        stop = np.cumsum(each)
        ids = self.flat[np.repeat(begin - (stop - each), each) + np.arange(int(stop[-1]))]
        return ids, np.append(0, stop)[first]


def _cut(model: bytes, longest: int):
    """Documents to pieces; ``seen`` counts the pieces of the same length that this partition had before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, met = _Encoder(model), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for whole in batches:
            for batch in slices(whole):
                ids, at = encoder.ids(batch.column("text"))
                ids = np.insert(ids, at[1:], END).astype("<u4")
                at = at + np.arange(len(at))
                sizes = np.diff(at)
                pieces = -(-sizes // longest)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * longest
                length = np.minimum(sizes[owner] - start, longest)
                # Number the pieces of each length in the order in which they come.
                order = np.argsort(length, kind="stable")
                firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
                seen = np.empty(len(length), np.int64)
                seen[order] = np.arange(len(length)) - np.repeat(firsts, np.diff(np.append(firsts, len(length))))
                seen += met[length]
                met += np.bincount(length, minlength=longest + 1)
                begin = at[:-1][owner] + start
                docs = batch.column("doc_id").take(pa.array(owner))
                for k in range(0, len(owner), BATCH):
                    here = slice(k, k + BATCH)
                    cells = ids[begin[k]:begin[here][-1] + length[here][-1]]
                    edges = np.append(begin[here] - begin[k], len(cells)).astype(np.int32) * 4
                    yield pa.record_batch([
                        docs.slice(k, BATCH), pa.array(piece[here].astype(np.int32)), pa.array(start[here]), pa.array(length[here]),
                        pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(cells))]),
                        pa.array(np.full(len(edges) - 1, part, np.int32)), pa.array(seen[here])],
                        names=["doc_id", "piece", "start", "length", "ids", "part", "seen"])
    return run


def _placed(rows: np.ndarray):
    """Each piece's sequence and offset, by its number among the pieces of its length."""
    length, first, copies, each, sequence, offset = rows.T if len(rows) else np.zeros((6, 0), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            # Plan rows are sorted by (length, first); the last one that begins at or before the piece holds it.
            low, high = np.searchsorted(length, mine, "left"), np.searchsorted(length, mine, "right")
            while (open_ := high - low > 1).any():
                middle = (low + high) // 2
                right = open_ & (first[np.minimum(middle, len(first) - 1)] <= number)
                low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
            copy, turn = np.divmod(number - first[low], each[low])
            yield pa.record_batch([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]
                                  + [pa.array(sequence[low] + copy), pa.array(offset[low] + turn * mine)],
                                  names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, capacities: Capacities = Capacities()) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: a row per piece, with its token ids and its place.

    ``docs`` needs ``doc_id`` and ``text``; ``tokenizer`` is a vocabulary file (``.json``) that the driver can read and that drops white space,
    so that a text has the ids of its words in a row. A document is its ids and one ``END``; it is cut only where it is longer than a sequence
    may hold. ``ids`` are little-endian unsigned 32-bit numbers. Offsets of a sequence are gapless from 0.

    Null and empty texts are one ``END``. Every row is a document of its own, also where ids are null or repeat. A text of any length is encoded
    whole, in the memory of about ten times its bytes. Other columns are ignored; no rows give no rows.
    """
    with open(tokenizer, "rb") as file:
        model = file.read()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    docs = spread(docs.select(F.col("doc_id").cast("long"), text))
    # Written once: a lost executor does not change how the pieces of a partition are numbered.
    pieces = stage(docs.mapInArrow(_cut(model, capacities.longest()), _PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))), "counts")
    # A row per length: at most as many as a sequence has tokens.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(totals, capacities)
    earlier = counts.select("part", "length", "earlier")
    earlier = F.broadcast(earlier) if counts.count() <= BROADCAST_COUNTS else earlier
    numbered = pieces.join(earlier, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids", (F.col("seen") + F.col("earlier")).alias("number"))
    return numbered.mapInArrow(_placed(rows), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts``: one row per sequence of ``pack``'s result, its ids in a row and where its pieces begin."""
    place = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(place.alias("p"))
    return rows.select("sequence_id", F.concat_ws("", F.transform("p.ids", F.hex)).alias("h"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts")).select(
        "sequence_id", F.unhex("h").alias("ids"), "doc_ids", "starts")
