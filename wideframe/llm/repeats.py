"""Removal of passages that repeat across documents, found by recompression (``recompression.py``).

Plan. Documents are packed once into chunks of about 4 MB of text, written compressed to the shared folder; a chunk's number
is fixed by that write. Every later exchange carries one row per chunk and symbol, however many documents of the chunk hold
it, so a passage in a third of all documents costs one row per chunk and not one per document.

1. Copies: each chunk sends its distinct texts' digests with their smallest document. A copy of a smaller document is covered whole
   and sends no windows in step 3.
2. Reveal: each chunk sends the fingerprints of its windows' symbols; sorted by fingerprint, neighbours of different chunks
   are shared. Within a chunk the same is found on the spot.
3. Verify: windows under shared symbols are sent as 128-bit hashes of their words with the chunk's smallest document; the
   smallest of all goes back to the chunks that have a larger one.
4. Each chunk marks the words under windows that a smaller document holds and returns its documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .recompression import window_symbols
from .words import BASES, Words, gram_hashes, slices

WINDOW = 13
#: Stands for a missing doc_id inside a chunk: no document is smaller because of it.
NO_ID = np.iinfo(np.int64).max

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: pa.Scalar) -> tuple[np.ndarray, pa.Array]:
    table = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
    ids = table.column("doc_id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.large_string())
    return ids.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False), texts


def _first_of(ids: np.ndarray, texts: pa.Array) -> tuple[list[bytes], dict[bytes, int]]:
    """Each text's digest, and the smallest document of each."""
    digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts.fill_null("").to_pylist()]
    first: dict[bytes, int] = {}
    for digest, doc in zip(digests, ids.tolist()):
        first[digest] = min(first.get(digest, doc), doc)
    return digests, first


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            _, first = _first_of(ids, part.column("text"))
            yield pa.record_batch([
                pa.array([uuid.uuid4().int >> 66], pa.int64()), pa.array([list(first.values())], pa.list_(pa.int64())),
                pa.array([list(first)], pa.list_(pa.binary())), pa.array([_packed(part)], pa.binary())],
                names=["chunk", "ids", "digests", "blob"])


def _chunk_windows(texts: pa.Array, window: int):
    words = Words(texts)
    hashes = words.hashes()
    starts, owner, prints = window_symbols(words, hashes, window)
    return words, hashes, starts, owner, prints


def _symbols(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                prints = np.unique(_chunk_windows(_unpacked(blob)[1], window)[-1]).view(np.int64)
                yield pa.record_batch([pa.array(prints), pa.array(np.full(len(prints), chunk))], names=["symbol", "chunk"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by symbol those whose symbol another chunk has too; only the last row is held over to the next batch."""
    names, held = ["chunk", "symbol"], None
    for batch in batches:
        symbol = batch.column("symbol").to_numpy()
        chunk = batch.column("chunk").to_numpy()
        if not len(symbol):
            continue
        if held is not None:
            symbol, chunk = np.append(held[0], symbol), np.append(held[1], chunk)
        like = symbol[1:] == symbol[:-1]
        keep = np.append(False, like)
        keep[:-1] |= like
        if held is not None:
            keep[0] |= held[2]
        last = bool(len(keep) > 1 and like[-1]) or bool(len(keep) == 1 and keep[0])
        held = symbol[-1:].copy(), chunk[-1:].copy(), last
        keep = keep[:-1]
        yield pa.record_batch([pa.array(chunk[:-1][keep]), pa.array(symbol[:-1][keep])], names=names)
    if held is not None and held[2]:
        yield pa.record_batch([pa.array(held[1]), pa.array(held[0])], names=names)


def _is_in(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(values), bool)
    some = np.sort(some)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    cell = batch.column(batch.schema.get_field_index(name))[row]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.zeros(0, np.int64)


def _is_copy(batch: pa.RecordBatch, row: int, ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Documents whose text a smaller document has, in this chunk or, as ``copied`` and ``origin`` say, in another."""
    digests, first = _first_of(ids, texts)
    cell = batch.column(batch.schema.get_field_index("copied"))[row]
    if cell.is_valid:
        first.update(zip(cell.as_py(), batch.column(batch.schema.get_field_index("origin"))[row].as_py()))
    return np.fromiter((first[d] for d in digests), np.int64, len(digests)) < ids


def _windows(window: int):
    """Chunks with their shared symbols: the windows under those symbols, each with the chunk's smallest document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in enumerate(batch.column("chunk").to_pylist()):
                ids, texts = _unpacked(batch.column("blob")[row])
                words, hashes, starts, owner, prints = _chunk_windows(texts, window)
                docs = ids[owner]
                use = _is_in(prints.view(np.int64), _list(batch, "symbols", row)) & ~_is_copy(batch, row, ids, texts)[owner]
                one = gram_hashes(hashes, window)[starts[use]].view(np.int64)
                two = gram_hashes(words.hashes(1), window, BASES[1])[starts[use]].view(np.int64)
                order = np.lexsort((docs[use], two, one))
                one, two, docs = one[order], two[order], docs[use][order]
                new = np.ones(len(one), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pa.record_batch([pa.array(one[new]), pa.array(two[new]), pa.array(docs[new]), pa.array(np.full(int(new.sum()), chunk))],
                                      names=["one", "two", "doc", "chunk"])
    return run


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by window and document: to each chunk with a larger document the smallest one of all."""
    held = None
    for batch in batches:
        one, two, doc, chunk = (batch.column(k).to_numpy() for k in ("one", "two", "doc", "chunk"))
        if not len(one):
            continue
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        if held is not None and held[0] == one[0] and held[1] == two[0]:
            new[0] = False
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = np.where(group >= 0, doc[begin][np.maximum(group, 0)] if len(begin) else 0, held[2] if held is not None else 0)
        held = one[-1], two[-1], first[-1]
        keep = doc > first
        yield pa.record_batch([pa.array(chunk[keep]), pa.array(one[keep]), pa.array(first[keep])], names=["chunk", "one", "smallest"])


def _covered(ids, starts, owner, prints, one, copies, found, smallest, window, first):
    """Per word whether a window over it also starts in a smaller document."""
    docs = ids[owner]
    least = docs.copy()
    # Shared inside the chunk: the smallest document among windows with the same words.
    changes = np.ones(len(prints), bool)
    changes[1:] = (prints[1:] != prints[:-1]) | (owner[1:] != owner[:-1])
    order = np.lexsort((owner[changes], prints[changes]))
    p, o = prints[changes][order], owner[changes][order]
    several = (p[1:] == p[:-1]) & (o[1:] != o[:-1])
    at = np.flatnonzero(_is_in(prints, np.unique(p[1:][several])))
    order = at[np.lexsort((docs[at], one[at]))]
    new = np.ones(len(order), bool)
    new[1:] = one[order][1:] != one[order][:-1]
    if len(order):
        least[order] = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    if len(found):
        sort = np.argsort(found)
        found, smallest = found[sort], smallest[sort]
        place = np.minimum(np.searchsorted(found, one), len(found) - 1)
        least = np.where(found[place] == one, np.minimum(least, smallest[place]), least)
    hit = (least < docs) | copies[owner]
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, starts[hit], 1)
    np.add.at(edge, starts[hit] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept_texts(words: Words, kept: np.ndarray) -> list[bytes]:
    sizes = words.ends - words.starts
    out_sizes = np.where(kept, sizes + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(out_sizes)])
    out = np.full(int(out_at[-1]), 32, np.uint8)
    begin = np.cumsum(sizes) - sizes
    letters = np.repeat(kept, sizes)
    place = np.repeat(out_at[:-1] - begin, sizes) + np.arange(int(sizes.sum()))
    out[place[letters]] = words.data[words.inside][letters]
    ends = out_at[words.first]
    whole = out.tobytes()
    return [whole[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]


def _results(window: int, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, texts = _unpacked(batch.column("blob")[row])
                words, hashes, starts, owner, prints = _chunk_windows(texts, window)
                one = gram_hashes(hashes, window)[starts].view(np.int64)
                gone = _covered(ids, starts, owner, prints, one, _is_copy(batch, row, ids, texts), _list(batch, "found", row),
                                _list(batch, "smallest", row), window, words.first)
                counts = np.diff(words.first)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                kept = _kept_texts(words, ~gone)
                kept = [hashlib.sha256(k).hexdigest() for k in kept] if digest_only else [k.decode("utf-8", "replace") for k in kept]
                yield pa.record_batch([pa.array(ids, mask=ids == NO_ID), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                       pa.array(kept, pa.large_string())], schema=_RESULT)
    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``, a row for each row of ``docs``, which needs ``doc_id`` (whole number) and ``text``.

    Removed is each word under a run of ``window`` words that also starts in a document with a smaller ``doc_id``, judged on the
    texts as they came. ``kept_text`` joins the other words by one blank; with ``digest_only`` it is that text's SHA-256 in hex.

    Null or empty texts, and texts of blanks only, have no words. Rows that repeat a ``doc_id`` do not count as smaller than
    each other, nor does a null ``doc_id`` count as smaller than any. Shorter texts than a window keep all words. Other
    columns are ignored. A text is held whole by the task that works on it, with about thirty times its bytes.
    """
    chunks = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                   .mapInArrow(_chunks, "chunk long, ids array<long>, digests array<binary>, blob binary"), "chunks")
    blobs = chunks.select("chunk", "blob")
    each = chunks.select("chunk", F.explode(F.arrays_zip("ids", "digests")).alias("t")).select("chunk", F.col("t.ids").alias("doc"), F.col("t.digests").alias("digest"))
    first = each.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    copies = each.join(stage(first, "first"), "digest").filter("doc > first").groupBy("chunk").agg(F.collect_list("digest").alias("copied"), F.collect_list("first").alias("origin"))
    symbols = (blobs.mapInArrow(_symbols(window), "symbol long, chunk long").repartition("symbol").sortWithinPartitions("symbol", "chunk")
               .mapInArrow(_shared, "chunk long, symbol long").groupBy("chunk").agg(F.collect_list("symbol").alias("symbols")))
    marked = stage(symbols.join(copies, "chunk", "full"), "symbols")
    windows = (blobs.join(marked.filter("symbols is not null"), "chunk")
               .mapInArrow(_windows(window), "one long, two long, doc long, chunk long")
               .repartition("one").sortWithinPartitions("one", "two", "doc").mapInArrow(_smallest, "chunk long, one long, smallest long"))
    found = stage(windows.groupBy("chunk").agg(F.collect_list("one").alias("found"), F.collect_list("smallest").alias("smallest")), "windows")
    return (blobs.join(marked.select("chunk", "copied", "origin"), "chunk", "left").join(found, "chunk", "left")
            .mapInArrow(_results(window, digest_only), "doc_id long, n_words long, n_removed long, kept_text string"))
