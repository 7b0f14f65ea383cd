"""Conversations as token sequences: segments encoded apart, reserved ids spliced between them, masks by prefix sums.

A turn reads, in ids, ``TURN role TEXT content END``. The three reserved ids lie above the vocabulary, so no text can encode to
them. In the readable form they are the strings of ``MARKS``; a content that holds such a string, or the headings of ``CONTROLS``,
is escaped so that the readable form has them only where the template put them. Unescaping gives every content back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed strings: what the reserved ids read as, in the order of the ids, and further strings that chat templates use.
MARKS = ("<turn>", "<text>", "</turn>")
CONTROLS = MARKS + ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "### User:", "### Assistant:", "### System:")
BATCH = 256

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

ASSEMBLED = "conv_id long, turn long, role string, ids array<int>, loss array<boolean>, start long"


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first sign of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _tokenizer(model: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode("utf-8"))
    tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
    return tokenizer


def _assembled(model: bytes):
    """Rows to token sequences; needs no other row of the conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(model)
        turn_id, text_id, end_id = (tokenizer.get_vocab_size() + k for k in range(len(MARKS)))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
                segments = [escape(s) for pair in zip(roles, texts) for s in pair]
                coded = [np.asarray(e.ids, np.int32) for e in tokenizer.encode_batch(segments, add_special_tokens=False)]
                ids, loss = [], []
                for k, role in enumerate(roles):
                    head, content = coded[2 * k], coded[2 * k + 1]
                    ids.append(np.concatenate([[turn_id], head, [text_id], content, [end_id]]).astype(np.int32))
                    # +1 where the loss begins and -1 behind its end; the sums so far are the mask.
                    edges = np.zeros(len(ids[-1]) + 1, np.int8)
                    if role == "assistant":
                        begin = len(head) + 2
                        edges[begin] += 1
                        edges[begin + len(content)] -= 1
                    loss.append(np.cumsum(edges)[:-1] > 0)
                sizes = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.record_batch([
                    batch.column("conv_id"), batch.column("turn"), batch.column("role"),
                    pa.ListArray.from_arrays(sizes, np.concatenate(ids)), pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(loss))),
                    pa.array(np.zeros(batch.num_rows), pa.int64())], names=["conv_id", "turn", "role", "ids", "loss", "start"])
    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of turns in order the place of each in its conversation's sequence; only the last turn's is carried over."""
    conversation, place = object(), 0
    for batch in batches:
        starts = []
        sizes = np.diff(batch.column("ids").offsets.to_numpy())
        for conv, size in zip(batch.column("conv_id").to_pylist(), sizes.tolist()):
            place = place if conv == conversation else 0
            conversation = conv
            starts.append(place)
            place += size
        yield batch.set_column(batch.schema.get_field_index("start"), "start", pa.array(starts, pa.int64()))


def assemble(turns: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, ids, loss, start``: a row per turn, the turns of a conversation in order in one partition.

    ``turns`` needs ``conv_id, turn, role, text``; ``tokenizer`` is a byte-level vocabulary file (``.json``) that the driver can read, as
    only such a vocabulary gives texts back unchanged. ``loss`` marks the tokens of assistant contents, ``start`` is the number
    of the turn's first token in its conversation. Rows are encoded before they are sorted, and the sums run along the sorted
    rows, so a conversation of any length needs the memory of one batch.

    Null roles and texts are empty; a null ``conv_id`` is a conversation of its own, a null ``turn`` comes first. Turns with the
    same number go by role and text, repeated rows are kept. Other columns are ignored; no rows give no rows.
    """
    with open(tokenizer, "rb") as file:
        model = file.read()
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text"))
    coded = turns.mapInArrow(_assembled(model), ASSEMBLED)
    return coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids").mapInArrow(_placed, ASSEMBLED)


def _read(model: bytes, digests: bool):
    """Turns in order, back from ids to texts; per conversation or per turn."""
    def turns(batches):
        tokenizer = _tokenizer(model)
        turn_id, text_id, _ = (tokenizer.get_vocab_size() + k for k in range(len(MARKS)))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                rows, segments = [], []
                for ids, loss in zip(batch.column("ids"), batch.column("loss")):
                    ids, loss = ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
                    if ids[0] != turn_id:
                        raise ValueError("a turn does not begin with its mark")
                    split = int(np.flatnonzero(ids == text_id)[0])
                    segments += [ids[1:split], ids[split + 1:-1], ids[loss]]
                texts = tokenizer.decode_batch([s.tolist() for s in segments], skip_special_tokens=False)
                for k, (conv, turn) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist())):
                    rows.append((conv, turn, *texts[3 * k:3 * k + 3]))
                yield rows

    def by_turn(batches):
        for rows in turns(batches):
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                   pa.array([unescape(r[2]) for r in rows]), pa.array([unescape(r[3]) for r in rows]),
                                   pa.array([unescape(r[4]) for r in rows]),
                                   pa.array([MARKS[0] + r[2] + MARKS[1] + r[3] + MARKS[2] for r in rows])],
                                  names=["conv_id", "turn", "role", "text", "loss_text", "formatted"])

    def by_conversation(batches):
        state, done = None, []

        def flush():
            if state:
                done.append((state["id"], state["n"], state["all"].hexdigest(), state["loss"], state["loss_hash"].hexdigest(), state["chars"]))

        def ready():
            columns = list(zip(*done)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for rows in turns(batches):
            for conv, _, role, text, loss in rows:
                if state is None or state["id"] != conv:
                    flush()
                    state = {"id": conv, "n": 0, "all": hashlib.sha256(), "loss": 0, "loss_hash": hashlib.sha256(), "chars": 0}
                state["n"] += 1
                state["chars"] += sum(map(len, MARKS)) + len(role) + len(text)
                state["all"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                loss = unescape(loss)
                state["loss"] += len(loss)
                state["loss_hash"].update(loss.encode())
            yield ready()
            done.clear()
        flush()
        yield ready()

    return by_conversation if digests else by_turn


def read_turns(assembled: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id, turn, role, text, loss_text, formatted`` of each turn, from the ids and the mask alone."""
    with open(tokenizer, "rb") as file:
        model = file.read()
    return assembled.mapInArrow(_read(model, False), "conv_id long, turn long, role string, text string, loss_text string, formatted string")


def conversation_digests(assembled: DataFrame, tokenizer: str) -> DataFrame:
    """One row per conversation of ``assemble``'s result, read back from ids and mask: turns, hashes of all and of the loss, sizes.

    Hashes run along the sorted turns, so memory does not grow with a conversation.
    """
    with open(tokenizer, "rb") as file:
        model = file.read()
    return assembled.mapInArrow(_read(model, True), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def extra_turns(spark, conv_id: int, texts: list[tuple[str, str]]) -> DataFrame:
    """A conversation from (role, text) pairs, in the columns of ``assemble``."""
    return spark.createDataFrame([(conv_id, k, role, text) for k, (role, text) in enumerate(texts)], "conv_id long, turn long, role string, text string")
