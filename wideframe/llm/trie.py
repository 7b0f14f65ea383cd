"""The prefix trie of conversations: ternary search trees over turn numbers, one per range of paths, merged where ranges meet.

Every distinct turn gets a number, a conversation is its path of numbers. Distinct paths are cut into ranges in their order; a range's tree
knows all of the nodes below it but those on its first and its last path, which other ranges may share. Only these are merged.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Paths in one range, and the most ranges; what is merged is at most two paths of each.
PATHS, RANGES = 20_000, 4096
#: Ids of conversations in one slice of the list of those that share a path.
SLICE = 1024
#: Rows of merged nodes that may be broadcast (about 200 bytes each in memory, 20 MB); more are joined by a shuffle.
BROADCAST_NODES = 100_000

_PATHS = "ids array<long>, words array<int>, n long, conv_id long, ends string"
_NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
          "words long, key binary, parent_key binary")
_NOTHING = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """A ternary search tree over sorted distinct paths, whose nodes stand for the prefixes of the paths.

    ``low`` and ``high`` lead to siblings with smaller and larger numbers, ``down`` to the first node of the next turn. Each set of
    siblings is built from its median path, then those of the halves beside it, so that paths are balanced on both sides. Node 0 is the empty prefix;
    ``begin`` and ``end`` bound a node's paths, ``ending`` is the path that ends in it, or -1.
    """

    def __init__(self, paths: Sequence[Sequence[int]]):
        self.turn, self.low, self.high, self.down, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]
        self.begin, self.end, self.ending = [0], [len(paths)], [-1]
        open_ = [(0, len(paths), 0, 0, self.down, 0)]
        while open_:
            begin, end, depth, parent, link, at = open_.pop()
            if link is self.down and begin < end and len(paths[begin]) == depth:
                self.ending[parent] = begin
                begin += 1
            if begin >= end:
                continue
            turn = paths[(begin + end) // 2][depth]
            first = bisect_left(paths, turn, begin, end, key=lambda p: p[depth])
            last = bisect_right(paths, turn, first, end, key=lambda p: p[depth])
            node = len(self.turn)
            link[at] = node
            for field, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, depth + 1),
                                 (self.begin, first), (self.end, last), (self.ending, -1)):
                field.append(value)
            open_ += [(begin, first, depth, parent, self.low, node), (last, end, depth, parent, self.high, node), (first, last, depth + 1, node, self.down, node)]

    def find(self, path: Sequence[int]) -> int:
        """The node of a prefix, or -1."""
        node = 0
        for turn in path:
            node = self.down[node]
            while node >= 0 and self.turn[node] != turn:
                node = self.low[node] if turn < self.turn[node] else self.high[node]
            if node < 0:
                break
        return node

    def order(self) -> list[int]:
        """Every node, before those below it."""
        out, open_ = [], [0]
        while open_:
            node = open_.pop()
            if node >= 0:
                out.append(node)
                open_ += (self.low[node], self.high[node], self.down[node])
        return out


def _key(above: bytes, turn: int) -> bytes:
    return hashlib.sha256(above + turn.to_bytes(8, "big", signed=True)).digest()


def _nodes(rows: list[dict]) -> Iterator[dict]:
    """The nodes of one range. Those that other ranges may share have a ``key``, and sums over the children that none shares."""
    paths = [r["ids"] for r in rows]
    tree = TernaryTree(paths)
    size = len(tree.turn)
    members, first, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    shared = [b == 0 or e == len(paths) for b, e in zip(tree.begin, tree.end)]
    order, key = tree.order(), {}
    for node in order:
        if shared[node]:
            key[node] = _key(key[tree.parent[node]], tree.turn[node]) if node else b""
    for node in reversed(order):
        if (at := tree.ending[node]) >= 0:
            members[node] += rows[at]["n"]
            first[node] = rows[at]["conv_id"] if first[node] is None else min(first[node], rows[at]["conv_id"])
        words = rows[tree.begin[node]]["words"][tree.depth[node] - 1] if node else 0
        if not shared[node]:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * words
        if node:
            up = tree.parent[node]
            members[up] += members[node]
            first[up] = first[node] if first[up] is None else min(first[up], first[node])
            if not shared[node]:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    for node in order:
        up, at = tree.parent[node], tree.ending[node]
        words = rows[tree.begin[node]]["words"][tree.depth[node] - 1] if node else 0
        yield {"depth": tree.depth[node], "conv_id": first[node], "parent_conv_id": first[up] if node and not shared[up] else None, "n_convs": members[node],
               "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node], "ends": rows[at]["ends"] if at >= 0 else None,
               "words": words, "key": key.get(node), "parent_key": key.get(up)}


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's paths, in their order, to its nodes."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    if not rows:
        return
    schema = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("words", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary())])
    part = []
    for node in _nodes(rows):
        part.append(node)
        if len(part) == 10_000:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Shared nodes of all ranges, one row each, with the sums over everything below them."""
    nodes: dict[bytes, dict] = {}
    for row in parts.to_dict("records"):
        row["key"], row["parent_key"] = bytes(row["key"]), None if row["parent_key"] is None else bytes(row["parent_key"])
        node = nodes.setdefault(row["key"], row)
        if node is not row:
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[name] += row[name]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            node["ends"] = row["ends"] if node["ends"] is None else node["ends"]
    for node in sorted(nodes.values(), key=lambda n: -n["depth"]):  # children first
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
        up = nodes.get(node["parent_key"])
        if up is not None:
            up["n_children"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved_tokens"] += node["saved_tokens"]
        node["parent_conv_id"] = None
    for node in nodes.values():
        if node["parent_key"] in nodes:
            node["parent_conv_id"] = nodes[node["parent_key"]]["conv_id"]
    out = pd.DataFrame(list(nodes.values()), columns=list(parts.columns))
    return out.astype({"parent_conv_id": "Int64"})


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the conversations of each path, in order, to one row per path; the hash runs along the slices."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    path, digest = None, None

    def closed():
        return {**path, "ends": digest.hexdigest()}

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if path is None or path["ids"] != row["ids"]:
                if path is not None:
                    done.append(closed())
                path, digest = {k: row[k] for k in ("ids", "words", "n", "conv_id")}, hashlib.sha256(row["listing"].encode())
            else:
                path["n"] += row["n"]
                digest.update(b"," + row["listing"].encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if path is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema)


def coded_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, id, words``: the turns of each conversation numbered from 0, with the number of the turn's role and text in a dictionary of all.

    ``turns`` needs ``conv_id, turn, role, text``. Turns go by ``turn``, null first, those with the same number by the SHA-256 of role and text.
    Null roles and texts are empty, rows without ``conv_id`` take no part, repeated rows are turns of their own.
    """
    empty = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(empty("role")).cast("string"), F.lit(":"), empty("role"), empty("text")), 256))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"),
                                                      F.regexp_count(empty("text"), F.lit(WORD)).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = stage(rows.withColumn("pos", F.row_number().over(order) - 1).drop("turn"), "turns")
    # Numbers are those of the written dictionary; they need not be dense, only the same for the same turn.
    numbers = stage(rows.groupBy("digest").agg(F.count("*").alias("n")).select("digest", F.monotonically_increasing_id().alias("id")), "dictionary")
    return stage(rows.join(numbers, "digest").select("conv_id", "pos", "id", "words"), "coded")


def with_borrowed_heads(coded: DataFrame, every: int = 20, below: int = 4) -> DataFrame:
    """``coded_turns`` with the first ``h`` turns of each conversation replaced by those of the conversation whose id is the next multiple of ``every`` towards 0.

    ``h`` is the CRC-32 of the decimal id modulo ``below``. Where that conversation is missing or shorter, there are fewer turns. A conversation
    left without turns stays, as a row whose other columns are null.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % below
    convs = coded.select("conv_id").distinct()
    heads = coded.filter(F.col("pos") < below).filter(F.col("conv_id") % every == 0).withColumnRenamed("conv_id", "head")
    asked = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    borrowed = asked.filter("h > 0").join(heads, "head").filter("pos < h").select("conv_id", "pos", "id", "words")
    none = [F.lit(None).cast(coded.schema[c].dataType).alias(c) for c in ("pos", "id", "words")]
    return coded.filter(F.col("pos") >= h).union(borrowed).union(convs.select("conv_id", *none))


def prefix_trie(coded: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row per distinct prefix of turns.

    ``coded`` has ``conv_id, pos, id, words`` (see ``coded_turns``); a row whose other columns are null only names a conversation. The columns are:
    the smallest conversation with the prefix, its length, the smallest one with the prefix before it (null for the empty one), the conversations
    with it, its continuations by one turn, the prefixes from it on that have none, the words saved from it on if each prefix were stored
    once, and the hash of the ids of those that are no longer, in order and joined by commas.

    Conversations that share a path are one path before anything is cut into ranges, so a path that a third of them share is one row. What
    one task holds is a range of paths; one path is held whole. No conversations give no rows. Extra columns are ignored.
    """
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words"))
    paths = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("p")).select("conv_id", F.col("p.id").alias("ids"), F.col("p.words").alias("words"))
    # At most SLICE ids in a group, as ids are distinct; so a path of very many conversations is many groups.
    paths = paths.groupBy("ids", F.floor(F.col("conv_id") / SLICE).alias("slice")).agg(F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("c"))
    listing = F.array_join(F.transform("c", lambda c: c.cast("string")), ",")
    slices = paths.select("ids", "words", "slice", F.size("c").cast("long").alias("n"), F.col("c")[0].alias("conv_id"), listing.alias("listing"))
    classes = stage(slices.repartition("ids").sortWithinPartitions("ids", "slice").mapInArrow(_classes, _PATHS), "paths")
    ranges = min(RANGES, max(1, math.ceil(classes.count() / PATHS)))
    nodes = stage(classes.repartitionByRange(ranges, "ids").sortWithinPartitions("ids").mapInArrow(_grown, _NODES), "nodes")
    # At most two paths of each of RANGES ranges meet here.
    merged = stage(nodes.filter("key is not null").groupBy(F.lit("all").alias("together")).applyInPandas(_merged, _NODES), "merged")
    inner = nodes.filter("key is null")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    above = F.broadcast(above) if above.count() <= BROADCAST_NODES else above
    under = inner.filter("parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256")]
    return inner.filter("parent_key is null").select(columns).union(under.select(columns)).union(merged.select(columns))
