"""Token counts through a cache of digests: only texts that no earlier run has counted are encoded, each once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage

LIMIT = 4096
#: Texts that go to the tokenizer's library in one call.
BATCH = 64
#: Digests that may be broadcast (about 150 bytes each in memory, 45 MB); more are joined by a shuffle.
BROADCAST_DIGESTS = 300_000

_SCHEMA = "content binary, tokenizer string, n_tokens long"


def encoder(kind: str, model: bytes) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts, special strings in them as ordinary text where the library leaves that open by default.

    ``model`` is a piece model, ``json`` a tokenizer description; neither adds begin, end or other special tokens.
    """
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)
    if kind == "json":
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for a tokenizer file of kind {kind!r}")


def _encoded(kind: str, model: bytes, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(kind, model)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                counts = [len(ids) for ids in encode(part.column("text").to_pylist())]
                yield pa.record_batch([part.column("content"), pa.array([version] * part.num_rows), pa.array(counts, pa.int64())],
                                      names=["content", "tokenizer", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, a row for each row of ``docs``, which needs ``doc_id`` and ``text``.

    ``tokenizer`` is the path of a vocabulary file that the driver can read (``.model`` or ``.json``), ``cache`` a folder that all
    executors share; it is made if absent. The cache holds the SHA-256 of a text, that of the vocabulary file, and the count, so
    another file's counts are never taken. Texts count as equal if their UTF-8 bytes are; a null text counts as an empty one
    (no other normalising: white space and letter case change counts). What is missing is encoded once per text and appended. If
    two runs append the same text, both counts are the same and one is taken.

    Empty texts have no tokens. Repeated rows are counted by one encoding and all returned. Very long texts are encoded whole.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as file:
        model = file.read()
    kind, version = tokenizer.rsplit(".", 1)[-1], hashlib.sha256(model).hexdigest()
    spark.createDataFrame([], _SCHEMA).write.mode("ignore").parquet(cache)

    def counted() -> DataFrame:
        return (spark.read.schema(_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
                .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    missing = stage(texts.select("content").distinct().join(counted(), "content", "left_anti"), "missing")
    number = missing.count()
    if number:
        # The partial aggregation keeps one text of each kind per task before anything is shuffled, whichever way the join goes.
        once = texts.select("content", "text")
        if number <= BROADCAST_DIGESTS:
            once = once.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
        else:
            once = once.groupBy("content").agg(F.first("text").alias("text")).join(missing, "content", "left_semi")
        once.mapInArrow(_encoded(kind, model, version), _SCHEMA).write.mode("append").parquet(cache)
    # Staged, so that the join has an exchange of its own on either side and rows of one frequent text can be split.
    counts = stage(counted(), "counts")
    return (texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content").join(counts, "content")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
