"""One query for each operator of this subpackage, with its production parameters, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import staged_path
from .chat import assemble, conversation_digests, extra_turns
from .decontaminate import contamination
from .lexical import lexical_search
from .mixing import mixed
from .near_duplicates import near_duplicates
from .packing import pack
from .quality import quality
from .repeats import repeated_passages
from .search import quantised, top_products
from .secrets import secret_digests
from .token_counts import token_counts
from .toxicity import toxicity
from .trie import coded_turns, prefix_trie, with_borrowed_heads


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", quantised().alias("vector"))
    return top_products(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = _vocabulary("byte_bpe_50k.json")
    said = r"\### Assistant: </turn> ok"
    more = extra_turns(spark, -7, [("user", said), ("assistant", said)])
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return conversation_digests(assemble(turns, vocabulary), vocabulary)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), digest_only=True).withColumnRenamed("kept_text", "kept_sha256")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each run, so that the query always does all of its work.
    return token_counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), staged_path(spark, "token-cache"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_borrowed_heads(coded_turns(_table(spark, sf_dir, "conversations"))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pieces and attention cost are bounded by what the tokens imply, so that sequences are as few as they can be.
    packed = pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_top_products": op2_top_products,
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixture": op5_mixture,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_packing": op13_packing,
}
