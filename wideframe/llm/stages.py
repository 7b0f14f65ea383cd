"""The stages of the corpus pipeline: what each operator decides, put into effect on documents.

Documents have ``doc_id, text, lang, source, n_chars``; further columns are kept as they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage
from .decontaminate import contaminated
from .mixing import TREE, chosen, mixture_plan, placed, weighed
from .near_duplicates import near_duplicates
from .quality import accepted
from .secrets import BROADCAST_SPANS, found_secrets, redacted

written = stage
#: Ids that may be broadcast (about 50 bytes each in memory, 25 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id is among ``ids``; rows without an id stay."""
    ids = stage(ids.select("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network does not reject. It is fitted on labelled rows of these documents.

    Rows are judged one by one, so repeated rows share their fate; null and empty texts are scored as one empty chunk. Without labels all stay.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, one row for each id; rows without an id stay.

    Of rows that repeat an id the one with the smallest text that has words is kept, so that one document of a group stays and not one id;
    a null or blank text is kept only if no other has the id. Long texts are handled whole; an empty table stays empty.
    """
    dropped = near_duplicates(docs).filter("not kept").select("doc_id")
    repeated = stage(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    left = _without(docs, dropped)
    number = repeated.count()
    if not number:
        return left
    repeated = F.broadcast(repeated) if number <= BROADCAST_IDS else repeated
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = F.struct(blank.alias("blank"), F.col("text").alias("first"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    once = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(whole).alias("m")).select("m.row.*")
    return left.join(repeated, "doc_id", "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, neither with its own values nor with others.

    An id goes with all its rows if one of them has an item; rows without an id or text stay, and without items all do.
    """
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark, ``n_chars`` as it then is; other texts are left alone."""
    found = found_secrets(docs).select("content", F.concat("base", "linked").alias("spans")).filter("size(spans) > 0").distinct()
    found = stage(found, "secrets")
    spans = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    found = F.broadcast(found) if spans <= BROADCAST_SPANS else found
    found = found.withColumnsRenamed({"content": "_content", "spans": "_spans"})
    text = redacted(F.col("text"), F.col("_spans"))
    marked = F.col("_spans").isNotNull()
    out = docs.withColumn("_content", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).join(found, "_content", "left")
    out = out.withColumn("text", F.when(marked, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(marked, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, text, domain, lang, source, epoch``: documents as often as the mixture takes them."""
    names = {f"mix_{level}": level for level in TREE}
    rows = placed(docs).filter("doc_id is not null and text is not null").select("doc_id", "text", *names)
    # Documents without words have no weight and are in no plan row's count; the plan knows only leaves with words.
    rows = rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return chosen(rows, mixture_plan(weighed(docs))).withColumnsRenamed(names).select("doc_id", "text", *TREE, "epoch")
