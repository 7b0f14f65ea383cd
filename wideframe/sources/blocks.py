"""Sparse matrices in blocks with row pointers, the exchange form of boosters and linear solvers, with global feature and row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.operators.ranks import broadcast_if_small, null_safe_join, running_totals
from wideframe.session import stage
from wideframe.sources.tables import write_table

#: Cells of a block, about 12 bytes each; a block has at most those of one row more.
CELLS_PER_BLOCK = 1_000_000


@dataclass
class SparseBlocks:
    """``blocks``: ``block, first_row, pointers, indices, values``; ``features``: ``feature, index``; ``rows``: ``row`` and the row ids.

    Row ``first_row + i`` of the matrix has the cells from ``pointers[i]`` up to ``pointers[i + 1]`` of ``indices`` and ``values``, by index.
    """

    blocks: DataFrame
    features: DataFrame
    rows: DataFrame

    def write(self, path: str) -> None:
        """One folder with a table each; the blocks in as many files as Spark has tasks for them."""
        for name in ("blocks", "features", "rows"):
            write_table(getattr(self, name), f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SparseBlocks:
        return SparseBlocks(*[spark.read.parquet(f"{path}/{name}") for name in ("blocks", "features", "rows")])

    def triples(self) -> DataFrame:
        """``(row id, feature, value)`` of all cells, as ``to_sparse_long`` gives them."""
        keys = [c for c in self.rows.columns if c != "row"]
        row = F.transform(F.sequence(F.lit(0), F.size("pointers") - 2), lambda i: F.struct(
            (F.col("first_row") + i).alias("row"), F.get("pointers", i).alias("start"), F.get("pointers", i + 1).alias("end")))
        cell = F.arrays_zip(F.expr("slice(indices, span.start + 1, span.end - span.start)").alias("i"), F.expr("slice(values, span.start + 1, span.end - span.start)").alias("v"))
        cells = (self.blocks.filter("size(pointers) > 1").select("indices", "values", F.explode(row).alias("span"))
                 .select("span.row", F.explode(cell).alias("c")).select("row", F.col("c.i").alias("index"), F.col("c.v").alias("value")))
        return cells.join(self.rows, "row").join(broadcast_features(self.features), "index").select(*keys, "feature", "value")


def broadcast_features(features: DataFrame) -> DataFrame:
    size = features.agg(F.count("*").alias("n"), F.sum(F.octet_length("feature") + 40).alias("bytes")).first()
    return broadcast_if_small(features, size["n"], size["bytes"])


def number_features(cells: DataFrame) -> DataFrame:
    """``feature, index``: distinct names in binary order, from 0, through range slices."""
    placed = running_totals(cells.select("feature").filter("feature is not null").distinct(), [], ["feature"], out="index")
    return stage(placed.select("feature", F.col("index").cast("int").alias("index")), "feature-numbers")


def sparse_blocks(cells: DataFrame, rows: DataFrame, row_id: Sequence[str] | str, features: DataFrame | None = None,
                  cells_per_block: int = CELLS_PER_BLOCK) -> SparseBlocks:
    """Cells ``(row id, feature, value)`` of the rows whose ids ``rows`` has, as blocks of about ``cells_per_block`` cells.

    Rows are numbered without gaps in the order of their ids, also those without cells; blocks follow that order and are cut by the number of
    cells before a row, so a few full rows do not make a block large. Cells that repeat a row and feature are added up; zeros, nulls and cells of other rows are
    left out. ``features`` numbers the columns as another table did (see ``number_features``) and leaves out features that it lacks. A null id is an id.
    No rows give no blocks. A row's cells, at most as many as there are features, meet in one task; no block and no row table reaches the driver.
    """
    keys = [row_id] if isinstance(row_id, str) else list(row_id)
    ids = [F.col(f"`{c}`") for c in keys]
    features = number_features(cells) if features is None else features
    kept = cells.filter("feature is not null and value <> 0").join(broadcast_features(features), "feature").select(*ids, "index", F.col("value").cast("double").alias("value"))
    summed = kept.repartition(*ids).groupBy(*ids, "index").agg(F.sum("value").alias("value")).filter("value <> 0")
    entries = summed.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("entries"))
    whole = null_safe_join(rows.select(*ids).distinct(), entries, keys, "left")
    whole = whole.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<index:int,value:double>>")))
    whole = running_totals(whole, [], keys, out="row")
    whole = stage(whole.withColumn("n", F.size("entries").cast("long")), "matrix-rows")
    placed = running_totals(whole.select("row", "n"), [], ["row"], "n", "before")
    block = F.floor(F.col("before") / F.lit(cells_per_block))
    placed = stage(placed.select("row", F.col("before"), block.cast("long").alias("block")), "matrix-places")
    rows_of = F.array_sort(F.collect_list(F.struct("row", "before", "entries")))
    made = whole.join(placed, "row").groupBy("block").agg(rows_of.alias("r"))
    first = F.col("r")[0]
    start = F.transform("r", lambda r: (r["before"] - first["before"]).cast("int"))
    end = F.size(F.flatten(F.col("r.entries")))
    blocks = made.select("block", first["row"].alias("first_row"), F.concat(start, F.array(end)).alias("pointers"),
                         F.flatten(F.transform("r", lambda r: r["entries"]["index"])).alias("indices"),
                         F.flatten(F.transform("r", lambda r: r["entries"]["value"])).alias("values"))
    return SparseBlocks(blocks, features, whole.select("row", *ids))
