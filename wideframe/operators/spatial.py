"""Which polygons hold at least one point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.functions.geometry import bbox, edges, touches
from wideframe.operators.ranks import broadcast_if_small
from wideframe.session import stage

CELLS_PER_SIDE = 4
POINTS_PER_CELL = 1_000
POLYGONS_PER_KEY = 10_000
POLYGONS_PER_TASK = 5_000
MAX_SPLITS = 20


def _cell(coordinate: Column, origin: float, side: Column | float) -> Column:
    return F.floor((coordinate - F.lit(origin)) / side).cast("long")


def polygons_with_points(polys: DataFrame, points: DataFrame, id_col: str, rings_col: str = "rings",
                         points_per_cell: int = POINTS_PER_CELL, polygons_per_key: int = POLYGONS_PER_KEY) -> DataFrame:
    """Polygons that contain or touch a point (``x``, ``y``), holes left out.

    Both sides meet in grid cells. The first grid is as coarse as the largest polygon, which bounds
    the cells per polygon; a cell with more than ``points_per_cell`` distinct points is split in four
    until it is not, and only the part of each polygon in that cell follows. A cell with more than
    ``polygons_per_key`` polygons deals them over several keys, each with a copy of the cell's points, which
    are few by then. So neither a dense spot nor a large polygon nor a heap of polygons makes one key hot, and
    no point is compared outside its cell.
    """
    box = bbox(F.col(rings_col))
    # Each polygon may meet points_per_cell points in each of its cells, so few bytes are much work: every task gets a share of the polygons.
    tasks = max(polys.sparkSession.sparkContext.defaultParallelism, math.ceil(polys.count() / POLYGONS_PER_TASK))
    dealt = polys.select(id_col, rings_col).repartition(tasks)
    shaped = dealt.select(F.col(id_col).alias("__id"), edges(F.col(rings_col)).alias("edges"),
                          *[c.alias(n) for n, c in box.items()]).filter(F.col("xmin").isNotNull())
    span = shaped.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))),
                      F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    if span[0] is None:
        return polys.limit(0)
    side, x0, y0 = max(span[0] / CELLS_PER_SIDE, 1e-9), span[1], span[2]

    spots = (points.filter(F.col("x").between(x0, span[3]) & F.col("y").between(y0, span[4]))
             .select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    placed = spots.select("*", F.lit(0).alias("level"), _cell(F.col("x"), x0, side).alias("cx"),
                          _cell(F.col("y"), y0, side).alias("cy"))
    covered = _cover(shaped, side, x0, y0, None)

    settled_points, settled_polys = [], []
    for level in range(MAX_SPLITS):
        dense = placed.groupBy("cx", "cy").count().filter(F.col("count") > points_per_cell).select("cx", "cy")
        if dense.isEmpty():
            break
        dense = stage(dense, "dense-cells")
        settled_points.append(placed.join(dense, ["cx", "cy"], "left_anti"))
        settled_polys.append(covered)
        finer = side / 2 ** (level + 1)
        placed = stage(
            placed.join(dense, ["cx", "cy"], "left_semi").select(
                "x", "y", F.lit(level + 1).alias("level"), _cell(F.col("x"), x0, finer).alias("cx"),
                _cell(F.col("y"), y0, finer).alias("cy")), "split-points")
        covered = stage(_cover(covered.join(dense, ["cx", "cy"], "left_semi"), finer, x0, y0, level + 1),
                        "split-polygons")
    settled_points.append(placed)
    settled_polys.append(covered)

    found = None
    for cells, spots_in in zip(settled_polys, settled_points):
        cells, spots_in = _dealt(cells, spots_in, polygons_per_key)
        here = (F.col("cx") == F.col("px")) & (F.col("cy") == F.col("py")) & (F.col("deal") == F.col("p_deal"))
        held = (F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
                & touches(F.col("edges"), F.col("x"), F.col("y")))
        keyed = spots_in.select("x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("deal").alias("p_deal"))
        hits = cells.join(keyed, here & held, "left_semi").select("__id")
        found = hits if found is None else found.unionByName(hits)
    return polys.join(found.withColumnRenamed("__id", id_col).distinct(), id_col, "left_semi")


def _dealt(cells: DataFrame, spots: DataFrame, polygons_per_key: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``deal``: the share of a heavy cell's polygons that a row belongs to, 0 in other cells.

    A polygon goes to one share by hash, a point to all shares of its cell. The heavy cells are staged, so that where they are
    too many to broadcast, adaptive execution can split the cell that is heavy in the join itself.
    """
    heavy = stage(cells.groupBy("cx", "cy").count().filter(F.col("count") > polygons_per_key)
                  .select("cx", "cy", F.ceil(F.col("count") / polygons_per_key).cast("int").alias("deals")), "heavy-cells")
    n = heavy.count()
    if not n:
        return cells.withColumn("deal", F.lit(0)), spots.withColumn("deal", F.lit(0))
    heavy, deals = broadcast_if_small(heavy, n), F.coalesce("deals", F.lit(1))
    share = F.pmod(F.xxhash64("__id", "edges"), deals).cast("int")
    return (cells.join(heavy, ["cx", "cy"], "left").withColumn("deal", share).drop("deals"),
            spots.join(heavy, ["cx", "cy"], "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals"))


def _cover(shapes: DataFrame, side: float, x0: float, y0: float, level: int | None) -> DataFrame:
    """One row per polygon and grid cell that its bounding box reaches.

    On a finer level only the quarters of the row's own cell are taken.
    """
    def reach(low: str, high: str, origin: float, parent: str) -> Column:
        start, end = _cell(F.col(low), origin, side), _cell(F.col(high), origin, side)
        if level is not None:
            start, end = F.greatest(start, F.col(parent) * 2), F.least(end, F.col(parent) * 2 + 1)
        return F.sequence(start, F.greatest(start, end))

    xs = reach("xmin", "xmax", x0, "cx")
    ys = reach("ymin", "ymax", y0, "cy")
    cells = F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    return shapes.select("__id", "edges", "xmin", "ymin", "xmax", "ymax", F.inline(cells))
