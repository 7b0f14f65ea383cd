import numpy as np
import pytest
from pyspark.sql import functions as F

from wideframe.functions import geometry
from wideframe.operators import spatial

RINGS = "id int, rings array<array<struct<x: double, y: double>>>"


def _inside(rings, px, py):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1, y1) == (x2, y2):
                continue
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("limit,heap", [(1000, 10_000), (4, 10_000), (1000, 3), (4, 1)])
@pytest.mark.parametrize("shuffled", [False, True])
def test_against_brute_force_with_a_dense_spot(spark, monkeypatch, limit, heap, shuffled):
    if shuffled:
        monkeypatch.setattr("wideframe.operators.ranks.BROADCAST_ROWS", -1)
    rng = np.random.default_rng(8)
    polys = []
    for i in range(120):
        x, y = rng.uniform(0, 10, 2)
        w, h = rng.uniform(0.02, 4.0 if i % 40 == 0 else 0.3, 2)
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
        hole = [(x + w / 4, y + h / 4), (x + w / 2, y + h / 4), (x + w / 2, y + h / 2)]
        polys.append((i, [ring, hole] if i % 3 == 0 else [ring[:3]] if i % 3 == 1 else [ring]))
    pts = np.vstack([rng.uniform(0, 10, (150, 2)), rng.normal(5, 0.01, (150, 2)), [[5.0, 5.0]] * 200])
    df = spark.createDataFrame([(i, [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]) for i, rings in polys], RINGS)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    got = {r["id"] for r in spatial.polygons_with_points(df, points, "id", points_per_cell=limit, polygons_per_key=heap).collect()}
    assert got == {i for i, rings in polys if any(_inside(rings, a, b) for a, b in pts)}
    assert 0 < len(got) < 120


def test_edges_touch_and_holes_do_not(spark):
    square = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]
    df = spark.createDataFrame([(1, [[{"x": float(a), "y": float(b)} for a, b in r] for r in square])], RINGS)
    def touch(x, y):
        return df.select(geometry.touches(geometry.edges(F.col("rings")), F.lit(x), F.lit(y))).first()[0]
    assert touch(0.5, 0.5) and touch(4.0, 2.0) and touch(2.0, 1.0) and touch(0.0, 0.0)
    assert not touch(2.0, 2.0) and not touch(4.1, 2.0)


def test_area_and_centroid_do_not_depend_on_direction(spark):
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(2, 2), (4, 2), (4, 4), (2, 4)]
    for rings in ([outer, hole], [outer[::-1], hole], [outer, hole[::-1]]):
        df = spark.createDataFrame([(1, [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings])], RINGS)
        x, y = geometry.centroid(F.col("rings"))
        row = df.select(geometry.area(F.col("rings")), x, y).first()
        assert tuple(row) == pytest.approx((12.0, 5 / 3, 5 / 3))


def test_parts_holes_and_islands_in_any_order(spark):
    def square(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]

    rings = [square(3, 3, 2), square(0, 0, 8), square(20, 0, 8), square(2, 2, 4), square(20, 0, 1)]  # island, part, part, hole, hole at a corner
    df = spark.createDataFrame([(1, [[{"x": float(a), "y": float(b)} for a, b in r] for r in rings])], RINGS)
    assert df.select(geometry.area(F.col("rings"))).first()[0] == pytest.approx(4 + 64 + 64 - 16 - 1)
    assert df.select(*[c.alias(n) for n, c in geometry.bbox(F.col("rings")).items()]).first().asDict() == {"xmin": 0, "ymin": 0, "xmax": 28, "ymax": 8}
    for x, y, inside in ((4, 4, True), (2.5, 2.5, False), (25, 5, True), (20.5, 0.5, False), (12, 4, False)):
        points = spark.createDataFrame([(float(x), float(y))], "x double, y double")
        assert (spatial.polygons_with_points(df, points, "id").count() == 1) == inside


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]])], RINGS)
    points = spark.createDataFrame([(0.9, 0.5)], "x double, y double")
    assert spatial.polygons_with_points(df, points, "id").count() == 1
    assert spatial.polygons_with_points(df, points.limit(0), "id").count() == 0
    assert spatial.polygons_with_points(df.limit(0), points, "id").count() == 0


def test_a_heap_of_polygons_over_one_point_is_dealt(spark):
    """100,000 triangles in one cell with one point: no key gets more than a fair share of them, and each is judged."""
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    size = F.lit(0.5) + F.col("id") % 2
    df = spark.range(100_000).select("id", F.array(F.array(corner(0, 0), F.struct(size.alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(0.0).alias("x"), size.alias("y")))).alias("rings"))
    points = spark.createDataFrame([(0.3, 0.3)], "x double, y double")
    got = spatial.polygons_with_points(df, points, "id").agg(F.count("*"), F.min(F.col("id") % 2)).first()
    assert tuple(got) == (50_000, 1)
    cells = df.select(F.col("id").alias("__id"), geometry.edges(F.col("rings")).alias("edges"), F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    shares, copies = spatial._dealt(cells, points.withColumn("cx", F.lit(0)).withColumn("cy", F.lit(0)), spatial.POLYGONS_PER_KEY)
    counts = [r["count"] for r in shares.groupBy("deal").count().collect()]
    assert len(counts) == 10 == copies.count() and sum(counts) == 100_000 and max(counts) < 1.1 * min(counts)


def test_polygons_of_one_file_are_dealt_over_all_tasks(spark, monkeypatch):
    """The work is polygons times points, so polygons that come in one partition do not stay in one."""
    seen = []
    cover = spatial._cover
    monkeypatch.setattr(spatial, "_cover", lambda shapes, *a: seen.append(shapes.rdd.getNumPartitions()) or cover(shapes, *a))
    squares = spark.range(400).coalesce(1).selectExpr("id", "id % 20 AS x", "id DIV 20 AS y").selectExpr(
        "id", "array(array(named_struct('x', x + 0D, 'y', y + 0D), named_struct('x', x + 0.5D, 'y', y + 0D), named_struct('x', x + 0.5D, 'y', y + 0.5D)))  AS rings")
    points = spark.range(10).selectExpr("id + 0.4D AS x", "0.1D AS y")
    assert sorted(r["id"] for r in spatial.polygons_with_points(squares, points, "id").collect()) == list(range(10))
    assert seen[0] >= spark.sparkContext.defaultParallelism
