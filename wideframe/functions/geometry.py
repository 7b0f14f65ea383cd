"""Polygons as arrays of rings and their tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<X: double, Y: double>"
SHAPE_DDL = f"Xmin double, Ymin double, Rings struct<Ring: array<struct<Points: struct<Point: array<{POINT}>>>>>"


def xml_double(xml: Column, path: str) -> Column:
    """Number at an XPath of an XML text."""
    return F.xpath_double(xml, F.lit(path))


def parse_shapes(df: DataFrame, xml_col: str, schema: str = SHAPE_DDL) -> DataFrame:
    """Add ``rings`` (array of arrays of ``x, y``): outlines of one or more parts and holes, in any order."""
    shape = F.from_xml(F.col(xml_col), schema)
    rings = F.transform(shape["Rings"]["Ring"], lambda r: F.transform(
        r["Points"]["Point"], lambda p: F.struct(p["X"].alias("x"), p["Y"].alias("y"))))
    return df.withColumn("rings", rings)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring; the last point is joined to the first unless they are the same point."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(
        ring[i]["x"].alias("x1"), ring[i]["y"].alias("y1"),
        ring[(i + 1) % F.size(ring)]["x"].alias("x2"), ring[(i + 1) % F.size(ring)]["y"].alias("y2")))


def edges(rings: Column) -> Column:
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), ring_edges))


def _turn(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    return ((_turn(e, x, y) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))


def _winding(e: Column, x: Column, y: Column) -> Column:
    """1 where the ray to the right of the point crosses the edge; decided by the turn, without a division."""
    up = (e["y1"] <= y) & (y < e["y2"]) & (_turn(e, x, y) > 0)
    down = (e["y2"] <= y) & (y < e["y1"]) & (_turn(e, x, y) < 0)
    return (up | down).cast("int")


def touches(polygon_edges: Column, x: Column, y: Column) -> Column:
    """Point inside the polygon (not in a hole) or on any of its edges."""
    crossings = F.aggregate(polygon_edges, F.lit(0), lambda n, e: n + _winding(e, x, y))
    return (crossings % 2 == 1) | F.exists(polygon_edges, lambda e: _on_edge(e, x, y))


def _ring_sums(ring: Column) -> Column:
    """Twice the signed area and six times the first moments of a ring."""
    def add(total: Column, e: Column) -> Column:
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((total["a"] + cross).alias("a"), (total["mx"] + (e["x1"] + e["x2"]) * cross).alias("mx"),
                        (total["my"] + (e["y1"] + e["y2"]) * cross).alias("my"))

    zero = F.lit(0.0)
    return F.aggregate(ring_edges(ring), F.struct(zero.alias("a"), zero.alias("mx"), zero.alias("my")), add)


def _lies_in(ring: Column, other: Column) -> Column:
    """Whether a corner of ``ring`` is inside ``other`` and not on its edges; rings do not cross."""
    around = ring_edges(other)
    return F.exists(ring, lambda p: ~F.exists(around, lambda e: _on_edge(e, p["x"], p["y"])) & (
        F.aggregate(around, F.lit(0), lambda n, e: n + _winding(e, p["x"], p["y"])) % 2 == 1))


def _depth_is_odd(rings: Column, i: Column, ring: Column) -> Column:
    """Whether the ring lies inside an odd number of the other rings."""
    return F.size(F.filter(rings, lambda other, j: (j != i) & _lies_in(ring, other))) % 2 == 1


def _signed_total(rings: Column, field: str) -> Column:
    """Parts minus holes, whatever direction and order the rings have: a ring inside an odd number of others is a hole."""
    filled = F.filter(rings, lambda r: F.size(r) > 0)
    sums = F.transform(filled, lambda r, i: F.struct(_ring_sums(r).alias("s"), _depth_is_odd(filled, i, r).alias("hole")))
    signed = F.transform(sums, lambda s: s["s"][field] * F.signum(s["s"]["a"]) * F.when(s["hole"], F.lit(-1.0)).otherwise(1.0))
    return F.aggregate(signed, F.lit(0.0), lambda t, v: t + v)


def area(rings: Column) -> Column:
    return _signed_total(rings, "a") / 2


def centroid(rings: Column) -> tuple[Column, Column]:
    whole = _signed_total(rings, "a") * 3
    return F.try_divide(_signed_total(rings, "mx"), whole), F.try_divide(_signed_total(rings, "my"), whole)


def bbox(rings: Column) -> dict[str, Column]:
    """The box around all parts."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}
