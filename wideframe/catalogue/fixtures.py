"""Wide views over the given tables, in the shapes the operators are made for.

Every view is a plan over whole tables. Pivots are conditional aggregates with a fixed column list:
one map-side combined shuffle on the row key, and no scan to find the pivot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.session import spread

SLOTS = range(1, 8)
WEEKS = range(14, 40)
ALL_WEEKS = range(10, 44)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """The line items, spread over the cores where the table is a single split."""
    return spread(table(spark, sf, "lineitem"))


def _date_text(ship: Column, slot: int) -> Column:
    """A date as text; some orders hold digits, words, empty text or another date spelling instead."""
    kind = (F.col("o_orderkey") + slot) % 7
    return (F.when(ship.isNull(), F.lit(None)).when(kind == 1, F.year(ship).cast("string")).when(kind == 2, "fall")
            .when(kind == 3, "").when(kind == 4, F.date_format(ship, "M/d/yyyy"))
            .otherwise(F.date_format(ship, "yyyy-MM-dd")))


def orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with ``rate``, ``prod`` and ``date`` per line number; a missing line is null.

    The flag is one letter; its smallest code is a number, which keeps the aggregation hashed where
    a minimum of strings would sort.
    """
    def at(slot: int, value: str) -> Column:
        return F.when(F.col("l_linenumber") == slot, F.col(value))

    lines = line_items(spark, sf).groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        *[F.sum(at(i, "l_quantity")).alias(f"rate{i}") for i in SLOTS],
        *[F.char(F.min(F.when(F.col("l_linenumber") == i, F.ascii("l_returnflag")))).alias(f"prod{i}") for i in SLOTS],
        *[F.min(at(i, "l_shipdate")).alias(f"ship{i}") for i in SLOTS])
    joined = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        *[f"rate{i}" for i in SLOTS], *[f"prod{i}" for i in SLOTS],
        *[_date_text(F.col(f"ship{i}"), i).alias(f"date{i}") for i in SLOTS])


def unit_year_wide(spark: SparkSession, sf: str, weeks: range = WEEKS) -> DataFrame:
    """Weekly quantity and price of a customer's year in mixed-case columns, with the day of the
    year of the first order as anchor (null in a year without an order)."""
    orders = table(spark, sf, "orders")
    lines = line_items(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("unit"), F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice",
        F.floor((F.dayofyear("l_shipdate") - 1) / 7).alias("week"))
    weekly = lines.groupBy("unit", "year").agg(
        *[F.sum(F.when(F.col("week") == w, F.col("l_quantity"))).alias(f"wk{w}a") for w in weeks],
        *[F.sum(F.when(F.col("week") == w, F.col("l_extendedprice"))).alias(f"WK{w}b") for w in weeks])
    anchors = orders.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year")).agg(
        F.min(F.dayofyear("o_orderdate")).alias("day"))
    return weekly.join(anchors, ["unit", "year"], "left")


def season_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their slots and their customer's weekly series of that year."""
    orders = orders_wide(spark, sf).select(
        "*", F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("unit"),
        (F.col("o_totalprice") / 10).alias("handling_Cost"), F.col("o_totalprice").alias("total$"))
    return orders.drop("o_orderdate").join(unit_year_wide(spark, sf), ["unit", "year"], "left").drop("unit")


def holdout_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The hold-out list: the customers of one market segment."""
    return table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Stands for a model's output: label and prediction per line, with unit and fold."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("fold"), "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("pred"))


LEARN_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]


def learn(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their part and a label made from quantity and size, plus noise from the keys."""
    noise = (F.col("l_partkey") * 7919 + F.col("l_linenumber") * 104729) % 20 - 10
    label = 120 - 0.05 * F.pow(F.col("l_quantity") - 30, F.lit(2)) + 0.8 * F.col("p_size") + noise
    return (line_items(spark, sf).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(*LEARN_KEY, "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_size", "p_retailprice",
                    "p_brand", label.alias("y")))


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """One small polygon per supplier as XML: rectangles, triangles, and rectangles with a hole."""
    k = F.col("s_suppkey")
    x, y = (k * 37) % 401 - 200, (k * 53) % 401 - 200
    w, h = 8 + k % 40, 8 + (k * 7) % 60

    def number(milli: Column) -> Column:
        return (milli / F.lit(1000.0)).cast("string")

    def ring(*corners: tuple[Column, Column]) -> Column:
        points = [F.concat(F.lit("<Point><X>"), number(a), F.lit("</X><Y>"), number(b), F.lit("</Y></Point>"))
                  for a, b in corners]
        return F.concat(F.lit("<Ring><Points>"), *points, F.lit("</Points></Ring>"))

    def quarter(v: Column) -> Column:
        return F.floor(v / 4)

    box = ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    hole = ring((x + quarter(w), y + quarter(h)), (x + 2 * quarter(w), y + quarter(h)),
                (x + 2 * quarter(w), y + 2 * quarter(h)), (x + quarter(w), y + 2 * quarter(h)))
    triangle = ring((x, y), (x + w, y), (x, y + h))
    rings = F.when(k % 5 == 0, F.concat(box, hole)).when(k % 5 <= 2, box).otherwise(triangle)
    xml = F.concat(F.lit("<Shape><Xmin>"), number(x), F.lit("</Xmin><Ymin>"), number(y), F.lit("</Ymin><Rings>"),
                   rings, F.lit("</Rings></Shape>"))
    return table(spark, sf, "supplier").select(k.alias("shape_id"), "s_acctbal", xml.alias("xml"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"))


def fold_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Split-count-like weights per fold and dummy feature: how many lines have the label."""
    lines = table(spark, sf, "lineitem")
    names = [F.concat(F.lit(f"{c}__DUMMY__"), F.col(c)) for c in ("l_returnflag", "l_linestatus")]
    names.append(F.when(F.col("l_quantity") > 25, F.lit("l_quantity")))
    names.append(F.when((F.col("l_discount") > 0.05) & (F.col("l_linenumber") <= 4), F.lit("l_discount")))
    return (lines.select(F.col("l_linenumber").alias("fold"), F.explode(F.array(*names)).alias("feature"))
            .filter("feature is not null").groupBy("fold", "feature").agg(F.count("*").alias("weight")))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """A score per (run, epoch): mean price per supplier and line number."""
    return (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), (F.col("l_linenumber") - 1).alias("epoch"))
            .agg(F.avg("l_extendedprice").alias("score")))
