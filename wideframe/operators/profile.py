"""Column profiles: null shares, label statistics, counts, histograms, rank correlation, fitted curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.operators.columns import quoted
from wideframe.operators.ranks import ROWS_PER_SLICE, average_ranks
from wideframe.session import stage


def null_shares(df: DataFrame) -> dict[str, float | None]:
    """Share of nulls per column, in one pass."""
    if not df.columns:
        return {}
    return df.agg(*[F.avg(quoted(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, null_share)``; all columns in one aggregation, then one row unpivoted."""
    shares = [F.avg(quoted(c).isNull().cast("double")).alias(c) for c in df.columns]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("null_share")) for c in df.columns])
    return df.agg(*shares).select(F.inline(rows))


def label_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean and population deviation."""
    value = quoted(col)
    return df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                               F.stddev_pop(value).alias("sd"))


def top_counts(df: DataFrame, col: str, n: int = 20, others: str = "others") -> DataFrame:
    """The ``n`` most frequent values (ties by value) and the number of all other rows.

    ``rest`` marks the row of all others, so a value that is called like it stays apart. The table is read
    once: the counts are staged, the top rows are a per-task top-n, and the rest is the total minus their sum.
    """
    counts = stage(df.filter(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("value")).count(), "counts")
    top = counts.orderBy(F.desc("count"), "value").limit(n).withColumn("rest", F.lit(False))
    total = counts.agg(F.sum("count")).first()[0] or 0
    named = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("named"))
    rest = named.select(F.lit(others).alias("value"), (F.lit(total) - F.col("named")).alias("count"), F.lit(True).alias("rest"))
    return top.unionByName(rest.filter("count > 0"))


def histogram(df: DataFrame, col: str, bins: int, nulls: str = "exclude") -> DataFrame:
    """Equal-width bins between minimum and maximum; ``nulls`` are left out or counted as ``zero``.

    The maximum belongs to the last bin.
    """
    value = F.coalesce(quoted(col).cast("double"), F.lit(0.0)) if nulls == "zero" else quoted(col).cast("double")
    rows = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], "bin int, low double, high double, count long")
    width = (high - low) / bins if high > low else 1.0
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).count().select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "count")


def density2d(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Rows per square cell of two columns."""
    return (df.filter(quoted(x).isNotNull() & quoted(y).isNotNull())
            .groupBy(F.floor(quoted(x) / F.lit(cell)).alias("cx"), F.floor(quoted(y) / F.lit(cell)).alias("cy")).count())


def spearman(df: DataFrame, cols: Sequence[str], label: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``(feature, corr)``: absolute rank correlation of each column with the label.

    Rows with a null on either side are left out pair by pair, so a column with nulls needs label
    ranks of its own; all columns without nulls share one ranking. The source is staged once and added
    up per (feature, value, label) once for all columns; every ranking is made from those counts through
    range slices, so the number of jobs does not grow with the columns and no task holds a whole column.
    """
    named = stage(df.filter(quoted(label).isNotNull()).select(
        quoted(label).cast("double").alias("__y"), *[quoted(c).cast("double").alias(c) for c in cols]), "rank-source")
    counted = named.agg(F.count("*").alias("__n"), *[F.count(quoted(c)).alias(c) for c in cols]).first()
    # The ranking of the label that a feature uses: its own number, or -1 for all features without nulls.
    ranking = {c: -1 if counted[c] == counted["__n"] else i for i, c in enumerate(cols)}
    first = {number: c for c, number in reversed(ranking.items())}
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(ranking[c]).alias("ranking"), quoted(c).alias("x")) for c in cols])
    counts = stage(named.select("__y", F.inline(F.filter(cells, lambda c: c["x"].isNotNull())))
                   .groupBy("feature", "ranking", "x", "__y").agg(F.count("*").alias("n")), "rank-counts")
    labels = counts.filter(F.col("feature").isin(list(first.values()))).groupBy("ranking", "__y").agg(F.sum("n").alias("n"))
    ranked = stage(average_ranks(labels, ["ranking"], "__y", out="ry", rows_per_slice=rows_per_slice), "label-ranks")
    ry = F.col("ry")
    totals = ranked.groupBy("ranking").agg(F.sum("n").cast("double").alias("total"), F.sum(F.col("n") * ry).alias("sy"), F.sum(F.col("n") * ry * ry).alias("syy"))
    sums = stage(counts.join(ranked.select("ranking", "__y", "ry"), ["ranking", "__y"]).groupBy("feature", "ranking", "x").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * ry).alias("ry")), "rank-sums")
    placed = average_ranks(sums, ["feature"], "x", out="rx", rows_per_slice=rows_per_slice, staged=True)
    moments = placed.groupBy("feature", "ranking").agg(
        F.sum(F.col("n") * F.col("rx")).alias("sx"), F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("rx") * ry).alias("sxy")).join(F.broadcast(totals), "ranking")  # one row per column at most
    n, sx, sy = F.col("total"), F.col("sx"), F.col("sy")
    spread = F.sqrt((F.col("sxx") - sx * sx / n) * (F.col("syy") - sy * sy / n))
    return moments.select("feature", F.abs(F.try_divide(F.col("sxy") - sx * sy / n, spread)).alias("corr"))


def quad_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares ``y = c0 + c1 x + c2 x²`` per group; fewer than three distinct x give nulls.

    Rows are first added up per distinct x, which also counts these, then to power sums around the
    overall mean of x so that they do not cancel; a closed 3x3 solution per group.
    """
    both = df.filter(quoted(x).isNotNull() & quoted(y).isNotNull())
    origin = both.agg(F.avg(quoted(x).cast("double"))).first()[0] or 0.0
    a, b = quoted(x).cast("double") - F.lit(origin), quoted(y).cast("double")
    places = both.select(*by, a.alias("__x"), b.alias("__y")).groupBy(*by, "__x").agg(F.count("*").alias("__n"), F.sum("__y").alias("__y"))
    a, times = F.col("__x"), F.col("__n")
    sums = places.groupBy(*by).agg(
        F.sum(times).alias("n"), F.count("*").alias("places"), *[F.sum(F.pow(a, F.lit(p)) * times).alias(f"x{p}") for p in range(1, 5)],
        *[F.sum(F.pow(a, F.lit(p)) * F.col("__y")).alias(f"y{p}") for p in range(3)])
    solved = _solve_quadratic([F.col(c) for c in ("n", "x1", "x2", "x3", "x4")], [F.col(f"y{p}") for p in range(3)])
    fitted = sums.select(*by, "n", *[F.when(F.col("places") >= 3, c).alias(f"a{i}") for i, c in enumerate(solved)])
    a0, a1, a2, at = F.col("a0"), F.col("a1"), F.col("a2"), F.lit(origin)
    return fitted.select(*by, "n", (a0 - a1 * at + a2 * at * at).alias("c0"), (a1 - 2 * a2 * at).alias("c1"),
                         a2.alias("c2"))


def _solve_quadratic(sums: list[Column], right: list[Column]) -> list[Column]:
    """Cramer's rule on the normal equations whose entry (i, j) is ``sums[i + j]``."""
    def det(m: list[list[Column]]) -> Column:
        return sum((m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3])
                    for i in (1, 2)), m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]))

    left = [[sums[i + j] for j in range(3)] for i in range(3)]
    whole = det(left)
    return [F.try_divide(det([[right[i] if c == j else left[i][c] for c in range(3)] for i in range(3)]), whole)
            for j in range(3)]
