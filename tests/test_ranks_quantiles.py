"""The large-input roads give the same results as the small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wideframe.operators import profile, quantiles, ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a third of those with one value."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(9000):
        group = "hot" if i % 3 == 0 else f"g{rng.integers(0, 5)}"
        value = 7.0 if i % 9 == 0 else float(np.round(rng.gamma(2.0, 40.0), 2))
        rows.append((group if i % 100 else None, value if i % 50 != 1 else None, float(i % 11)))
    return spark.createDataFrame(rows, "g string, v double, w double").repartition(6).cache()


def test_running_totals_through_slices(skewed):
    counts = skewed.filter("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    small = ranks.running_totals(counts, ["g"], ["v"], "n")
    sliced = ranks.running_totals(counts, ["g"], ["v"], "n", rows_per_slice=200)
    assert sliced.exceptAll(small).count() == 0 and small.exceptAll(sliced).count() == 0


def test_running_totals_of_text_without_group(skewed, spark):
    df = spark.createDataFrame([(f"k{i % 977:04d}{i}",) for i in range(3000)], "k string")
    sliced = ranks.running_totals(df, [], ["k"], rows_per_slice=100).collect()
    assert [r["before"] for r in sorted(sliced, key=lambda r: r["k"])] == list(range(3000))


@pytest.mark.parametrize("small,accuracy", [(10**6, 10_000), (500, 100), (50, 20)])
def test_exact_quantiles(skewed, small, accuracy):
    data = skewed.toPandas()
    probs = [0.002, 0.25, 0.5, 0.95, 0.998, 1.0]
    found = quantiles.exact_quantiles(skewed, ["v", "w"], probs, small, accuracy)
    for c in ("v", "w"):
        assert found[c] == pytest.approx(np.quantile(data[c].dropna(), probs).tolist(), abs=1e-9)


@pytest.mark.parametrize("small,accuracy", [(10**6, 100_000), (400, 1_000), (400, 20)])
def test_group_quantiles(skewed, small, accuracy):
    data = skewed.toPandas()
    probs = [0.5, 0.9, 0.99]
    rows = quantiles.group_quantiles(skewed, ["g"], "v", probs, small, accuracy).collect()
    want = {(None if not isinstance(g, str) else g): np.quantile(p["v"].dropna(), probs)
            for g, p in data.groupby("g", dropna=False)}
    assert len(rows) == len(want)
    for row in rows:
        assert row["quantiles"] == pytest.approx(want[row["g"]].tolist(), abs=1e-9)


def test_all_null_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_average_ranks_and_spearman(skewed):
    data = skewed.toPandas()
    both = data[["v", "w"]].dropna().rank()
    want = abs(both["v"].corr(both["w"]))
    for per_slice in (10**6, 300):
        got = profile.spearman(skewed, ["v"], "w", rows_per_slice=per_slice).first()["corr"]
        assert got == pytest.approx(want, abs=1e-9)


def test_top_n_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", None)], "k string, w int")
    assert {r["k"] for r in ranks.top_n_ties(df, "w", 2).collect()} == {"a", "b", "c"}
    assert ranks.top_n_ties(df.limit(0), "w", 2).count() == 0
    assert ranks.first_n(df, [F.desc("w")], 1).first()["k"] == "a"


def test_top_counts_and_histogram(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), ("d",), (None,)], "s string")
    assert {tuple(r) for r in profile.top_counts(df, "s", 2).collect()} == {("a", 3, False), ("b", 2, False), ("others", 2, True)}
    named = spark.createDataFrame([("others",)] * 3 + [("b",)] * 2 + [("c",)], "s string")
    assert {tuple(r) for r in profile.top_counts(named, "s", 1).collect()} == {("others", 3, False), ("others", 3, True)}
    assert profile.top_counts(df, "s", 9).count() == 4
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert profile.histogram(flat, "x", 4).select("bin", "count").collect()[0].asDict() == {"bin": 0, "count": 2}
    assert profile.histogram(flat.limit(0), "x", 4).count() == 0


def test_quad_fit_recovers_a_planted_curve(spark):
    rows = [(g, 30_000.0 + x, 5.0 + g - 0.5 * (x - 10) ** 2) for g in range(3) for x in range(0, 40, 3)]
    rows += [(9, 30_000.0, 1.0), (9, 30_001.0, 2.0)]
    fits = {r["g"]: r for r in profile.quad_fit(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    assert fits[1]["c2"] == pytest.approx(-0.5)
    assert -fits[1]["c1"] / (2 * fits[1]["c2"]) == pytest.approx(30_010, abs=1e-3)
    assert (fits[9]["c0"], fits[9]["c1"], fits[9]["c2"]) == (None, None, None) and fits[9]["n"] == 2


def test_short_slices_do_not_make_a_task_each(spark, monkeypatch):
    """Slices of 20 rows in few tasks: the totals are right, and what is staged has as many files as tasks."""
    files = []
    stage = ranks.stage
    monkeypatch.setattr(ranks, "stage", lambda df, label: files.append((label, stage(df, label))) or files[-1][1])
    df = spark.range(6_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"), (F.col("id") % 5).alias("n"))
    sliced = ranks.running_totals(df, ["g"], ["v"], "n", rows_per_slice=20)
    small = ranks.running_totals(df, ["g"], ["v"], "n")
    assert sliced.exceptAll(small).count() == 0 and sliced.count() == 6_000
    cut = dict(files[:2])["ranks"]
    assert cut.select(F.input_file_name()).distinct().count() <= spark.sparkContext.defaultParallelism
    assert cut.groupBy("__slice").count().agg(F.max("count"), F.count("*")).first()[0] == 20


def test_sketches_of_large_groups_are_small(spark, monkeypatch):
    """Without an accuracy of the caller's a group's sketch has that of a column's."""
    seen = []
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, a, f=F.percentile_approx: seen.append(a) or f(c, p, a))
    rows = quantiles.group_quantiles(spark.range(4_000).selectExpr("id % 2 AS g", "id DIV 2 AS v"), ["g"], "v", [0.5], small=100).collect()
    assert [r["quantiles"] for r in rows] == [[999.5], [999.5]] and max(seen) <= quantiles.ACCURACY
