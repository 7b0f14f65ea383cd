import pytest
from pyspark.sql import functions as F

from wideframe.functions import flags, series
from wideframe.operators import columns


def test_exists_flags_ignore_absent_columns(spark):
    df = spark.createDataFrame([("x", None, 1), ("y", "z", None)], "a string, b string, c int")
    out = flags.exists_flags(df, {"AB": ["a", "b", "nope"], "None": ["nope"], "C": ["c"]})
    assert out.columns == ["AB_exists", "C_exists"]
    assert [tuple(r) for r in out.collect()] == [(False, True), (True, False)]
    assert flags.exists_flags(df, {"A": ["a"]}, drop=False).columns == ["a", "b", "c", "A_exists"]


def test_slot_totals_repeat_and_missing(spark):
    df = spark.createDataFrame([(1.0, None, "p", None), (None, None, None, None)],
                               "r1 double, r2 double, p1 string, p2 string")
    family = flags.Family("F", rates=["r1", "r1", "r2", "r9"], products=["p1", "p2"])
    assert [tuple(r) for r in flags.slot_totals(df, [family]).collect()] == [(1.0, 1), (0.0, 0)]
    again = flags.Family("F", rates=["r1", "r1", "r2"], allow_repeat=True)
    assert flags.slot_totals(df, [again], drop=False).first()["F_TotalRate"] == 2.0
    assert "F_Count" not in flags.slot_totals(df, [flags.Family("F", rates=["r1"])]).columns


@pytest.mark.parametrize("text,label", [
    ("2016-01-14", "1"), ("2016-01-15", "2"), ("12/31/2016", "27"), ("1/3/1996", "1"), ("Mar 4, 2017", "5"), ("4 Mar 2017", "5"),
    ("2017-03-04 10:11:12", "5"), ("fall", "_fall_"), ("  12 ", "_  12 _"), ("20170304", "_20170304_"), ("", ""), (None, None),
    ("2016-04-21 00:00:00.000", "8"), ("Apr 21 2016 12:00AM", "8"), ("2016/04/21", "8"), ("4/21/16", "8"), ("2016-04-21T10:00:00Z", "8"),
    ("2016-04-21T10:00:00.25+02:00", "8"), ("2016-04-21 10:00", "8"), ("May 3", "_May 3_"), ("1.2.3", "_1.2.3_"), ("2016/13/45", "_2016/13/45_")])
def test_biweek(spark, text, label):
    df = spark.createDataFrame([(text,)], "d string")
    assert flags.biweek_columns(df, ["d"]).first()["d_biweek"] == label


def test_labels_and_deltas(spark):
    df = spark.createDataFrame([("NONE", True, 1.0, 3.0), ("Nan", None, 3.0, 1.0), ("Ab", False, None, 1.0)],
                               "s string, f boolean, a double, b double")
    out = flags.normalize_labels(df, ["s", "f"]).collect()
    assert [r["s"] for r in out] == [None, None, "ab"] and [r["f"] for r in out] == ["true", None, "false"]
    both = flags.prev_delta(df, {"up": ("a", "b"), "no": ("a", "zz")}).collect()
    assert [r["up"] for r in both] == [2.0, None, None] and "no" not in both[0]
    assert [r["up"] for r in flags.prev_delta(df, {"up": ("a", "b")}, conditional=False).collect()] == [2.0, -2.0, None]


def _naive(values, day, n, base):
    if day is None:
        return [None] * n
    at = [min(max(round(day / 7) - base + i, 0), len(values) - 1) for i in range(n)]
    return [values[p] if values[p] is not None else 0.0 for p in at]


@pytest.mark.parametrize("day", [None, 0, 94, 101, 105, 108, 130, 270, 366])
def test_aligned_window_against_a_loop(spark, day):
    values = [float(w) if w % 5 else None for w in range(14, 40)]
    names = [f"{'Wk' if w % 2 else 'WK'}{w}Rain" for w in range(14, 40)]
    schema = "day int, " + ", ".join(f"{n} double" for n in names)
    df = columns.lower_names(spark.createDataFrame([(day, *values)], schema), r"^wk\d+rain$")
    spec = series.SeriesSpec({"Rain": r"wk\d+rain", "Gdd": r"wk\d+gdd"}, "day", prefix="Pl")
    row = series.aligned_window(df, spec).first().asDict()
    want = _naive(values, day, 20, 14)
    assert [row[f"Pl{i:02d}Rain"] for i in range(20)] == want
    totals = [None if day is None else sum(want[:i + 1]) for i in range(1, 20)]
    assert [row[f"Pl{i:02d}TotalRain"] for i in range(1, 20)] == totals
    assert not [c for c in row if "Gdd" in c or c.startswith("wk")]


def test_anchor_rounds_half_to_even(spark):
    df = spark.createDataFrame([(d,) for d in (17.5, 24.5, 10.4)], "d double")
    assert [r[0] for r in df.select(series.anchor_week(F.col("d"))).collect()] == [2.0, 4.0, 1.0]


def test_no_shuffle_and_no_python_in_row_operators(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    shaped = flags.slot_totals(flags.exists_flags(lines, {"f": ["l_returnflag"]}), [flags.Family("t", rates=["l_tax", "l_discount"])])
    plan = shaped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_attach_unit_record_takes_the_first_in_order(spark):
    rows = spark.createDataFrame([(1, "r"), (1, "s"), (2, "t"), (3, "u")], "unit int, k string")
    records = spark.createDataFrame([(1, 2, 9.0), (1, 1, 8.0), (2, 5, 7.0)], "unit int, ord int, v double")
    out = {r["k"]: r["v"] for r in series.attach_unit_record(rows, records, ["unit"], ["ord"]).collect()}
    assert out == {"r": 8.0, "s": 8.0, "t": 7.0}


def test_stateless_operators_take_a_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    shaped = flags.normalize_labels(flags.exists_flags(stream, {"s": ["o_orderstatus"]}), ["o_orderpriority"])
    writer = shaped.writeStream.format("memory").queryName("shaped").trigger(availableNow=True).start()
    writer.awaitTermination(60)
    assert spark.table("shaped").count() == spark.read.parquet(f"{sf}/orders.parquet").count()
