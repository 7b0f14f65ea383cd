"""Benchmark questions, unchanged and with other values, planted in documents."""

import duckdb
import pandas as pd
import pytest
from llm.odd import TEXTS, no_documents, odd_documents, prose
from pyspark.sql import functions as F
from wideframe.llm import decontaminate as d
from wideframe.llm.oracles import ORACLES

ITEM = "A train leaves the old station near Paris with 120 people and drives 45 km to the town of Lyon where 30 people get off before it returns to Paris again."
OTHER = ITEM.replace("Paris", "New York").replace("120", "3,500").replace("45 km", "7.5 miles").replace("Lyon", "Oslo").replace("30", "11")
MIXED = ITEM.replace("Paris", "Rome", 1)  # one name stands for two
SHORT = "The quick brown fox runs"
DIGITS = "1 2 3 4 5 6 7 8 9 10 11 12"
BENCHMARK = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, DIGITS), (6, prose(500, 40)), (6, prose(500, 40)), (None, prose(501, 40))]


def by_sql(docs, benchmark):
    """The same by the query's SQL, on tables of these rows."""
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    con.register("benchmark", pd.DataFrame(benchmark, columns=["item_id", "text"]).astype({"item_id": "Int64", "text": "string"}))
    return {r[0]: r[1:] for r in con.sql(f"SELECT doc_id, contaminated, n_items, n_exact, items FROM ({ORACLES['op4_decontaminate']})").fetchall()}


def found(spark, texts, bound=None):
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, item_id string").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in BENCHMARK], "item_id long, text string, words int")
    return {r.doc_id: (r.contaminated, r.n_items, r.n_exact, r.items) for r in d.contamination(docs, benchmark).collect()}


@pytest.mark.parametrize("bound", [200_000, -1])
def test_planted(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", bound)
    monkeypatch.setattr(d, "BROADCAST_IDS", bound)
    fill = [prose(600 + k, 50) for k in range(12)]
    half = " ".join(prose(500, 40).split()[10:26])
    few = " ".join(prose(500, 40).split()[10:20])
    texts = [(1, fill[0] + "\n" + ITEM + "\n" + fill[1]), (2, fill[2] + "\n" + OTHER + " " + fill[3]), (3, fill[4] + "\n" + MIXED), (4, fill[5]),
             (5, "the quick brown fox runs"), (6, DIGITS), (7, fill[6] + " " + half), (8, fill[7] + " " + few), (9, ITEM + "\n" + fill[8] + "\n" + prose(500, 40)),
             (10, ITEM.upper()), (11, OTHER + "\n" + ITEM), (12, prose(501, 40)), (13, None), (14, "")]
    got = found(spark, texts)
    assert got[1] == (True, 1, 1, "1") and got[2] == (True, 1, 0, "1") and got[3] == (True, 1, 1, "1")  # 13 tokens and more as they are
    assert got[4] == (False, 0, 0, "") and got[5] == (True, 1, 1, "2") and got[6] == (True, 1, 1, "5")
    assert got[7] == (True, 1, 1, "6") and not got[8][0] and got[9] == (True, 2, 2, "1,6") and got[11] == (True, 1, 1, "1")
    assert got[10] == (True, 1, 1, "1")
    assert not got[12][0] and not got[13][0] and not got[14][0] and len(got) == len(texts)
    assert got == by_sql(texts, BENCHMARK)


def test_odd_documents(spark):
    benchmark = spark.createDataFrame([(1, TEXTS[1])], "item_id long, text string")
    rows = d.contamination(odd_documents(spark), benchmark).collect()
    assert len(rows) == len(TEXTS) + 3
    assert {r.doc_id for r in rows if r.contaminated} == {1, 2, 3, 17}
    assert d.contamination(no_documents(spark), benchmark).count() == 0
    assert d.contamination(odd_documents(spark), benchmark.filter("false")).filter("contaminated").count() == 0


def test_many_names_and_numbers_in_a_row(spark):
    names = " ".join("Ab" + "c" * (k % 7) for k in range(100_000))
    numbers = ",".join(str(7 ** (k % 9)) for k in range(100_000))
    fill = prose(700, 30)
    texts = [(1, fill + " " + names + "\n" + ITEM), (2, fill + " " + numbers + "\n" + ITEM), (3, names + " " + numbers), (4, "a " + names.replace(" ", ", "))]
    got = found(spark, texts)
    assert got[1] == got[2] == (True, 1, 1, "1") and not got[3][0] and not got[4][0]
    read = d.with_forms(spark.createDataFrame([("x " + names + ". 1.2.3, 4:5. de La Paz, Oslo",)], "text string"), True).first()
    assert read.form0 == ["x", "«e:" + names.lower(), "«n:1.2.3", "«n:4:5", "de", "«e:la paz", "«e:oslo"]
    assert read.form1 == ["x", *names.lower().split(), "«n:1.2.3", "«n:4:5", "de", "la", "paz", "oslo"] and read.form2 == read.form0


def test_templates_are_tokens_without_values(spark):
    texts = [ITEM, OTHER, DIGITS, "", "...", "$ 5% Of NEW York, Rome; Li $ 7 km 8Km x", "The Paris Club, Ltd. 5, Km A B c D", *(t for t in TEXTS.values() if t)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    words = d.with_forms(df, True).select(*[d.template(F.col(f"form{f}")).alias(f"form{f}") for f in d.FORMS]).collect()
    assert d.with_forms(df, False).collect() == words


QUESTIONS = [(1, "What is the capital of France?"), (2, "Which of the two rivers that cross the old town is the longer one?"),
             (3, "Alice has 5 red cats. Alice buys 3 more cats. How many cats does Alice own now?"),
             (4, "In spring Anna, Bert, Carl, Dora, Emil and Fritz walked 12 km with Gerd, Hans, Ida and Jan to the lake near Bonn."), (5, ITEM)]


def test_in_any_place_and_case(spark):
    text = dict(QUESTIONS)
    fill = [prose(800 + k, 20) for k in range(20)]
    robert = text[3].replace("Alice", "Robert").replace("5", "7")
    docs = [(10 * i + k, f"{fill[k]} asked me {t} {fill[i]}") for i, t in QUESTIONS for k, t in enumerate((t, t.lower(), t.upper()))]
    docs += [(61, robert), (62, fill[1] + " asked me " + robert), (63, robert.replace("Robert", "Maria", 1)), (64, "asked me What is the capital of Spain?"),
             (65, "asked me what was the capital of France?"), (66, fill[3]), (67, "where Bob Smith said " + ITEM.replace("Paris again", "Paris Again"))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_items, r.n_exact, r.items) for r in d.contamination(docs, spark.createDataFrame(QUESTIONS, "item_id long, text string")).collect()}
    for i, _ in QUESTIONS:
        assert all(got[10 * i + k] == (1, 1, str(i)) for k in range(3)), (i, got)
    assert got[61] == got[62] == got[63] == (1, 0, "3") and got[64] == (1, 0, "1")  # 63: one name for one within a run
    assert got[65] == got[66] == (0, 0, "") and got[67] == (1, 1, "5")
    assert got == {k: v[1:] for k, v in by_sql([(r.doc_id, r.text) for r in docs.collect()], QUESTIONS).items()}


def test_a_run_is_judged_alone(spark):
    part = " ".join(ITEM.lower().split()[:22])
    twice = ITEM.replace("Paris", "Rome", 1).replace("Lyon", "Rome", 1)  # one value for two is no matter, two for one are
    each = "A train leaves the old station near Rome with 120 people and walks back to Oslo."  # 12 tokens
    short = [(1, ITEM), (2, "Two red foxes"), (3, "Is Rome old"), (4, "near Paris with 12 Paris or 12 at"), (5, "7 8 9")]
    docs = [(1, part), (2, part + "\n" + ITEM.replace("Paris", "Rome", 1)), (3, twice), (4, each), (5, "say two RED foxes ran"), (6, "two red cats"), (7, "is Oslo old?"),
            (8, "near Bonn with 12 Bonn or 12 at"), (9, "near Bonn with 12 Kiel or 12 at"), (10, "near Bonn with 12 Bonn or 13 at"), (11, "3 4 5"), (12, "6 7 8 9 10"), (13, None),
            (14, "A train leaves the old station near Rome with 120 people and drives 45 km"), (15, "1 a train 45 km leaves 7 the 8 old 9")]
    got = found_of(spark, docs, short)
    assert got == by_sql(docs, short)
    assert got[1] == got[2] == (True, 1, 1, "1") and got[3][0] and not got[4][0] and got[5] == (True, 1, 1, "2") and not got[6][0]
    assert got[7] == (True, 1, 0, "3") and got[8] == (True, 1, 0, "4") and not got[9][0] and not got[10][0] and not got[11][0]
    assert got[12] == (True, 1, 1, "5") and not got[13][0] and got[14] == (True, 1, 0, "1") and not got[15][0]


def found_of(spark, docs, benchmark):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = d.contamination(docs, spark.createDataFrame(benchmark, "item_id long, text string")).collect()
    return {r.doc_id: (r.contaminated, r.n_items, r.n_exact, r.items) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_runs_at_any_place(spark, seed):
    """Stretches of an item from any token on, at any place of a document, are found from 13 tokens on."""
    words = prose(900 + seed, 30).split()
    docs = [(100 * begin + 10 * long + before, prose(950 + begin, before) + " zz " + " ".join(words[begin:begin + 12 + long]) + " zz") for begin in range(0, 18, 3) for long in (0, 1) for before in range(7)]
    got = found_of(spark, docs, [(1, " ".join(words))])
    assert {k for k, v in got.items() if v[0]} == {k for k, _ in docs if k // 10 % 10}


def test_a_very_long_text(spark):
    docs = [(1, prose(7, 300_000) + " " + ITEM), (2, "x" * 1_000_000 + " Ab, " * 50_000)]
    assert {k: v[0] for k, v in found_of(spark, docs, [(1, ITEM), (2, "Two red foxes")]).items()} == {1: True, 2: False}
