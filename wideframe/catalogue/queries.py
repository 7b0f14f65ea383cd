"""One query per key, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideframe.catalogue import fixtures as fx
from wideframe.functions import flags, geometry, series
from wideframe.operators import categories, columns, filters, folds, joins, profile, ranks, spatial
from wideframe.operators import score as scores
from wideframe.plans import features as plan
from wideframe.plans import extra_trees as xt
from wideframe.plans import label_vectors as vectors
from wideframe.plans import models, saved
from wideframe.plans import search as model_search_plan
from wideframe.plans import sparse_boosting, steps, validation, whatif
from wideframe.session import spread, stage, staged_path
from wideframe.sources import blocks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 4, skip: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded: sums of doubles depend on the order of addition."""
    return df.select(*[
        F.round(columns.quoted(f.name), places).alias(f.name)
        if f.dataType.typeName() == "double" and f.name not in skip else columns.quoted(f.name)
        for f in df.schema.fields])


# --- columns -------------------------------------------------------------------------------------

@query
def column_select(spark, sf):
    wide = fx.orders_wide(spark, sf)
    return wide.select("o_orderkey", *tables.catalogue(
        wide, types=("string",), include=("n_lines",), exclude_patterns=("date%", "%status"), exclude_names=("prod7",)))


@query
def clean(spark, sf):
    cfg = plan.FeatureConfig(key=["unit", "YearID"], label="day", group="unit", renames={"year": "YearID"},
                             drop_substrings=("$", "cost"), numbered=(r"^wk(\d\d?)[ab]$", range(14, 40)))
    wide = fx.unit_year_wide(spark, sf, fx.ALL_WEEKS).withColumns({"a$b": F.lit(1), "PreCost": F.lit(2)})
    return rounded(plan.clean(wide, cfg), 2)


@query
def sanitize(spark, sf):
    odd = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("acct bal"),
                                                 F.col("c_mktsegment").alias("mkt-segment"))
    return columns.sanitize_names(odd)


@query
def align_features(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", "rate2", "rate1", "n_lines", "o_orderstatus")
    return columns.align_features(wide, ["rate1", "extra_feature", "rate2"], keep=["o_orderkey"])[0]


@query
def enforce_kinds(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", "o_custkey", "date1", "n_lines", "o_orderpriority")
    kinds = columns.infer_kinds(wide.schema, {"date1": "numeric", "o_custkey": "enum"}, label_numbers=["n_lines"])
    return columns.enforce_kinds(wide, kinds)


# --- filters -------------------------------------------------------------------------------------

@query
def base_filter(spark, sf):
    kept = filters.base_filter(fx.orders_wide(spark, sf), {"o_orderstatus": ["F", "O"]}, ["rate1", "prod3"], ["rate2"])
    return kept.select("o_orderkey", "o_orderstatus", "rate1", "rate2", "prod3")


@query
def time_split(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    before, after = filters.time_split(orders, "year", 1999)
    return before.withColumn("side", F.lit("train")).unionByName(after.withColumn("side", F.lit("test")))


@query
def holdout_split(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    train, held = filters.holdout_split(orders, fx.holdout_ids(spark, sf), "o_custkey")
    return train.withColumn("side", F.lit("train")).unionByName(held.withColumn("side", F.lit("holdout")))


@query
def outliers(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        *fx.LEARN_KEY[:4], "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return filters.remove_outliers(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                   cap=("l_extendedprice", 80_000))


@query
def outliers_bracketed(spark, sf):
    """The same limits found by brackets, as for tables beyond one task."""
    lines = fx.table(spark, sf, "lineitem").select(
        *fx.LEARN_KEY[:4], "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    limits = filters.fit_outliers(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], cap=("l_extendedprice", 80_000), small=500)
    return limits.apply(lines)


@query
def winsorize(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(filters.winsorize(orders, "o_totalprice", k=1.2, floor=0), 3)


@query
def fill_mean(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", "rate1", "rate2", "rate3", "rate4")
    return rounded(filters.fill_mean(wide, ["rate1", "rate2", "rate3", "rate4"]), 6)


@query
def fill_not_a_number(spark, sf):
    """NaN is no value: it takes no part in means, limits and clamps, is filled, and drops a row like a null."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, float("nan")).when(
        F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    kept = filters.fit_outliers(orders, ["price"], (0.1, 0.9)).apply(orders).select("o_orderkey", F.lit(1).alias("kept"))
    clamped = filters.winsorize(orders, "price", k=1.0).withColumnRenamed("price", "clamped")
    filled = filters.fill_mean(orders, ["price"])
    return rounded(filled.join(clamped, "o_orderkey").join(kept, "o_orderkey", "left"), 3)


@query
def range_rows(spark, sf):
    return filters.range_filter(fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20_000, 60_000)


@query
def parameter_rows(spark, sf):
    return tables.parameter_filter(fx.table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey")


@query
def first_rows(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranks.first_n(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 25)


@query
def sample_fraction(spark, sf):
    """Disjoint and complete: every order is on exactly one side."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey")
    part, rest = filters.sample_frac(orders, 0.25, ["o_orderkey"], seed=3)
    both = part.withColumn("side", F.lit(1)).unionByName(rest.withColumn("side", F.lit(0)))
    sides = both.groupBy("o_orderkey").agg(F.count("*").alias("sides"))
    return sides.agg(F.count("*").alias("orders"), F.max("sides").alias("max_sides"))


@query
def sample_rows(spark, sf):
    """The sampling operator: as many rows as asked for, no row twice, all of them from the table."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    sampled = stage(filters.sample_n(orders, 100, seed=5), "sampled")
    known = orders.withColumn("known", F.lit(1))
    return sampled.join(known, ["o_orderkey", "o_totalprice"], "left").agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_distinct"), F.count("known").alias("n_found"))


# --- flags, slots, labels ------------------------------------------------------------------------

FLAG_SETS = {"prod1": ["prod1"], "Tail": ["prod6", "prod7"], "Mixed": ["prod2", "absent"], "Gone": ["absent"]}
SLOT_FAMILIES = (
    flags.Family("Line", rates=[f"rate{i}" for i in fx.SLOTS], products=[f"prod{i}" for i in fx.SLOTS],
                 dates=[f"date{i}" for i in fx.SLOTS]),
    flags.Family("Tail", rates=["rate6", "rate7", "rate6"], products=["prod6", "prod7"]),
    flags.Family("RateOnly", rates=["rate5"]),
)


@query
def exists_flags(spark, sf):
    return flags.exists_flags(fx.orders_wide(spark, sf).select("o_orderkey", "prod1", "prod2", "prod6", "prod7"), FLAG_SETS)


@query
def slot_totals(spark, sf):
    wide = fx.orders_wide(spark, sf).drop("o_orderdate", "o_totalprice", "o_custkey", "n_lines")
    return flags.slot_totals(wide, SLOT_FAMILIES)


@query
def biweek(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", *[f"date{i}" for i in fx.SLOTS])
    return flags.biweek_columns(wide, [f"date{i}" for i in fx.SLOTS])


@query
def biweek_spellings(spark, sf):
    """Order dates as databases print them."""
    spellings = ("yyyy-MM-dd HH:mm:ss.SSS", "MMM d yyyy hh:mma", "yyyy/MM/dd", "M/d/yy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm")
    k = F.col("o_orderkey") % (len(spellings) + 1)
    text = F.lit("May 3")
    for i, spelling in enumerate(spellings):
        text = F.when(k == i, F.date_format("o_orderdate", spelling)).otherwise(text)
    return flags.biweek_columns(fx.table(spark, sf, "orders").select("o_orderkey", text.alias("d")), ["d"])


@query
def normalize_labels(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "None").when(F.col("o_orderstatus") == "F", "").otherwise(
        F.col("o_orderpriority"))
    wide = fx.orders_wide(spark, sf).select("o_orderkey", status.alias("mixed"), "prod1")
    return flags.normalize_labels(wide, ["mixed", "prod1"])


@query
def prev_delta(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", "rate1", "rate2", "rate3", "rate4")
    kept = flags.prev_delta(wide, {"Up": ("rate1", "rate2")}, drop=False)
    return flags.prev_delta(kept, {"Any": ("rate3", "rate4")}, conditional=False)


# --- ordered -------------------------------------------------------------------------------------

SERIES = series.SeriesSpec({"A": r"wk\d+a", "B": r"wk\d+b"}, day="day")
SERIES_NAMES = r"^wk\d+[ab]$"


@query
def aligned_window(spark, sf):
    wide = columns.lower_names(fx.unit_year_wide(spark, sf), SERIES_NAMES)
    return rounded(series.aligned_window(wide, SERIES), 2)


@query
def attach_record(spark, sf):
    first = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    customers = fx.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return series.attach_unit_record(customers, first, ["c_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query
def row_position(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return columns.with_row_id(orders, ["o_totalprice", "o_orderkey"])


@query
def row_position_ties(spark, sf):
    """Positions along an order with many ties: every position once, and in the order of the values."""
    placed = stage(columns.with_row_id(fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"]), "placed")
    return placed.groupBy("o_orderpriority").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"), F.count_distinct("row_id").alias("n"))


@query
def average_ranks_sliced(spark, sf):
    """Average ranks through range slices of few rows."""
    counts = fx.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count("*").alias("n"))
    return rounded(ranks.average_ranks(counts, ["l_returnflag"], "l_extendedprice", rows_per_slice=300), 2)


@query
def stop_epoch(spark, sf):
    return rounded(scores.stop_epoch(fx.trace(spark, sf), tol=200.0, min_epochs=3))


@query
def stop_epoch_gaps(spark, sf):
    """Traces that begin at a number of their own and leave epochs out."""
    trace = fx.trace(spark, sf).filter("epoch <> 2").withColumn("epoch", F.col("epoch") * 3 + F.col("run") % 4)
    return rounded(scores.stop_epoch(trace, tol=200.0, min_epochs=2))


# --- profiles ------------------------------------------------------------------------------------

@query
def null_profile(spark, sf):
    return rounded(profile.null_profile(fx.orders_wide(spark, sf)), 6)


@query
def null_columns_dropped(spark, sf):
    rare = F.when(F.col("n_lines") > 9, F.col("n_lines"))
    wide = fx.orders_wide(spark, sf).select("o_orderkey", "rate1", rare.alias("many_lines"), "prod7")
    return columns.drop_sparse_columns(wide)[0]


@query
def label_stats(spark, sf):
    return rounded(profile.label_stats(fx.table(spark, sf, "lineitem"), "l_extendedprice", ["l_suppkey"]))


@query
def histogram(spark, sf):
    wide = fx.orders_wide(spark, sf)
    both = [profile.histogram(wide, "rate2", 12, nulls).withColumn("nulls", F.lit(nulls)) for nulls in ("zero", "exclude")]
    return rounded(scores.stack_units(both))


@query
def density2d(spark, sf):
    return profile.density2d(fx.points(spark, sf), "x", "y", 0.05)


@query
def top_counts(spark, sf):
    return profile.top_counts(fx.table(spark, sf, "part"), "p_brand", 10)


@query
def top_counts_named_rest(spark, sf):
    """A value that is called like the row of all others."""
    part = fx.table(spark, sf, "part").select(F.when(F.col("p_size") % 3 == 0, F.lit("others")).otherwise(F.col("p_brand")).alias("brand"))
    return profile.top_counts(part, "brand", 3)


SPEARMAN_COLUMNS = ["l_quantity", "l_discount", "tax_open", "p_size", "p_retailprice"]


@query
def spearman(spark, sf):
    lines = fx.table(spark, sf, "lineitem").join(fx.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = lines.select(
        "l_extendedprice", "l_quantity", "l_discount", "p_size", "p_retailprice",
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("tax_open"))
    return rounded(profile.spearman(wide, SPEARMAN_COLUMNS, "l_extendedprice"), 6)


@query
def spearman_nulls(spark, sf):
    """Ten columns, each with nulls of its own."""
    lines = fx.table(spark, sf, "lineitem")
    cells = [F.when(F.col("l_suppkey") % 10 != k, (F.col("l_quantity") * (k + 3) + F.col("l_linenumber") * 7) % (11 + k)).alias(f"c{k}") for k in range(10)]
    return rounded(profile.spearman(lines.select("l_extendedprice", *cells), [f"c{k}" for k in range(10)], "l_extendedprice", rows_per_slice=5_000), 6)


@query
def spearman_dummies(spark, sf):
    """Rank correlation of the expanded label columns, the null class among them."""
    wide = fx.orders_wide(spark, sf).select("o_totalprice", "o_orderpriority", "prod5")
    hot = categories.one_hot(wide, categories.fit_dictionary(wide, ["o_orderpriority", "prod5"]), dummy_na=True)
    return rounded(profile.spearman(hot, [c for c in hot.columns if c != "o_totalprice"], "o_totalprice"), 6)


@query
def response_fit(spark, sf):
    return rounded(profile.quad_fit(fx.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"))


@query
def response_fit_few(spark, sf):
    """Groups with one, two, three and four distinct places: a curve needs three."""
    lines = fx.table(spark, sf, "lineitem").withColumn("x", F.least(F.col("l_linenumber"), F.col("l_suppkey") % 4 + 1).cast("double"))
    return rounded(profile.quad_fit(lines, ["l_suppkey"], "x", "l_extendedprice"), 2)


# --- categories ----------------------------------------------------------------------------------

@query
def category_dictionary(spark, sf):
    part = fx.table(spark, sf, "part")
    return categories.fit_dictionary(part, ["p_name", "p_brand", "p_type"]).entries


def _known_and_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents of all sources but one, and all documents, with a label that is sometimes null."""
    docs = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", F.when(F.col("quality") == 1, F.col("source")).alias("good_source"))
    return docs.filter("lang <> 'fr' and source <> 'src3'"), docs


@query
def category_codes(spark, sf):
    known, docs = _known_and_new(spark, sf)
    dictionary = categories.fit_dictionary(known, ["lang", "source", "good_source"])
    null_like = categories.encode_codes(docs, dictionary).withColumnsRenamed(
        {c: f"{c}_code" for c in dictionary.columns})
    next_code = categories.encode_codes(docs, dictionary, unknown="next").withColumnsRenamed(
        {c: f"{c}_next" for c in dictionary.columns})
    return null_like.join(next_code, "doc_id")


@query
def category_codes_joined(spark, sf):
    """Codes of a label column with nulls through a join instead of a map."""
    lines = fx.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("p_name"))
    dictionary = categories.fit_dictionary(lines.filter("p_partkey % 2 = 0"), ["p_name"])
    coded = categories.encode_codes(lines, dictionary)
    back = categories.decode_codes(coded, dictionary).withColumnRenamed("p_name", "label")
    return coded.join(back, "p_partkey")


@query
def category_labels(spark, sf):
    """Codes decoded again: the labels of the dictionary come back, others are null."""
    known, docs = _known_and_new(spark, sf)
    dictionary = categories.fit_dictionary(known, ["lang", "source", "good_source"])
    return categories.decode_codes(categories.encode_codes(docs, dictionary), dictionary)


@query
def unknown_labels(spark, sf):
    known, docs = _known_and_new(spark, sf)
    return categories.unknown_labels(docs, categories.fit_dictionary(known, ["lang", "source", "good_source"]))


@query
def split_encode(spark, sf):
    """Test documents encoded with the labels of the training documents."""
    known, docs = _known_and_new(spark, sf)
    return categories.split_encode(known, docs, ["lang"], exclude=["source", "good_source"])[1]


@query
def split_vector(spark, sf):
    """A label column of any size as a sparse vector: entries, and the rows of either side whose label has one."""
    parts = fx.table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("p_type"))
    train, test = parts.filter("p_partkey % 3 <> 0"), parts.filter("p_partkey % 3 = 0")
    sides = categories.split_encode(train, test, ["p_name", "p_type"], drop_first=False, form="vector")[:2]
    parted = [df.select(F.lit(n).alias("side"), models.vector_to_array("dummies").alias("v")) for n, df in zip(("train", "test"), sides)]
    return scores.stack_units(parted).groupBy("side").agg(
        F.max(F.size("v")).cast("long").alias("entries"), F.sum(F.aggregate("v", F.lit(0.0), lambda t, x: t + x)).cast("long").alias("hits"))


@query
def one_hot(spark, sf):
    orders = fx.orders_wide(spark, sf).select("o_orderkey", "o_orderpriority", "prod5")
    dictionary = categories.fit_dictionary(orders, ["o_orderpriority", "prod5"])
    return columns.sanitize_names(categories.one_hot(orders, dictionary, drop_first=True, dummy_na=True))


@query
def dummy_model(spark, sf):
    """Sums of each entry of the fitted encoder's vectors over rows with labels it has and has not seen."""
    known, docs = _known_and_new(spark, sf)
    model, names = categories.dummy_pipeline(known, ["lang", "good_source"])
    vectors = model.transform(docs).select(F.posexplode(models.vector_to_array("dummies")).alias("at", "value"))
    entries = F.array(*[F.lit(n) for n in names])
    return vectors.groupBy(F.get(entries, F.col("at")).alias("feature")).agg(F.sum("value").cast("long").alias("rows"))


@query
def sparse_long(spark, sf):
    wide = fx.orders_wide(spark, sf).select("o_orderkey", *[f"rate{i}" for i in fx.SLOTS], "n_lines")
    return tables.to_sparse_long(wide, [f"rate{i}" for i in fx.SLOTS] + ["n_lines"], "o_orderkey")


@query
def sparse_blocks(spark, sf):
    """The same triples, read back from blocks of at most some 500 cells with row pointers."""
    wide = fx.orders_wide(spark, sf).select("o_orderkey", *[f"rate{i}" for i in fx.SLOTS], "n_lines")
    cells = tables.to_sparse_long(wide, [f"rate{i}" for i in fx.SLOTS] + ["n_lines"], "o_orderkey")
    path = staged_path(spark, "sparse-blocks")
    blocks.sparse_blocks(cells, wide, "o_orderkey", cells_per_block=500).write(path)
    return blocks.SparseBlocks.load(spark, path).triples()


@query
def standardize(spark, sf):
    parts = fx.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(categories.standardize(parts, ["p_size", "p_retailprice"]), 6)


@query
def standardize_nulls(spark, sf):
    """The scaled pipeline over a column with nulls and one with NaN: both become the mean, that is zero."""
    parts = fx.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"),
        F.when(F.col("p_size") % 3 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("price"))
    model, _ = categories.feature_pipeline(parts, ["size", "price"], scale=True)
    cells = models.vector_to_array("features")
    return rounded(model.transform(parts).select("p_partkey", cells[0].alias("size"), cells[1].alias("price")), 5)


# --- folds ---------------------------------------------------------------------------------------

@query
def group_kfold(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    folded = folds.group_kfold(orders, "o_custkey", 5)
    return folded.groupBy("o_custkey", "fold").agg(F.count("*").alias("n_rows"))


@query
def group_kfold_nulls(spark, sf):
    """Orders without a customer are rows of their own: every row is tested once, and no customer is in two folds."""
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    folded = stage(folds.group_kfold(orders, "o_custkey", 4, nulls="spread"), "folded")
    tested = scores.stack_units([test.withColumn("run", F.lit(i)) for i, _, test in folds.folds(folded, 4)])
    split = folds.fold_leakage(folded.filter("o_custkey is not null"), "o_custkey")
    return tested.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("tested"), F.sum(F.when(F.col("o_custkey").isNull(), F.col("n"))).alias("without"),
        F.count("o_custkey").alias("groups")).withColumn("split", F.lit(split.count()))


@query
def hash_fold(spark, sf):
    """Every row has one of the folds, no customer has two, and every fold is used."""
    orders = folds.group_hash_fold(fx.table(spark, sf, "orders"), "o_custkey", 4, seed=11)
    per_group = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    return per_group.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("split"),
        F.min("lo").alias("first_fold"), F.max("hi").alias("last_fold"))


@query
def leakage_check(spark, sf):
    folded = folds.group_kfold(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 3)
    shared = folds.fold_leakage(folded, "o_custkey").join(folded, "o_custkey").select("o_custkey", "fold").distinct()
    every = spark.createDataFrame([(i,) for i in range(3)], "fold int")
    return every.join(shared, "fold", "left").groupBy("fold").agg(F.count("o_custkey").alias("shared"))


# --- scores --------------------------------------------------------------------------------------

@query
def score_report(spark, sf):
    return rounded(scores.score(fx.preds(spark, sf)))


@query
def score_by_unit(spark, sf):
    report = scores.score(fx.preds(spark, sf), by=["unit"]).withColumn("sq_mean", F.round("sq_mean", 2))
    return rounded(report, 6)


@query
def score_bounds(spark, sf):
    return rounded(scores.score_table(scores.score(fx.preds(spark, sf), by=["fold"])))


@query
def score_pooled(spark, sf):
    rows = fx.preds(spark, sf)
    train, test = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'").drop("unit")
    return rounded(scores.score_pooled([train, test]))


@query
def loss_by_fold(spark, sf):
    return rounded(scores.abs_std_loss(fx.preds(spark, sf), n=2, by=["fold"]))


@query
def holdout_report(spark, sf):
    return rounded(scores.holdout_stats(fx.preds(spark, sf), by=["fold"]))


@query
def holdout_report_bracketed(spark, sf):
    """The same percentiles found by brackets, as for groups beyond one task."""
    return rounded(scores.holdout_stats(fx.preds(spark, sf), by=["fold"], small=200))


@query
def baseline_score(spark, sf):
    rows = fx.preds(spark, sf)
    train, test = rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")
    return rounded(scores.stack_units([
        scores.baseline_score(train, test, mean_from=m).withColumn("mean_from", F.lit(m)) for m in ("train", "test", "all")]))


@query
def baseline_by_fold(spark, sf):
    return rounded(scores.baseline_folds(fx.preds(spark, sf), "fold"))


def _grid_results(spark, sf) -> DataFrame:
    by = ["l_returnflag", "l_linestatus", "fold"]
    made = scores.score(fx.preds(spark, sf), by=by)
    return made.select(*by, F.col("abs_std_3").alias("score"), "abs_mean", F.col("n_samples").alias("iteration"))


@query
def cv_summary(spark, sf):
    params = ["l_returnflag", "l_linestatus"]
    return rounded(scores.cv_summary(_grid_results(spark, sf), params, "score", "iteration", ["abs_mean"]))


@query
def best_params(spark, sf):
    params = ["l_returnflag", "l_linestatus"]
    return rounded(scores.best_params(scores.cv_summary(_grid_results(spark, sf), params), ties=params))


@query
def importance_merge(spark, sf):
    weights = fx.fold_importance(spark, sf)
    return scores.merge_importance([scores.importance_by_source(weights, ["fold"])])


@query
def topn_ties(spark, sf):
    sizes = fx.table(spark, sf, "part").select("p_partkey", "p_size")
    return ranks.top_n_ties(sizes, "p_size", 30)


@query
def unit_report(spark, sf):
    return rounded(models.unit_report(fx.preds(spark, sf), "unit", keep=["fold"]))


# --- joins, geometry -----------------------------------------------------------------------------

@query
def assemble(spark, sf):
    """Lines with order, customer, nation, region and part, filtered at the source."""
    t = {n: fx.table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")}
    lines = filters.base_filter(t["lineitem"], {"l_returnflag": ["A", "N"]}, ["l_shipdate"], ["l_extendedprice"])

    def same(*names: str) -> dict[str, str]:
        return {n: n for n in names}

    return joins.assemble(lines, [
        joins.Lookup(t["orders"], {"l_orderkey": "o_orderkey"}, same("o_custkey", "o_orderpriority")),
        joins.Lookup(t["part"], {"l_partkey": "p_partkey"}, same("p_brand", "p_size")),
        joins.Lookup(t["customer"], {"o_custkey": "c_custkey"}, same("c_nationkey", "c_mktsegment")),
        joins.Lookup(t["nation"], {"c_nationkey": "n_nationkey"}, same("n_regionkey", "n_name")),
        joins.Lookup(t["region"], {"n_regionkey": "r_regionkey"}, same("r_name")),
    ], keep=["l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority", "p_brand", "p_size", "c_mktsegment", "n_name", "r_name"])


@query
def xml_geometry(spark, sf):
    shapes = geometry.parse_shapes(fx.shapes(spark, sf), "xml")
    x, y = geometry.centroid(F.col("rings"))
    box = geometry.bbox(F.col("rings"))
    return rounded(shapes.select(
        "shape_id", geometry.xml_double(F.col("xml"), "(//Xmin)[1]").alias("xml_xmin"),
        geometry.xml_double(F.col("xml"), "(//Ymin)[1]").alias("xml_ymin"), F.size("rings").alias("n_rings"),
        geometry.area(F.col("rings")).alias("area"), x.alias("cx"), y.alias("cy"),
        box["xmax"].alias("xmax"), box["ymax"].alias("ymax")), 9)


@query
def spatial_semi(spark, sf):
    shapes = geometry.parse_shapes(fx.shapes(spark, sf), "xml")
    return spatial.polygons_with_points(shapes, fx.points(spark, sf), "shape_id").select("shape_id", "s_acctbal")


@query
def spatial_split(spark, sf):
    """The same shapes on a grid whose cells are split until they hold few points."""
    shapes = geometry.parse_shapes(fx.shapes(spark, sf), "xml")
    return spatial.polygons_with_points(shapes, fx.points(spark, sf), "shape_id", points_per_cell=4).select("shape_id", "s_acctbal")


@query
def spatial_dealt(spark, sf):
    """The same shapes, with the polygons of a cell dealt over keys from the third on."""
    shapes = geometry.parse_shapes(fx.shapes(spark, sf), "xml")
    return spatial.polygons_with_points(shapes, fx.points(spark, sf), "shape_id", polygons_per_key=2).select("shape_id", "s_acctbal")


@query
def spatial_parts(spark, sf):
    """Squares of two parts, one with a hole: area of all parts, and whether a point lies in any of them."""
    k = F.col("s_suppkey")
    x, y = ((k * 37) % 41 - 20) / F.lit(20.0), ((k * 53) % 41 - 20) / F.lit(20.0)

    def square(x: Column, y: Column, side: float) -> Column:
        corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
        return F.array(*[F.struct((x + a * side).alias("x"), (y + b * side).alias("y")) for a, b in corners])

    shapes = fx.table(spark, sf, "supplier").select(
        k.alias("shape_id"), F.array(square(x, y, 0.25), square(x + 0.5, y, 0.25), square(x + 0.0625, y + 0.0625, 0.125)).alias("rings"))
    held = spatial.polygons_with_points(shapes, fx.points(spark, sf), "shape_id").select("shape_id", F.lit(1).alias("held"))
    return rounded(shapes.select("shape_id", geometry.area(F.col("rings")).alias("area")).join(held, "shape_id", "left"), 6)


HOLDOUT_FEATURES = ["l_quantity", "l_returnflag__DUMMY__a", "l_returnflag__DUMMY__zz", "s_acctbal", "absent"]


@query
def holdout_assembly(spark, sf):
    """Shapes that hold a point, each with its supplier's first line, as rows for a model."""
    shapes = geometry.parse_shapes(fx.shapes(spark, sf), "xml").withColumn("unit", F.col("shape_id")).drop("xml")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    lines = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("unit"), "l_quantity", "l_returnflag", *order)
    return plan.assemble_holdout(shapes, fx.points(spark, sf), lines, HOLDOUT_FEATURES, "shape_id", "unit", order)[0]


# --- round trips -----------------------------------------------------------------------------------

def _odd_texts(spark, sf) -> DataFrame:
    """Orders with padded, empty, broken and quoted texts."""
    k = F.col("o_orderkey")
    text = (F.when(k % 9 == 0, F.lit("")).when(k % 9 == 1, F.lit(" pad ")).when(k % 9 == 2, F.lit('a\nb\r\n"c"')).when(k % 9 == 3, F.lit("\\N\t,\\"))
            .when(k % 9 != 4, F.col("o_orderpriority")))
    return fx.table(spark, sf, "orders").select("o_orderkey", text.alias("text"), "o_totalprice", "o_orderdate")


@query
def csv_round_trip(spark, sf):
    """Typed CSV written to the shared folder and read back."""
    path = staged_path(spark, "csv")
    tables.write_csv(_odd_texts(spark, sf), path)
    return tables.read_csv(spark, path)


@query
def cells_round_trip(spark, sf):
    """Tab-separated text whose header has another order than the schema."""
    path = staged_path(spark, "cells")
    rows = fx.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    rows.write.options(header=True, sep="\t").csv(path)
    return tables.read_cells(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double", spread=4)


@query
def table_round_trip(spark, sf):
    """A partitioned table read by column, and a sorted text export of it."""
    path = staged_path(spark, "table")
    tables.write_table(fx.table(spark, sf, "orders"), path, partition_by=["o_orderstatus"])
    back = tables.read_table(spark, path, ["o_orderkey", "o_totalprice", "o_orderstatus"])
    tables.sorted_write(back, ["o_totalprice", "o_orderkey"], f"{path}-sorted")
    kept = spark.read.csv(f"{path}-sorted", schema="o_orderkey long, price double, status string", header=True)
    return back.join(kept, "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("price") == F.col("o_totalprice")).alias("same"))


@query
def id_list_complement(spark, sf):
    """Orders of customers that an id file lists, and the rest as their complement."""
    path = staged_path(spark, "ids")
    fx.holdout_ids(spark, sf).write.option("header", True).csv(path)
    ids = tables.read_id_list(spark, path, "o_custkey")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    listed = orders.join(ids, "o_custkey", "left_semi").select("o_orderkey")
    rest = filters.complement(orders, listed, "o_orderkey")
    return rest.select("o_orderkey", F.lit(0).alias("listed")).unionByName(listed.withColumn("listed", F.lit(1)))


@query
def unit_files(spark, sf):
    """The unit of every row from the name of its file: here the number of the task that wrote it."""
    path = staged_path(spark, "units")
    fx.table(spark, sf, "orders").select("o_orderkey").repartition(4, "o_orderkey").withColumn("written_by", F.spark_partition_id().cast("long")).write.parquet(path)
    back = tables.read_units(spark, path, r"^part-(\d+)-")
    return back.agg(F.count("*").alias("n_rows"), F.count_if(F.col("unit") == F.col("written_by")).alias("n_right"))


@query
def feature_set_round_trip(spark, sf):
    """The encoded set written, loaded, and read as the sparse matrix."""
    path = staged_path(spark, "features")
    plan.feature_set(fx.season_wide(spark, sf), SEASON).write(path)
    return rounded(plan.FeatureSet.load(spark, path).long(), 3)


@query
def model_round_trip(spark, sf):
    """A pipeline with its dictionary saved and loaded: rows whose prediction is unchanged, and the evaluator's score."""
    full = stage(fx.learn(spark, sf).select(*fx.LEARN_KEY, *[c for c in NUMERIC if c not in fx.LEARN_KEY], *LABELS, "y"), "learn")
    pipeline, _ = categories.feature_pipeline(full, NUMERIC, LABELS, scale=True)
    vectors = pipeline.transform(full)
    model = models.boosted("y", maxIter=2, maxDepth=3).fit(vectors)
    path = staged_path(spark, "pipeline")
    tables.save_model(PipelineModel(stages=[pipeline, model]), path)
    again = tables.load_model(path).transform(full).withColumnRenamed("prediction", "again")
    both = model.transform(again)
    value = models.AbsStdEvaluator("y", "prediction").evaluate(both)
    expected = scores.abs_std_loss(both, "y", "prediction").first()["loss"] * 100
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.col("again") == F.col("prediction")).alias("n_same")).withColumn(
        "evaluated", F.lit(abs(value - expected) <= 0.5))


# --- compositions --------------------------------------------------------------------------------

SEASON = plan.FeatureConfig(
    key=["o_orderkey"], label="o_totalprice", group="o_custkey", weight="n_lines", drop_substrings=("$", "cost"),
    numbered=(r"^wk(\d\d?)[ab]$", range(14, 40)), date_pattern=r"^date[1-4]$",
    flags={"Slot5": ["prod5", "date5"], "Tail": ["prod6", "prod7", "absent"]},
    families=(flags.Family("Line", rates=[f"rate{i}" for i in range(1, 5)], products=[f"prod{i}" for i in range(1, 5)],
                           dates=[f"date{i}" for i in range(1, 5)]),),
    series=series.SeriesSpec({"A": r"wk\d+a", "B": r"wk\d+b"}, day="day", n=6), series_names=SERIES_NAMES,
    deltas={"Rate_Prev": ("rate5", "rate6")}, exclude=["date6", "date7"], label_dependent=["rate7"],
    number_labels=["year"], cap=("o_totalprice", 450_000))

# The older order takes the totals first; the family then owns the label columns that come later.
SEASON_RAW = replace(SEASON, families=(replace(SEASON.families[0], dates=[f"date{i}_biweek" for i in range(1, 5)]),))


@query
def shape(spark, sf):
    return rounded(plan.shape(plan.clean(fx.season_wide(spark, sf), SEASON), SEASON, biweek=True, drop=True), 2)


@query
def feature_matrix(spark, sf):
    """The whole path from wide rows to the sparse matrix."""
    return rounded(plan.feature_set(fx.season_wide(spark, sf), SEASON).long(), 3)


@query
def feature_matrix_raw(spark, sf):
    """The older order of steps: date labels kept, unconditional deltas, nulls as zero, no outlier filter."""
    return rounded(plan.encode_raw(plan.clean(fx.season_wide(spark, sf), SEASON), SEASON_RAW).long(), 2)


@query
def label_form(spark, sf):
    orders = fx.orders_wide(spark, sf).select("o_orderkey", "o_custkey", "o_orderpriority", "prod5", "rate1", "rate5")
    return plan.shape_labels(orders, ["o_orderpriority", "prod5"], ids=["o_custkey"])


@query
def group_cells(spark, sf):
    """The dictionary of the label columns after cleaning and shaping with date labels."""
    return plan.shape_group_cells(fx.season_wide(spark, sf), SEASON)[1].entries


# --- what-if -------------------------------------------------------------------------------------

def _planted(x: Column) -> Column:
    """A response with a row-dependent optimum."""
    off = x - (F.lit(20.0) + F.col("p_size") / F.lit(5.0))
    return F.lit(120.0) - F.lit(0.05) * off * off + F.lit(0.8) * F.col("p_size")


@query
def whatif_best(spark, sf):
    rows = fx.learn(spark, sf)
    sweep = whatif.sweep_bounds(rows, "l_quantity", 10, 40, 5)
    best = whatif.whatif(rows, _planted, "l_quantity", sweep, [*fx.LEARN_KEY[:5], "p_size"])
    return rounded(best, skip=["l_quantity"])


@query
def whatif_curve(spark, sf):
    """Mean response curve per supplier over the grid."""
    rows = fx.learn(spark, sf)
    sweep = whatif.sweep_bounds(rows, "l_quantity", 10, 40, 5)
    curve = whatif.sweep_curve(rows, _planted, "l_quantity", sweep, ["l_suppkey"])
    return rounded(curve.groupBy("l_suppkey", "l_quantity").agg(F.avg("prediction").alias("response")), 10)


# --- models --------------------------------------------------------------------------------------
# Fitted trees differ from engine to engine, so these report what must hold whatever the trees are:
# every row predicted by a model that did not see its group, paths that end in the model's own
# prediction, errors below those of the mean.

NUMERIC = ["l_quantity", "p_size", "l_discount", "l_tax", "p_retailprice"]
LABELS = ["l_returnflag", "l_linestatus", "p_brand"]


def _learn_vectors(spark, sf) -> DataFrame:
    rows = VectorAssembler(inputCols=NUMERIC, outputCol="features").transform(fx.learn(spark, sf))
    return spread(stage(rows.select(*fx.LEARN_KEY, "p_size", "y", "features"), "learn"))


def _beside_mean(reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Each report's number of rows, and whether its error is below that of the overall mean."""
    guess = scores.baseline_score(rows, rows).first()["abs_mean"]
    return reports.select("model", "n_samples", (F.col("abs_mean") < F.lit(guess)).alias("beats_mean"))


@query
def nested_cv(spark, sf):
    """Rows tested per outer fold, groups that were also trained on, and whether the model beat the mean."""
    result = validation.nested_cv(
        _learn_vectors(spark, sf), "y", "l_suppkey", fx.LEARN_KEY, models.param_grid({"maxDepth": [2, 3]}), NUMERIC,
        outer=3, inner=2, rounds=4, patience=2, parallelism=4, with_importance=False)
    tested = result.predictions.groupBy(folds.FOLD).agg(
        F.count("*").alias("n_rows"), F.count_distinct("l_suppkey").alias("n_groups"))
    better = result.outer.select(folds.FOLD, (F.col("test_abs") < F.col("guess_abs")).alias("beats_mean"))
    return tested.join(better, folds.FOLD)


@query
def stacking(spark, sf):
    """The base models' out-of-fold predictions and the stacked model, each beside the mean."""
    rows = _learn_vectors(spark, sf)
    base = {"boosted": models.boosted("y", maxIter=5, maxDepth=3), "forest": models.forest("y", numTrees=8, maxDepth=5)}
    model, oof = validation.stack(rows, "y", "l_suppkey", fx.LEARN_KEY[:2], base, k=2, meta={"maxIter": 5}, parallelism=4)
    reports = [scores.score(oof, "y", n).withColumn("model", F.lit(n)) for n in base]
    reports.append(scores.score(model.transform(rows), "y", "prediction").withColumn("model", F.lit("stacked")))
    return _beside_mean(scores.stack_units(reports), rows)


@query
def leaderboard(spark, sf):
    rows = _learn_vectors(spark, sf)
    entries = models.candidates(["boosted", "forest", "elastic_net"], "y", params={
        "boosted": {"maxIter": 5, "maxDepth": 3}, "forest": {"numTrees": 8, "maxDepth": 5}})
    return _beside_mean(validation.leaderboard(rows, "y", "l_suppkey", fx.LEARN_KEY[:2], entries, k=2), rows)


@query
def model_search(spark, sf):
    """A drawn part of two grids within a budget of four models: every candidate's state, and whether it beat the mean."""
    grids = {models.boosted: ({"maxDepth": [2, 3], "maxIter": [3, 5]}, 2), models.forest: ({"maxDepth": [3, 5], "numTrees": [4, 8]}, 4)}
    entries = {}
    for maker, (choices, n) in grids.items():
        entries |= model_search_plan.named(maker, "y", models.random_search(models.param_grid(choices), n, 5))
    rows = _learn_vectors(spark, sf)
    found = model_search_plan.search(rows, "y", "l_suppkey", entries, k=2, max_models=4, parallelism=4)
    guess = scores.baseline_score(rows, rows).first()["abs_mean"]
    board = found.board.select("number", "n_samples", (F.col("abs_mean") < F.lit(guess)).alias("beats_mean"))
    return found.trials.join(board, "number", "left").select(
        "number", F.substring_index("model", " ", 1).alias("family"), "state", "folds_done", "n_samples", "beats_mean")


@query
def tree_importance(spark, sf):
    """Whether split counts add up to the splits of the trees and gains to one, with the top feature."""
    model = models.boosted("y", maxIter=5, maxDepth=4).fit(_learn_vectors(spark, sf))
    wanted = {"weight": sum(t.numNodes // 2 for t in model.trees), "gain": 1.0}
    return scores.stack_units([
        models.importance(model, NUMERIC, spark, kind).agg(
            (F.abs(F.sum("weight") - F.lit(total)) < 1e-6).alias("complete"), F.max_by("feature", "weight").alias("top"))
        .withColumn("kind", F.lit(kind)) for kind, total in wanted.items()])


@query
def error_trace(spark, sf):
    """Iterations traced per dataset, and whether the error fell from the first to the last."""
    train, test = folds.train_test(_learn_vectors(spark, sf), 0.3, fx.LEARN_KEY)
    model = models.boosted("y", maxIter=6, maxDepth=3).fit(train)
    return models.error_trace(model, {"train": train, "test": test}).groupBy("dataset").agg(
        F.count("*").alias("iterations"),
        (F.max_by("error", "iteration") < F.min_by("error", "iteration")).alias("fell"))


@query
def forest_epochs(spark, sf):
    """What holds of a growing forest: rows it predicts, trees per epoch kept, gains above the tolerance, and the mean beaten."""
    rows = _learn_vectors(spark, sf)
    train, test = folds.train_test(rows, 0.3, fx.LEARN_KEY)
    grown = models.grow_forest(train, test, "y", step=4, max_epochs=3, tol=0.01, maxDepth=5)
    gains = [a - b for a, b in zip(grown.scores, grown.scores[1:])]
    again = scores.abs_std_loss(grown.transform(test), "y", "prediction").first()["loss"]
    guess = scores.baseline_score(rows, rows).first()["abs_mean"]
    made = scores.score(grown.transform(rows), "y", "prediction")
    return made.select("n_samples", (F.col("abs_mean") < F.lit(guess)).alias("beats_mean")).withColumns({
        "trees": F.lit(all(len(m.trees) == 4 for m in grown.models)), "gains": F.lit(all(g >= 0.01 for g in gains)),
        "replayed": F.lit(abs(again - grown.scores[-1]) < 1e-6)})


@query
def decision_paths(spark, sf):
    """Per tree: rows that reach a leaf, and rows whose path breaks the test it reports."""
    rows = _learn_vectors(spark, sf)
    model = models.boosted("y", maxIter=2, maxDepth=3).fit(rows)
    paths = models.decision_paths(model, rows, NUMERIC, fx.LEARN_KEY)
    leaf = F.col("leaf_prediction").isNotNull()
    return paths.groupBy("tree").agg(
        F.count_if(leaf).alias("leaves"), F.count_if(F.col("level") == 0).alias("starts"),
        F.count_if(~leaf & ((F.col("sign") == "<=") != (F.col("value") <= F.col("threshold")))).alias("broken"))


@query
def decision_replay(spark, sf):
    """Rows whose leaf values, weighted by tree, do not add up to the model's prediction."""
    rows = _learn_vectors(spark, sf)
    model = models.boosted("y", maxIter=2, maxDepth=3).fit(rows)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    leaves = models.decision_paths(model, rows, NUMERIC, fx.LEARN_KEY).filter("leaf_prediction is not null")
    replayed = leaves.groupBy(*fx.LEARN_KEY).agg(F.sum(F.col("leaf_prediction") * F.get(weights, F.col("tree"))).alias("sum"))
    both = model.transform(rows).join(replayed, fx.LEARN_KEY)
    return both.agg(F.count("*").alias("n_rows"),
                    F.count_if(F.abs(F.col("sum") - F.col("prediction")) > 1e-6).alias("n_off"))


@query
def whatif_model(spark, sf):
    """The sweep with a trained model: rows swept, and rows whose best value is near the planted optimum of 30."""
    full = spread(stage(fx.learn(spark, sf).select(*fx.LEARN_KEY, *[c for c in NUMERIC if c not in fx.LEARN_KEY], "y"), "learn"))
    pipeline, _ = categories.feature_pipeline(full, NUMERIC)
    model = models.boosted("y", maxIter=5, maxDepth=4).fit(pipeline.transform(full))
    sweep = whatif.sweep_bounds(full, "l_quantity", 10, 40, 5)
    keyed = full.withColumn("planted", F.col("l_quantity"))
    key = [c for c in fx.LEARN_KEY if c != "l_quantity"] + ["planted"]
    best = whatif.whatif(keyed, PipelineModel([pipeline, model]), "l_quantity", sweep, key)
    return best.agg(F.count("*").alias("n_rows"), F.count_if(F.col("best").between(20, 40)).alias("near_optimum"))


@query
def whatif_steps(spark, sf):
    """A sweep of 100 values with a trained model inside the row: rows, rows that multiplied rows agree with, and rows near the planted optimum."""
    rows = _learn_vectors(spark, sf)
    model = models.boosted("y", maxIter=5, maxDepth=4).fit(rows)
    index, grid = NUMERIC.index("l_quantity"), [0.5 * k for k in range(1, 101)]
    key = [*fx.LEARN_KEY]
    best = steps.whatif_steps(rows, model, index, grid, [*key, "features"]).dropna("any", subset=key)
    # The same by the model itself, for some places of the grid: no prediction is higher, and the best is reached.
    values = F.array(*[F.get(vector_to_array("features"), F.lit(k)) if k != index else F.col("swept") for k in range(len(NUMERIC))])
    some = F.array_distinct(F.concat(F.array(*[F.lit(g) for g in grid[::9]]), F.array("best")))
    probe = best.withColumn("swept", F.explode(some)).withColumn("features", array_to_vector(values))
    high = model.setPredictionCol("by_model").transform(probe).groupBy(*key).agg(F.max(F.abs(F.when(F.col("swept") == F.col("best"), F.col("by_model") - F.col("prediction")))).alias("off"),
                                  F.max(F.col("by_model") - F.col("prediction")).alias("over"), F.first("best").alias("best"))
    agree = (F.col("off") < 1e-9) & (F.col("over") < 1e-9)
    return high.agg(F.count("*").alias("n_rows"), F.count_if(agree).alias("n_equal"), F.count_if(F.col("best").between(20, 40)).alias("near_optimum"))


@query
def extra_trees(spark, sf):
    """Per tree of a randomised forest: rows replayed through its node table, cuts outside their node's range, leaves that are not the mean of their rows."""
    rows = _learn_vectors(spark, sf)
    model = xt.fit_extra_trees(rows, "y", trees=4, max_depth=5, min_leaf=5, tries=4)
    nodes = stage(model.table(spark), "nodes")  # model size
    at = rows.select("y", vector_to_array("features").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree"))
    at = at.join(F.broadcast(nodes.filter("depth = 0").select("tree", "node")), "tree")
    seen = None
    for _ in range(6):
        here = at.join(F.broadcast(nodes.drop("tree", "depth")), "node")
        value = F.get("v", F.col("feature"))
        stats = here.groupBy("tree", "node").agg(F.count("*").alias("rows"), F.avg("y").alias("own"), F.first("feature").alias("feature"), F.first("cut").alias("cut"),
                                                 F.min(value).alias("low"), F.max(value).alias("high"), F.first("n").alias("n"), F.first("mean").alias("mean"))
        seen = stats if seen is None else seen.union(stats)
        at = here.filter("feature is not null").select("y", "v", "tree", F.when(value <= F.col("cut"), F.col("left")).otherwise(F.col("right")).alias("node"))
    leaf = F.col("feature").isNull()
    scored = model.transform(rows).select("y", "prediction")
    better = scored.agg((F.avg(F.abs(F.col("y") - F.col("prediction"))) < F.lit(scores.baseline_score(rows, rows).first()["abs_mean"])).alias("beats_mean"))
    return seen.groupBy("tree").agg(
        F.sum(F.when(leaf, F.col("rows"))).alias("n_rows"), F.count_if(~leaf & ~((F.col("low") <= F.col("cut")) & (F.col("cut") < F.col("high")))).alias("off_cuts"),
        F.count_if((F.col("rows") != F.col("n")) | (F.abs(F.col("own") - F.col("mean")) > 1e-9)).alias("off_nodes")).crossJoin(F.broadcast(better))


@query
def boosted_missing(spark, sf):
    """Boosting where small quantities are often missing: the base, the rows, rows that the tree's leaves do not explain, and whether it errs less than trees on filled values."""
    rows = fx.learn(spark, sf).withColumn("seen", F.when((F.col("l_quantity") < 20) & (F.col("l_orderkey") % 3 != 0), float("nan")).otherwise(F.col("l_quantity").cast("double")))
    names = ["seen", "p_size", "l_discount", "l_tax"]
    filled = Imputer(inputCols=names, outputCols=[f"{n}_filled" for n in names]).fit(rows := rows.withColumn("p_size", F.col("p_size").cast("double"))).transform(rows)
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(filled)
    rows = VectorAssembler(inputCols=[f"{n}_filled" for n in names], outputCol="filled").transform(rows)
    rows = spread(stage(rows.select("y", "features", "filled"), "learn"))
    model = sparse_boosting.fit_sparse_boosting(rows, "y", rounds=10, max_depth=2, rate=0.5, columns=0.75)
    plain = models.boosted("y", "filled", maxIter=10, maxDepth=2, stepSize=0.5).fit(rows)
    both = plain.setPredictionCol("plain").transform(model.transform(rows, "own"))
    # The first tree again: its leaves hold the shrunken mean of what the base leaves over.
    node = F.get(model.leaves(vector_to_array("features"), rounds=1), F.lit(0))
    first = rows.select("y", node.alias("node")).groupBy("node").agg(F.count("*").alias("n"), (0.5 * F.sum(F.col("y") - F.lit(model.base)) / (F.count("*") + 1.0)).alias("value"))
    off = F.abs(F.col("value") - F.get(steps.folded_array(model.value, "double"), F.col("node"))) > 1e-6
    first = first.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0).cast("long")).alias("n_off"))
    better = both.agg((F.avg(F.abs(F.col("y") - F.col("own"))) < F.avg(F.abs(F.col("y") - F.col("plain")))).alias("better"))
    return first.crossJoin(F.broadcast(better)).withColumn("base", F.round(F.lit(model.base), 3))


@query
def feature_model_round_trip(spark, sf):
    """The feature matrix by a model that was fitted, saved as a pipeline stage, and read again."""
    season = fx.season_wide(spark, sf)
    path = staged_path(spark, "feature-model")
    shaped = stage(plan.shape(plan.clean(season, SEASON), SEASON, drop=True), "shaped")  # read by the fits and by the transformation
    PipelineModel([saved.FeatureEstimator(cfg=SEASON).fit_shaped(shaped)]).write().overwrite().save(path)
    fitted = PipelineModel.load(path).stages[0].fitted
    return rounded(fitted.transform(shaped, drop_outliers=True).long(), 3)


@query
def label_vectors(spark, sf):
    """Rows per entry of an encoder of orders and flags that was fitted on earlier lines, saved in a pipeline, read again, and given all lines."""
    lines = fx.table(spark, sf, "lineitem").select(
        "l_shipdate", F.col("l_orderkey").cast("string").alias("order"), F.when(F.col("l_quantity") <= 45, F.col("l_returnflag")).alias("flag"))
    path = staged_path(spark, "label-vectors")
    fitted = vectors.LabelVectorizer(inputCols=["order", "flag"]).fit(lines.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")))
    PipelineModel([fitted]).write().overwrite().save(path)
    model = PipelineModel.load(path).stages[0]
    hits = model.transform(lines).select(F.explode(F.unwrap_udt("dummies")["indices"]).alias("entry")).groupBy("entry").agg(F.count("*").alias("rows"))
    return hits.join(model.names(), "entry").select(F.col("entry").cast("long").alias("entry"), "feature", "rows")
