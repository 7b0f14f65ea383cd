"""Mixing sources to target weights: budgets down a domain, language, source tree, and each leaf's prefix of seeded epochs.

All of it is DataFrame work. A leaf's order within an epoch is that of a seeded hash, and the place where its prefix ends is found
by descending that hash two digits at a time: sums per leading digits, then only the rows under the digits where the budget ends.
No task sees more of one leaf than 256 sums or the rows of one four-digit bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: The tree's levels, root first.
TREE = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves that may be broadcast (at most about 200 bytes each); more are joined by a shuffle.
BROADCAST_LEAVES = 50_000

#: Production weights: whole numbers, taken in proportion among siblings; others get the default.
DOMAINS = ("web", "forum", "books", "reference")
DOMAIN_WEIGHTS = {"web": 40, "forum": 15, "books": 25, "reference": 20}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
DEFAULT_WEIGHT = 5
EPOCHS = 3
#: The budget as a part of all tokens.
PART_OF_TOKENS = (1, 2)


def domain_of(source: Column) -> Column:
    """The domain that a source's number stands for; sources without a number are ``other``."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(F.element_at(names, (F.coalesce(number.try_cast("long"), F.lit(0)) % len(DOMAINS) + 1).cast("int")))


def placed(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """``docs`` with the tree's columns; nulls are ``unknown``."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    source, lang = known(F.col("source")), known(F.col("lang"))
    return docs.withColumns({"mix_domain": domain_of(F.col("source")) if domain is None else known(domain), "mix_lang": lang, "mix_source": source})


def weights_of(column: Column, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default)).cast("long")


def shared_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``children`` (``capacity, weight`` and the parent's ``budget``) with each child's own ``share``; whole numbers throughout.

    Children that cannot take their part in proportion to weight are filled, and what they leave goes to their siblings in
    proportion, until none is overfull; only what all siblings together cannot take stays with the parent. Rounding goes by running
    sums, so shares add up to the budget, or to the capacity where that is less.
    """
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = children.withColumns({
        "_filled": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "_weight": F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    rows = rows.withColumn("_full", F.col("capacity") * F.col("_weight") <= (F.col("budget") - F.col("_filled")) * F.col("weight"))
    rows = rows.withColumns({"_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by),
                             "_all": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by),
                             "_run": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    part = F.expr("(_rest * _run) div _all - (_rest * (_run - weight)) div _all")
    return rows.withColumn("share", F.when(F.col("_full"), F.col("capacity")).otherwise(part)).drop("_filled", "_weight", "_full", "_rest", "_all", "_run")


def budgets(leaves: DataFrame, budget: int, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, default: int = DEFAULT_WEIGHT) -> DataFrame:
    """Leaves (the tree's columns, ``tokens``) with ``target``: the tokens each is to give, at most ``epochs`` times what it has.

    The budget goes down the tree; a shortage is shared among siblings first and passes up only where all of them are full. Products
    of tokens and summed weights must stay below 2^63, else the sum fails rather than wraps.
    """
    weights = weights if weights is not None else {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    columns = [f"mix_{level}" for level in TREE]
    level = None
    for depth, name in enumerate(TREE):
        here = columns[:depth + 1]
        nodes = leaves.groupBy(*here).agg((F.sum("tokens") * epochs).alias("capacity")).filter("capacity > 0")
        nodes = nodes.withColumn("weight", weights_of(F.col(columns[depth]), weights.get(name, {}), default))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if level is None else nodes.join(level.withColumnRenamed("share", "budget"), columns[:depth])
        # The root has one window: its rows are the tree's top names.
        level = shared_out(nodes, columns[:depth], columns[depth]).select(*here, "share")
    return leaves.join(level.withColumnRenamed("share", "target"), columns).filter("target > 0")


def _hash(seed: int, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(key).cast("string")))


def cut_points(rows: DataFrame, plan: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """``plan`` with ``full`` (whole epochs) and ``cut``: the last hash that the next epoch's prefix takes, null if none.

    ``rows`` has ``key``, the tree's columns and ``tokens``. Rows that share a key go together.
    """
    leaf = [f"mix_{level}" for level in TREE]
    plan = plan.select(*leaf, "tokens", "target", F.expr("target div tokens").alias("full"), F.expr("target % tokens").alias("rest"))
    held = rows.join(_sized(plan.filter("rest > 0").select(*leaf, "full", "rest")), leaf)
    held = held.withColumn("hash", _hash(seed, F.col("full"), key)).select(*leaf, "rest", "hash", "tokens")
    four = stage(held.groupBy(*leaf, "rest", F.substring("hash", 1, 4).alias("four")).agg(F.sum("tokens").alias("tokens")), "sums")

    def ends(sums: DataFrame, digits: str) -> DataFrame:
        """Per leaf the bucket in which the budget runs out and what is left for it."""
        run = Window.partitionBy(*leaf).orderBy(digits).rowsBetween(Window.unboundedPreceding, 0)
        return sums.withColumn("upto", F.sum("tokens").over(run)).filter("upto > rest").groupBy(*leaf).agg(
            F.min(digits).alias(digits), F.min_by(F.col("rest") - F.col("upto") + F.col("tokens"), F.col(digits)).alias("rest"))

    two = four.groupBy(*leaf, "rest", F.substring("four", 1, 2).alias("two")).agg(F.sum("tokens").alias("tokens"))
    two = stage(ends(two, "two"), "two")
    inner = four.drop("rest").withColumn("two", F.substring("four", 1, 2)).join(two, [*leaf, "two"])
    last = stage(ends(inner, "four"), "four")
    final = held.drop("rest").withColumn("four", F.substring("hash", 1, 4)).join(_sized(last), [*leaf, "four"])
    final = final.groupBy(*leaf, "rest", "hash").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*leaf).orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = final.withColumn("upto", F.sum("tokens").over(run)).filter("upto <= rest").groupBy(*leaf).agg(F.max("hash").alias("inside"))
    # Nothing of the last bucket fits: the prefix ends where the bucket begins.
    points = last.select(*leaf, "four").join(inside, leaf, "left").withColumn("cut", F.coalesce("inside", "four"))
    return stage(plan.join(points.select(*leaf, "cut"), leaf, "left"), "plan")


def _sized(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def weighed(docs: DataFrame) -> DataFrame:
    """``doc_id``, the tree's columns and ``tokens`` (words between blanks) of documents that have any and have an id."""
    light = placed(docs).select("doc_id", *[f"mix_{level}" for level in TREE], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    return stage(light.filter("tokens > 0 and doc_id is not null"), "weighed")


def mixture_plan(light: DataFrame, part: tuple[int, int] = PART_OF_TOKENS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    leaf = [f"mix_{level}" for level in TREE]
    leaves = stage(light.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "leaves")
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * part[0] // part[1]
    return cut_points(light, stage(budgets(leaves, budget, epochs), "budgets"), seed)


def chosen(rows: DataFrame, plan: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """``rows`` (with the tree's columns) once for each epoch that takes them, with ``epoch`` from 0."""
    leaf = [f"mix_{level}" for level in TREE]
    rows = rows.join(_sized(plan.select(*leaf, "full", "cut")), leaf)
    # Hashes have 32 digits; a cut of four is below every hash of its bucket.
    more = F.when(F.col("cut").isNotNull() & (_hash(seed, F.col("full"), key) <= F.col("cut")), 1).otherwise(0)
    rows = rows.withColumn("mix_times", (F.col("full") + more).cast("int")).filter("mix_times > 0")
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1))).drop("mix_times", "full", "cut")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, epoch``: a row for each time a document of ``docs`` is in the mixture.

    ``docs`` needs ``doc_id, text, lang, source``. Tokens are words between blanks. Half of all tokens are dealt down the tree by
    weight; a leaf that has too little repeats in further epochs, each in an order of its own, up to three. Within the last epoch of
    a leaf the documents of its seeded order are taken while their running sum stays within what is left.

    Null and empty texts and null ids take no part. Null languages and sources are ``unknown``. Rows that repeat an id in a leaf have
    the same hash and go together. Other columns are ignored, also such as are called like the result's. No rows give none.
    """
    light = weighed(docs)
    names = {f"mix_{level}": level for level in TREE}
    return chosen(light, mixture_plan(light, seed=seed), seed).withColumnsRenamed(names).select("doc_id", *TREE, "tokens", "epoch")
