"""Benchmark questions in documents, also with other numbers, names or units: template windows and consistent slots.

All of it is DataFrame work. Numbers, units and names become typed placeholders that carry their value; the template of a token
is its placeholder without the value. Windows of template tokens are hashed and joined with those of the benchmark, and for the
few documents with a hit the values behind the placeholders are compared, run by run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

WINDOW = 8
#: So many windows one after another make an occurrence (13 tokens); shorter items need all of theirs.
RUN = 6
#: A window with a smaller share of words that are no placeholders counts only with the item's own values.
LITERAL = 0.5
#: Rows of the benchmark's window table that may be broadcast (about 500 bytes each in memory, 25 MB); more are joined by a shuffle.
BROADCAST_WINDOWS = 50_000
BROADCAST_IDS = 500_000

#: Fixed strings: units that count as such behind a number.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months",
         "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent", "degrees", "meters", "metres", "liters", "litres")
SIGNS = ("%", "€", "$")
#: What a token is: a number with inner points and commas, a word, or a sign. Repetitions are possessive, which Java runs as loops of any length.
TOKEN = r"[\x03\x04]?+[\p{L}\p{M}]++|[0-9]++(?:[.,:][0-9]++)*+|[%€$]"

#: Readings of a text: names are capitalised words that something joins to the text before them; no names and no case, for copies in
#: capitals or small letters; every capitalised word a name, for names at the start of a sentence. Names joined by a blank are one.
CONTEXT, PLAIN, CAPITAL = 0, 1, 2
FORMS = (CONTEXT, PLAIN, CAPITAL)

# Marks in the coded form of a text: before every token, and on capitalised words behind a letter and a blank, behind a comma or semicolon and
# a blank, and elsewhere.
_TOKEN, _JOINED, _LISTED, _CAPITAL = "\x02", "\x03", "\x04", "\x05"


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def with_forms(df: DataFrame, values: bool) -> DataFrame:
    """``df`` with its tokens in each form, ``form0`` to ``form2``, in place of ``text``: words in small letters, and placeholders.

    These are ``«n``, ``«u`` and ``«e``, with ``values`` also what they stand for, as in ``«n:12``. Tokens are coded as one string, on which names,
    numbers and units are replaced, and which is then split; that is some times faster than a function for each token.
    """
    others = [c for c in df.columns if c != "text"]
    units = "|".join([*UNITS, "%", "€", r"\$"])
    kept = (lambda k: f":${k}") if values else (lambda k: "")
    marked = _replaced(F.col("text"), (r"[\x01-\x05]", " "), (r" (?<=[\p{L}\p{M}] )(?=\p{Lu})", f" {_JOINED}"), (r"[,;] (?=\p{Lu})", f" {_LISTED}"))
    coded = F.concat(F.lit(_TOKEN), F.array_join(F.regexp_extract_all(marked, F.lit(TOKEN), F.lit(0)), _TOKEN))
    coded = F.lower(_replaced(coded, (r"\x02(?=\p{Lu})", _TOKEN + _CAPITAL)))
    coded = _replaced(coded, (rf"\x02([0-9][^\x02]*+)\x02[\x03-\x05]?+({units})(?=\x02|$)", f"{_TOKEN}«n{kept(1)}{_TOKEN}«u{kept(2)}"),
                      (r"\x02([0-9][^\x02]*+)", f"{_TOKEN}«n{kept(1)}"), (r"\x02[%€$](?=\x02|$)", ""))
    coded = df.select(*others, coded.alias("coded"))

    def form(names: str) -> Column:
        out = F.col("coded")
        if names:
            # A name goes on over blanks. Once each has its placeholder, no other token is marked as joined.
            out = F.replace(_replaced(out, (rf"[{names}][^\x02]*+(?:\x02\x03[^\x02]*+)*+", "«e" + kept(0))), F.lit(_TOKEN + _JOINED), F.lit(" "))
        for mark in (_JOINED, _LISTED, _CAPITAL):
            out = F.replace(out, F.lit(mark), F.lit(""))
        return F.substring(out, 2, 2**31 - 1)

    names = {CONTEXT: r"\x03\x04", PLAIN: "", CAPITAL: r"\x03-\x05"}
    whole = coded.select(*others, *[form(names[f]).alias(f"form{f}") for f in FORMS])
    none = F.array().cast("array<string>")
    return whole.select(*others, *[F.when(F.col(f"form{f}") != "", F.split(f"form{f}", _TOKEN)).otherwise(none).alias(f"form{f}") for f in FORMS])


def template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit("«")), F.substring(w, 1, 2)).otherwise(w))


def _windows(words: str | Column, size: int, step: int = 1) -> Column:
    """The hash of the windows of ``size`` template tokens at every ``step``-th place from 0; none if there are fewer tokens."""
    count = F.size(words) - size + 1
    each = F.transform(F.sequence(F.lit(1), count, F.lit(step)), lambda i: F.xxhash64(F.lit(size), F.slice(words, i, size)))
    return F.when(count > 0, each).otherwise(F.array().cast("array<bigint>"))


def _literal(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~F.startswith(w, F.lit("«"))))


def _read(table: DataFrame, key: str) -> DataFrame:
    """``key, form, words, template``, a row per form."""
    rows = table.select(F.col(key).cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.col(key).isNotNull())
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f"form{f}").alias("words")) for f in FORMS])).alias("r")
    return with_forms(rows, True).select(key, forms).select(key, "r.*").withColumn("template", template(F.col("words")))


def occurrences(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, form, shift, at, exact``: the runs of windows of a benchmark item that a document has, with its own or other values.

    Item and document are compared in each of the ``FORMS``. ``shift`` is the place of the item's first token among the document's, a run is
    ``RUN`` windows one after another from the item's window ``at`` on, or all windows of a shorter item. Within a run one value of the item stands
    for one value of the document, by type of placeholder; windows that are mostly placeholders have the item's own values. ``exact``
    says that all values of the run are the item's own. What else the document holds has no say.

    Null texts and items without tokens have no runs. Null ids take no part. Rows that repeat an id are searched each; equal runs
    count once. Texts of any length are read whole. Either table may be empty.
    """
    items = stage(_read(benchmark, "item_id").filter("size(words) > 0").distinct().withColumn("size", F.least(F.size("words"), F.lit(WINDOW))), "items")
    items = items.withColumn("of", F.size("words") - F.col("size") + 1).withColumn("step", F.when(F.col("of") >= RUN, RUN).otherwise(1))
    kinds_of = sorted((r["size"], r["step"]) for r in items.select("size", "step").distinct().collect())  # at most WINDOW + 1 pairs
    if not kinds_of:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, form int, shift int, at int, exact boolean")

    def of_size(make) -> Column:
        return reduce(lambda rest, size: F.when(F.col("size") == size, make(size)).otherwise(rest), sorted({s for s, _ in kinds_of}), F.array().cast("array<bigint>"))

    windows = items.select("item_id", "form", "size", "of", "step", "words", "template", F.posexplode(of_size(lambda s: _windows("template", s))).alias("at", "hash"))
    windows = stage(windows.select("item_id", "form", "size", "of", "step", "at", "hash", F.slice("words", F.col("at") + 1, F.col("size")).alias("item_words"),
                                   F.slice("template", F.col("at") + 1, F.col("size")).alias("item_template")), "windows")
    number = windows.count()
    sized = lambda df: F.broadcast(df) if number <= BROADCAST_WINDOWS else df

    # Candidates. Of RUN windows one after another one lies at a multiple of RUN, so of items with so many a document's windows there are
    # enough to find every document that has a run; shorter items take all places.
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    read = with_forms(docs, False)
    hashes = F.concat(*[_windows(f"form{f}", size, step) for f in FORMS for size, step in kinds_of])
    known = windows.select("hash").distinct()
    found = stage(read.select("doc_id", F.explode(hashes).alias("hash")).join(sized(known), "hash", "left_semi").select("doc_id").distinct(), "found")
    ids = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    few = _read(docs.join(ids, "doc_id", "left_semi").distinct(), "doc_id")
    place = lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.struct(
        (i - 1).alias("place"), F.xxhash64(F.lit(size), F.slice("template", i, size)).alias("hash"), F.slice("words", i, size).alias("words")))
    empty = F.array().cast("array<struct<place:int,hash:bigint,words:array<string>>>")
    here = F.concat(*[F.when(F.size("words") >= size, place(size)).otherwise(empty) for size in sorted({s for s, _ in kinds_of})])
    few = stage(few.select("doc_id", "form", F.explode(here).alias("w")).select("doc_id", "form", "w.place", "w.hash", F.col("w.words").alias("doc_words"))
                .join(sized(windows.select("item_id", "form", "size", "of", "at", "hash", "item_words", "item_template")), ["form", "hash"]), "few")
    hits = few.filter(F.col("item_template") == template(F.col("doc_words"))).select(
        "doc_id", "item_id", "form", (F.col("place") - F.col("at")).alias("shift"), "at", "size", F.least("of", F.lit(RUN)).alias("run"), "item_words", "doc_words",
        (F.col("item_words") == F.col("doc_words")).alias("own"), (_literal(F.col("item_words")) >= LITERAL * F.col("size")).alias("literal"))
    hits = stage(hits.filter("own or literal").distinct(), "hits")

    key = ["doc_id", "item_id", "form", "shift"]
    # A run begins at a window that has run - 1 more behind it without a gap.
    ahead = Window.partitionBy(*key).orderBy("at").rowsBetween(0, RUN - 1)
    at = hits.groupBy(*key, "at", "size", "run").agg(F.max("own").alias("own"))
    block = F.collect_list(F.struct("at", "own")).over(ahead)
    runs = at.withColumn("block", F.slice(block, 1, F.col("run"))).filter((F.size("block") == F.col("run")) & (F.col("block")[F.size("block") - 1]["at"] == F.col("at") + F.col("run") - 1))
    runs = runs.select(*key, "at", (F.col("at") + F.col("run") + F.col("size") - 1).alias("stop"), F.forall("block", lambda w: w["own"]).alias("exact"))
    # Two values for one: it is enough to compare each value with the one before it that stands for the same.
    slots = hits.select(*key, "at", F.posexplode(F.arrays_zip("item_words", "doc_words")).alias("k", "w")).filter(F.startswith("w.item_words", F.lit("«")))
    slots = slots.select(*key, (F.col("at") + F.col("k")).alias("p"), F.col("w.item_words").alias("mine"), F.col("w.doc_words").alias("theirs")).distinct()
    back = Window.partitionBy(*key, "mine").orderBy("p")
    odd = slots.withColumn("p0", F.lag("p").over(back)).withColumn("was", F.lag("theirs").over(back)).filter("was <> theirs").select(
        *[F.col(c).alias(f"odd_{c}") for c in key], "p0", "p")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"odd_{c}") for c in key])
    return runs.join(odd, same & (F.col("p0") >= F.col("at")) & (F.col("p") < F.col("stop")), "left_anti").select(*key, "at", "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_items, n_exact, items`` of the documents in which items occur: by one run of windows, in any form.

    ``items`` lists their ids in order, ``n_exact`` counts those that a run has with their own values.
    """
    found = occurrences(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("exact").alias("exact"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum(F.col("exact").cast("long")).alias("n_exact"),
                                       F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda i: i.cast("string")), ",").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, n_exact, items``, a row for each row of ``docs``; documents without an item have zeros and an empty list.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and ``text``; either may be empty. Null texts hold nothing, texts of
    any length are read whole, rows that repeat a ``doc_id`` all say what is in any of them. Other columns are ignored.
    """
    zero = F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long")).join(contaminated(docs, benchmark), "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("items", F.lit("")).alias("items"))
