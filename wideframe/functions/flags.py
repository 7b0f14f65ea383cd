"""Existence flags, slot-family totals, label clean-up and date labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.functions.arrays import bound
from wideframe.operators.columns import quoted

# Lower-case spellings that mean "no value" in label columns.
NULL_LABELS = ("", "none", "nan", "null")

# The date spellings that count as a date; any other text stays text.
DATE_FORMATS = (
    "yyyy-M-d",
    "yyyy-M-d H:m:s",
    "yyyy-M-d'T'H:m:s",
    "M/d/yyyy",
    "M/d/yyyy H:m:s",
    "M/d/yyyy h:m:s a",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
)

# Further spellings, as databases print dates, and what each is read as; two-digit years are of this century.
# Parts of seconds and zones fall away: the day is the one that is written.
DATE_SPELLINGS = (
    (r"(:\d{1,2})\.\d+", "$1"),
    (r"(:\d{1,2}) ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$", "$1"),
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"),
    (r"^(\d{4}-\d{1,2}-\d{1,2}) ?[ T]\d{1,2}:\d{1,2}$", "$1"),
    (r"^(\d{1,2}/\d{1,2})/(\d{2})( .*)?$", "$1/20$2"),
    (r"^([A-Za-z]{3}) +(\d{1,2}),? +(\d{4})(?: +\d{1,2}:.*)?$", "$1 $2, $3"),
)
DATE_SPELLING = r"\d[/.:]\d|[zZ]$|[+-]\d{2}:?\d{2}$|^[A-Za-z]{3} +\d{1,2},? +\d{4}"

DAYS_PER_LABEL = 14


def exists_flags(df: DataFrame, flags: Mapping[str, Sequence[str]], drop: bool = True) -> DataFrame:
    """For every flag ``name``, add ``name_exists``: all of its columns that are present hold a value.

    A flag whose columns are all absent adds nothing. All flags are one projection.
    """
    made, used = [], set()
    for name, cols in flags.items():
        present = [c for c in cols if c in df.columns]
        if present:
            made.append(reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in present]).alias(f"{name}_exists"))
            used.update(present)
    kept = [quoted(c) for c in df.columns if not (drop and c in used)]
    return df.select(*kept, *made)


@dataclass(frozen=True)
class Family:
    """A repeated group flattened into numbered columns."""

    name: str
    rates: Sequence[str] = ()
    products: Sequence[str] = ()
    dates: Sequence[str] = ()
    methods: Sequence[str] = ()
    extras: Sequence[str] = ()
    allow_repeat: bool = False

    def columns(self) -> list[str]:
        return [*self.rates, *self.products, *self.dates, *self.methods, *self.extras]

    def totals(self, present: Iterable[str]) -> list[Column]:
        """Total of the rates (nulls count as zero) and number of slots with a product."""
        here = set(present)

        def listed(cols: Sequence[str]) -> list[str]:
            cols = [c for c in cols if c in here]
            return cols if self.allow_repeat else list(dict.fromkeys(cols))

        rates, products = listed(self.rates), listed(self.products)
        made = []
        if rates:
            total = reduce(lambda a, b: a + b, [F.coalesce(quoted(c), F.lit(0.0)) for c in rates])
            made.append(total.alias(f"{self.name}_TotalRate"))
        if products:
            filled = reduce(lambda a, b: a + b, [quoted(c).isNotNull().cast("int") for c in products])
            made.append(filled.alias(f"{self.name}_Count"))
        return made


def slot_totals(df: DataFrame, families: Sequence[Family], drop: bool = True) -> DataFrame:
    """Collapse every slot family into a total and a count; all families are one projection."""
    used = {c for f in families for c in f.columns()} if drop else set()
    kept = [quoted(c) for c in df.columns if c not in used]
    return df.select(*kept, *[t for f in families for t in f.totals(df.columns)])


# What one run of a date-format letter can look like in text.
FORMAT_SHAPES = {"yyyy": r"\d{4}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "a": "[AaPp][Mm]"}


def format_shape(fmt: str) -> str:
    """Regex that every text in a date format fits."""
    runs = re.finditer(r"'([^']*)'|([A-Za-z])\2*|[^A-Za-z']+", fmt)
    made = []
    for run in runs:
        text = run.group(0)
        if text.startswith("'"):
            made.append(re.escape(run.group(1)))
        elif run.group(2):
            made.append(FORMAT_SHAPES.get(text, r"\d{1,2}"))
        else:
            made.append(re.escape(text))
    return "^" + "".join(made) + "$"


def parsed_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp of a date in one of the formats, else null.

    A text is only parsed with a format whose shape it has: a failed parse is an exception in the
    engine and costs far more than a regex. What then is no date is looked at in ``DATE_SPELLINGS``. Which reading a text has
    is found once, not once per format, and a text without one is tried with no format.
    """
    shape = "|".join(f"(?:{format_shape(f)})" for f in formats)
    plain = text
    for pattern, reading in DATE_SPELLINGS:
        plain = F.regexp_replace(plain, pattern, reading)
    known = F.when(text.rlike(shape), text).when(text.rlike(DATE_SPELLING), plain)
    return bound(known, lambda k: F.when(k.isNotNull(), F.coalesce(
        *[F.when(k.rlike(format_shape(f)), F.try_to_timestamp(k, F.lit(f))) for f in formats])))


def biweek(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Two-week label of a date in text form.

    A date gives the number of its two weeks in the year, other text is kept between underscores,
    digits alone are text, empty text stays empty and null stays null.
    """
    parsed = F.when(~text.rlike(r"^\s*\d+\s*$"), parsed_date(F.trim(text), formats))
    label = F.ceil(F.dayofyear(parsed) / F.lit(DAYS_PER_LABEL)).cast("string")
    other = F.when(text == "", text).otherwise(F.concat(F.lit("_"), text, F.lit("_")))
    return F.coalesce(label, other)


def biweek_columns(df: DataFrame, cols: Sequence[str], drop: bool = True,
                   formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Add ``<col>_biweek`` for each date column.

    The columns go through one expression as an array: a copy of all formats per column would make
    more generated code than the parsing is worth.
    """
    kept = [quoted(c) for c in df.columns if not (drop and c in cols)]
    if not cols:
        return df.select(*kept)
    labels = F.transform(F.array(*[quoted(c).cast("string") for c in cols]), lambda d: biweek(d, formats))
    return df.select(*kept, labels.alias("__labels")).select(
        *kept, *[F.get("__labels", F.lit(i)).alias(f"{c}_biweek") for i, c in enumerate(cols)])


def normalized_label(value: Column, nulls: Sequence[str] = NULL_LABELS) -> Column:
    text = F.lower(value.cast("string"))
    return F.when(~text.isin(*nulls), text)


def normalize_labels(df: DataFrame, cols: Sequence[str], nulls: Sequence[str] = NULL_LABELS) -> DataFrame:
    """Lower-case text labels with the spellings of "no value" turned into null."""
    wanted = set(cols)
    return df.select(*[normalized_label(quoted(c), nulls).alias(c) if c in wanted else quoted(c)
                       for c in df.columns])


def positive_delta(earlier: Column, later: Column, conditional: bool = True) -> Column:
    """``later - earlier``; in the conditional form only where it is above zero, else null."""
    return F.when(later > earlier, later - earlier) if conditional else later - earlier


def prev_delta(df: DataFrame, pairs: Mapping[str, tuple[str, str]], conditional: bool = True,
               drop: bool = True) -> DataFrame:
    """Add one delta per ``{new name: (earlier column, later column)}``; pairs not present are skipped."""
    here = {n: p for n, p in pairs.items() if p[0] in df.columns and p[1] in df.columns}
    used = {c for p in here.values() for c in p} if drop else set()
    made = [positive_delta(quoted(a), quoted(b), conditional).alias(n) for n, (a, b) in here.items()]
    return df.select(*[quoted(c) for c in df.columns if c not in used], *made)
