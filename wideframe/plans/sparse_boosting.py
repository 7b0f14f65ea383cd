"""Boosted trees that learn at every split where missing values go, with a sample of the inputs per tree.

Inputs are binned once. A level of a tree is one aggregation of gradient sums per node, input and bin, a bin of its own holding the missing values; a
split is tried with these on either side, and keeps the better one as its default. The driver holds the model and the sums of one level.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wideframe.functions.arrays import folded_array, running_sums
from wideframe.plans.models import FEATURES, best_iteration
from wideframe.plans.steps import MOST_NODES
from wideframe.session import stage

#: Rounds after which the running predictions are written; between them the trees since then are followed.
ROUNDS = 10
#: Sums (nodes times inputs times bins) that one aggregation returns to the driver, about 60 bytes each.
SUMS = 500_000


@dataclass
class SparseTrees:
    """Nodes of all trees by number: tested input or -1, the last bin and value that go left, whether missing values do, children, and the leaf's addition."""

    base: float
    roots: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tested: list[int] = field(default_factory=list)
    last_bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing_left: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, depth: int) -> int:
        for values, value in ((self.depth, depth), (self.tested, -1), (self.last_bin, -1), (self.cut, 0.0), (self.missing_left, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            values.append(value)
        return len(self.depth) - 1

    def leaves(self, cells: Column, by_bin: bool = False, first: int = 0, rounds: int | None = None) -> Column:
        """The node that a row reaches in each of ``rounds`` trees from ``first`` on, by its bins (0 is missing) or its values (NaN is missing)."""
        roots = self.roots[first:] if rounds is None else self.roots[first:first + rounds]
        low, high = (roots[0] if roots else 0), (self.roots[first + len(roots)] if first + len(roots) < len(self.roots) else len(self.depth))
        part = lambda values, kind: folded_array(values[low:high], kind)
        move = lambda links: [n - low if n >= 0 else -1 for n in links[low:high]]
        tested, missing = part(self.tested, "int"), part(self.missing_left, "int")
        left, right = folded_array(move(self.left), "int"), folded_array(move(self.right), "int")
        cut = part(self.last_bin, "int") if by_bin else part(self.cut, "double")

        def below(n: Column) -> Column:
            cell = F.get(cells, F.get(tested, n))
            gone = (cell == 0) if by_bin else (cell.isNull() | F.isnan(cell))
            goes_left = F.when(gone, F.get(missing, n) == 1).otherwise(cell <= F.get(cut, n))
            return F.when(F.get(tested, n) < 0, n).when(goes_left, F.get(left, n)).otherwise(F.get(right, n))

        at = folded_array([r - low for r in roots], "int") if roots else F.array().cast("array<int>")
        for _ in range(max(self.depth[low:high], default=0)):
            at = F.transform(at, below)
        return F.transform(at, lambda n: n + low)

    def additions(self, cells: Column, by_bin: bool = False, first: int = 0, rounds: int | None = None) -> Column:
        value = folded_array(self.value, "double")
        return F.transform(self.leaves(cells, by_bin, first, rounds), lambda n: F.get(value, n))

    def transform(self, df: DataFrame, prediction: str = "prediction", features: str = FEATURES, rounds: int | None = None) -> DataFrame:
        others = [F.col(f"`{c}`") for c in df.columns if c != prediction]
        rows = df.select(*others, vector_to_array(features).alias("__values"))
        return rows.select(*others, F.aggregate(self.additions(F.col("__values"), rounds=rounds), F.lit(self.base), lambda s, x: s + x).alias(prediction))

    def errors_by_round(self, df: DataFrame, label: str, features: str = FEATURES) -> DataFrame:
        """``round, abs_mean, abs_std, sq_mean`` after each round, from 1: one pass, in which a row's running sums are its predictions. The plan does not grow with the rounds."""
        rows = df.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("v")).filter("y is not null")
        sums = running_sums(self.additions(F.col("v")), len(self.roots), F.lit(self.base))
        off = rows.select("y", F.posexplode(sums).alias("k", "p")).select((F.col("k") + 1).alias("round"), F.abs(F.col("y") - F.col("p")).alias("e"))
        return off.groupBy("round").agg(F.avg("e").alias("abs_mean"), F.stddev_pop("e").alias("abs_std"), F.avg(F.col("e") * F.col("e")).alias("sq_mean"))


def _binned(df: DataFrame, label: str, features: str, bins: int) -> tuple[DataFrame, list[list[float]]]:
    """``b, n, s``: each combination of bins that occurs, a bin per input, with its rows and the sum of their labels; and the upper ends of the bins but the last.

    Bin 0 is a missing value, then 1 and up. Trees see rows by their bins only, so the gradients of such rows add up to ``n`` predictions less ``s``.
    """
    rows = df.select(F.col(label).cast("double").alias("y"), vector_to_array(features).alias("v")).filter("y is not null and not isnan(y)")
    width = rows.select(F.max(F.size("v"))).first()[0] or 0
    points = [k / bins for k in range(1, bins)]
    value = lambda k: F.when(~F.isnan(F.col("v")[k]), F.col("v")[k])
    found = rows.agg(*[F.percentile_approx(value(k), points, 10_000).alias(f"q{k}") for k in range(width)]).first() if width else []
    ends = [sorted(set(q or [])) for q in found]

    def cell(k: int, upper: list[float]) -> Column:
        beyond = F.size(F.filter(folded_array(upper, "double"), lambda end: F.col("v")[k] > end)) if upper else F.lit(0)
        return F.when(F.isnan(F.col("v")[k]) | F.col("v")[k].isNull(), 0).otherwise(1 + beyond)

    cells = [cell(k, upper) for k, upper in enumerate(ends)]
    binned = rows.select("y", F.array(*cells).cast("array<int>").alias("b") if cells else F.array().cast("array<int>").alias("b"))
    return stage(binned.groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "binned"), ends


def fit_sparse_boosting(df: DataFrame, label: str, rounds: int, max_depth: int = 4, rate: float = 0.1, columns: float = 1.0, bins: int = 32, penalty: float = 1.0,
                        least: float = 1.0, seed: int = 7, features: str = FEATURES, validation: DataFrame | None = None, patience: int | None = None) -> SparseTrees:
    """Fit for squared error: ``rounds`` trees of shrinkage ``rate``, each on a share ``columns`` of the inputs, leaves of ``least`` rows and ridge ``penalty``.

    NaN and null inputs are missing. Cuts lie at approximate quantiles (to a ten-thousandth of the rows). With ``validation`` and ``patience`` it ends when
    the mean absolute error there has not fallen for that many rounds, looked at every ``ROUNDS`` rounds, and later trees are dropped. Rows without a label
    are left out; no rows give a model of the base 0 without trees.
    """
    rows, ends = _binned(df, label, features, bins)
    n, total = rows.agg(F.sum("n"), F.sum("s")).first()
    model = SparseTrees(total / n if n else 0.0)
    if not n:
        return model
    rows = rows.withColumn("p", F.lit(model.base))
    written, draw = 0, random.Random(seed)
    trace: list[float] = []
    for number in range(rounds):
        if number - written == ROUNDS:
            rows = stage(rows.select("b", "n", "s", _predicted(model, written).alias("p")), "boosting")
            written = number
            if validation is not None and patience:
                trace = [r["abs_mean"] for r in model.errors_by_round(validation, label, features).orderBy("round").collect()]  # a row per round
                if best_iteration(trace, patience) + patience <= number:
                    break
        some = sorted(draw.sample(range(len(ends)), max(1, round(columns * len(ends))))) if ends else []
        gradient = rows.select("b", "n", (F.col("n") * _predicted(model, written) - F.col("s")).alias("g"))
        model.roots.append(model.add(0))
        _grow(gradient, model, ends, some, max_depth, rate, penalty, least)
        if len(model.depth) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes; use fewer rounds or levels")
    if validation is not None and patience:
        trace = [r["abs_mean"] for r in model.errors_by_round(validation, label, features).orderBy("round").collect()]
        keep = best_iteration(trace, patience) if trace else 0
        end = model.roots[keep] if keep < len(model.roots) else len(model.depth)
        model = SparseTrees(model.base, model.roots[:keep], *[getattr(model, f)[:end] for f in ("depth", "tested", "last_bin", "cut", "missing_left", "left", "right", "value")])
    return model


def _predicted(model: SparseTrees, written: int) -> Column:
    """The running prediction: what is written and the trees since."""
    if written == len(model.roots):
        return F.col("p")
    return F.aggregate(model.additions(F.col("b"), True, written), F.col("p"), lambda s, x: s + x)


def _grow(gradient: DataFrame, model: SparseTrees, ends: Sequence[Sequence[float]], some: Sequence[int], max_depth: int, rate: float, penalty: float, least: float) -> None:
    """The last tree, level by level; gradients ``g`` of the ``n`` rows with bins ``b`` stay the same for all of its levels."""
    tree = len(model.roots) - 1
    level = [model.roots[tree]]
    while level:
        each = max(1, SUMS // max(1, sum(len(ends[k]) + 2 for k in some)))
        after: list[int] = []
        for begin in range(0, len(level), each):
            nodes = level[begin:begin + each]
            here = gradient.select("g", "n", "b", F.get(model.leaves(F.col("b"), True, tree, 1), F.lit(0)).alias("node")).filter(F.col("node").between(nodes[0], nodes[-1]))
            cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col("b")[k].alias("bin")) for k in some], F.struct(F.lit(-1).alias("k"), F.lit(0).alias("bin")))
            sums = here.select("node", "g", "n", F.explode(cells).alias("c")).groupBy("node", "c.k", "c.bin").agg(F.sum("g").alias("g"), F.sum("n").cast("double").alias("h"))
            table: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums.collect():  # SUMS rows at most
                table.setdefault(r["node"], {}).setdefault(r["k"], {})[r["bin"]] = (r["g"], r["h"])
            for node in nodes:
                g, h = table[node].pop(-1)[0]
                model.value[node] = -rate * g / (h + penalty)
                split = _best_split(table[node], g, h, penalty, least) if model.depth[node] < max_depth else None
                if split:
                    _, k, last, missing = split
                    model.tested[node], model.last_bin[node], model.missing_left[node] = k, last, int(missing)
                    model.cut[node] = ends[k][last - 1] if last <= len(ends[k]) else float("inf")
                    model.left[node], model.right[node] = model.add(model.depth[node] + 1), model.add(model.depth[node] + 1)
                    after += [model.left[node], model.right[node]]
        level = after


def _best_split(inputs: Mapping[int, Mapping[int, tuple[float, float]]], g: float, h: float, penalty: float, least: float) -> tuple[float, int, int, bool] | None:
    """``gain, input, last bin to the left, missing to the left`` with the largest gain; the first input and bin on ties.

    Behind the last bin only missing values go on, so a split may also part these from all others.
    """
    best, score = None, lambda g, h: g * g / (h + penalty)
    for k in sorted(inputs):
        cells = dict(inputs[k])
        lost_g, lost_h = cells.pop(0, (0.0, 0.0))
        left_g = left_h = 0.0
        for last in sorted(cells):
            left_g, left_h = left_g + cells[last][0], left_h + cells[last][1]
            for missing in ((False, True) if lost_h else (False,)):
                lg, lh = (left_g + lost_g, left_h + lost_h) if missing else (left_g, left_h)
                if lh >= least and h - lh >= least:
                    gain = score(lg, lh) + score(g - lg, h - lh) - score(g, h)
                    if gain > 1e-12 and (best is None or gain > best[0]):
                        best = (gain, k, last, missing)
    return best
