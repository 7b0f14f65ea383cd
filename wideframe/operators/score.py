"""One score report for every use: whole table, per unit, pooled folds, hold-out rows, baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wideframe.operators.categories import source_of
from wideframe.operators.quantiles import SMALL, exact_quantiles, group_quantiles
from wideframe.operators.ranks import null_safe_join

PROBS = {"abs_median": 0.5, "abs_p90": 0.9, "abs_p95": 0.95, "abs_p99": 0.99}


def _errors(df: DataFrame, y: str, pred: str, by: Sequence[str]) -> DataFrame:
    actual, guess = F.col(y).cast("double"), F.col(pred).cast("double")
    err = F.abs(actual - guess)
    return df.select(*by, actual.alias("y"), err.alias("err"), (F.try_divide(err, actual) * 100).alias("pct"))


def _moments() -> list[Column]:
    mean, sd = F.avg("err"), F.stddev_pop("err")
    squares = F.avg(F.col("err") * F.col("err"))
    return [
        F.count("err").alias("n_samples"), squares.alias("sq_mean"),
        (F.lit(1.0) - F.try_divide(squares, F.var_pop("y"))).alias("r2"),
        mean.alias("abs_mean"), sd.alias("abs_std"), F.max("err").alias("abs_max"),
        (mean + 3 * sd).alias("abs_std_3"),
        F.avg("pct").alias("percent_mean"), F.stddev_pop("pct").alias("percent_std"), F.max("pct").alias("percent_max"),
    ]


def with_quantiles(rows: DataFrame, by: Sequence[str], aggregates: Sequence[Column], value: str,
                   probs: Mapping[str, float], small: int = SMALL) -> DataFrame:
    """``aggregates`` per group plus exact quantiles of ``value``.

    When the largest group fits one task everything is one aggregation. Otherwise the quantiles are
    found by ``quantiles``'s bracketing and joined to the plain aggregates.
    """
    names, wanted = list(probs), list(probs.values())
    if not by:
        found = exact_quantiles(rows, [value], wanted, small)[value]
        return rows.agg(*aggregates).select("*", *[F.lit(v).cast("double").alias(n) for n, v in zip(names, found)])
    peak = rows.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if peak <= small:
        percentages = F.array(*[F.lit(p) for p in wanted])
        summed = rows.groupBy(*by).agg(*aggregates, F.percentile(value, percentages).alias("quantiles"))
    else:
        summed = null_safe_join(rows.groupBy(*by).agg(*aggregates),
                                group_quantiles(rows, by, value, wanted, small), by, "left")
    plain = [c for c in summed.columns if c != "quantiles"]
    return summed.select(*plain, *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(names)])


def score(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """Squared error, R², absolute and percent error statistics, one row per group.

    R² is one minus the ratio of squared error to label variance; deviations are population ones. A
    zero label has no percent error and is left out of the percent statistics.
    """
    return with_quantiles(_errors(df, y, pred, by), by, _moments(), "err", PROBS, small)


def score_table(scores: DataFrame) -> DataFrame:
    """The report's columns with the mean + 2 sd and mean + 3 sd bounds."""
    keys = [c for c in scores.columns if c in _leading_keys(scores)]
    return scores.select(
        *keys, "r2", "sq_mean", "abs_mean", "abs_std", "abs_max",
        (F.col("abs_mean") + 2 * F.col("abs_std")).alias("abs_2std_95"),
        (F.col("abs_mean") + 3 * F.col("abs_std")).alias("abs_3std_99"),
        "percent_mean", "percent_std", "percent_max",
        (F.col("percent_mean") + 2 * F.col("percent_std")).alias("percent_2std_95"),
        (F.col("percent_mean") + 3 * F.col("percent_std")).alias("percent_3std_99"))


def _leading_keys(scores: DataFrame) -> list[str]:
    return scores.columns[:scores.columns.index("n_samples")]


def score_pooled(frames: Sequence[DataFrame], y: str = "y", pred: str = "pred") -> DataFrame:
    """Score the predictions of many folds together; fold scores are never averaged."""
    return score(stack_units([f.select(y, pred) for f in frames]), y, pred)


def stack_units(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null there."""
    whole, *rest = frames
    for frame in rest:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def abs_std_loss(df: DataFrame, y: str = "y", pred: str = "pred", n: float = 3, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error plus ``n`` population deviations."""
    return _errors(df, y, pred, by).groupBy(*by).agg((F.avg("err") + n * F.stddev_pop("err")).alias("loss"))


def holdout_stats(df: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (),
                  small: int = SMALL) -> DataFrame:
    """Mean and 95th percentile of the absolute and of the percent error."""
    rows = _errors(df, y, pred, by)
    means = [F.avg("err").alias("abs_mean"), F.avg("pct").alias("percent_mean")]
    peak = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if by and peak <= small:
        return rows.groupBy(*by).agg(means[0], F.percentile("err", F.lit(0.95)).alias("abs_p95"), means[1], F.percentile("pct", F.lit(0.95)).alias("percent_p95"))
    absolute = with_quantiles(rows, by, means[:1], "err", {"abs_p95": 0.95}, small)
    percent = with_quantiles(rows, by, means[1:], "pct", {"percent_p95": 0.95}, small)
    if by:
        return null_safe_join(absolute, percent, by)
    return absolute.select("*", *[F.lit(v).alias(k) for k, v in percent.first().asDict().items()])


def baseline_score(train: DataFrame, test: DataFrame, y: str = "y", mean_from: str = "train",
                   by: Sequence[str] = ()) -> DataFrame:
    """Score of always predicting the mean label of the ``train`` rows, the ``test`` rows or ``all`` rows."""
    source = {"train": lambda: train, "test": lambda: test, "all": lambda: train.select(y).unionByName(test.select(y))}
    mean = source[mean_from]().agg(F.avg(y)).first()[0]
    return score(test.withColumn("__guess", F.lit(mean).cast("double")), y, "__guess", by)


def baseline_folds(df: DataFrame, fold: str, y: str = "y") -> DataFrame:
    """Baseline per fold: every fold is scored with the mean of all other folds' rows.

    The means come from one total per fold, so the table is read once for all folds.
    """
    totals = df.groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("n")).collect()  # one row per fold
    s, n = sum(r["s"] or 0.0 for r in totals), sum(r["n"] for r in totals)
    means = {r[fold]: (s - (r["s"] or 0.0)) / (n - r["n"]) for r in totals if n > r["n"]}
    guess = F.create_map(*[F.lit(x) for k, v in means.items() for x in (k, v)])[F.col(fold)] if means else F.lit(None)
    return score(df.withColumn("__guess", guess), y, "__guess", by=[fold])


def cv_summary(results: DataFrame, params: Sequence[str], score_col: str = "score", iteration: str | None = None,
               attrs: Sequence[str] = ()) -> DataFrame:
    """Mean score and mean attributes per parameter set; the best iteration is the rounded mean
    (halves to even)."""
    means = [F.avg(score_col).alias(score_col)] + [F.avg(a).alias(a) for a in attrs]
    if iteration:
        means.append(F.bround(F.avg(iteration)).cast("int").alias("best_iteration"))
    return results.groupBy(*params).agg(*means)


def best_params(summary: DataFrame, by: str = "score", ties: Sequence[str] = ()) -> DataFrame:
    """The parameter set with the lowest mean score."""
    return summary.orderBy(F.col(by).asc_nulls_last(), *ties).limit(1)


def importance_by_source(importance: DataFrame, by: Sequence[str] = (), feature: str = "feature",
                         weight: str = "weight") -> DataFrame:
    """Importance per source column: the dummies of a column are added up."""
    return importance.groupBy(*by, source_of(F.col(feature)).alias(feature)).agg(F.sum(weight).alias(weight))


def merge_importance(frames: Sequence[DataFrame], feature: str = "feature", weight: str = "weight") -> DataFrame:
    """Sum over folds; a feature missing from a fold counts as zero there."""
    return stack_units(frames).groupBy(feature).agg(F.sum(F.coalesce(weight, F.lit(0))).alias(weight))


def stop_epoch(trace: DataFrame, tol: float, min_epochs: int, run: str = "run", epoch: str = "epoch",
               score_col: str = "score") -> DataFrame:
    """Per run, the first epoch whose gain over the one before is below ``tol``, not earlier than the
    ``min_epochs``-th, and the score of the last epoch kept.

    Epochs count by their place in the run, from 1, whatever numbers they carry: traces may begin at any
    number and leave some out. A run has as many rows as epochs, which one task orders.
    """
    order = Window.partitionBy(run).orderBy("__e")
    steps = trace.select(run, F.col(epoch).alias("__e"), F.col(score_col).alias("__s")).select(
        run, "__s", F.row_number().over(order).alias("__at"), F.lag("__s").over(order).alias("__p"))
    stops = F.col("__p").isNotNull() & (F.col("__p") - F.col("__s") < tol) & (F.col("__at") >= min_epochs)
    found = steps.groupBy(run).agg(
        F.min(F.when(stops, F.col("__at"))).alias("stop_epoch"), F.max("__at").alias("__last"),
        F.min_by("__p", F.when(stops, F.col("__at"))).alias("__before"), F.max_by("__s", "__at").alias("__final"))
    stopped = F.col("stop_epoch").isNotNull()
    return found.select(
        run, F.col("stop_epoch").cast("long").alias("stop_epoch"),
        F.when(stopped, F.col("stop_epoch") - 1).otherwise(F.col("__last")).cast("long").alias("kept_epochs"),
        F.when(stopped, F.col("__before")).otherwise(F.col("__final")).alias("score"))
