"""The smallest whole path: shape wide rows, assign folds, score the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wideframe.functions.flags import Family, biweek_columns, exists_flags, slot_totals
from wideframe.operators.folds import group_hash_fold
from wideframe.operators.score import baseline_folds

SLOTS = range(1, 8)


def slots_to_baseline(wide: DataFrame, folds: int = 4) -> DataFrame:
    """Predict each order's total quantity by the mean of the other folds' orders."""
    dated = biweek_columns(wide, [f"date{i}" for i in SLOTS])
    flagged = exists_flags(dated, {"Tail": ["prod6", "prod7"]}, drop=False)
    line = Family("Line", rates=[f"rate{i}" for i in SLOTS], products=[f"prod{i}" for i in SLOTS])
    shaped = slot_totals(flagged, [line])
    folded = group_hash_fold(shaped, "o_custkey", folds, seed=1)
    return baseline_folds(folded.filter(F.col("Line_Count") > 0), "fold", y="Line_TotalRate")
