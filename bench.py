"""Times the headline queries end to end and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from wideframe.catalogue.queries import QUERIES  # noqa: E402
from wideframe.session import local_session, release  # noqa: E402

HEADLINE = ["slot_totals", "biweek", "aligned_window", "outliers", "fill_mean", "spearman", "category_codes", "sparse_long",
            "group_kfold", "score_report", "score_by_unit", "importance_merge", "assemble", "response_fit", "spatial_semi",
            "holdout_assembly", "shape", "feature_matrix", "whatif_best", "nested_cv", "stacking", "decision_paths"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
                                             "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})  # one machine: local is shared
    QUERIES["label_stats"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the executors
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release(spark)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "wide-table headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
