"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints ONE JSON line.  Each query is fully
executed through the ``noop`` sink (no collect).  One warm-up run of the
cheapest query starts the JVM and the file cache; the reported time per
query is the median of ``$BENCH_RUNS`` runs (default 1: the recommender
pipelines take minutes at sf0.1; set 3 for the BASELINE protocol).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from quillon.session import build_session  # noqa: E402
from quillon.plans.registry import queries  # noqa: E402

HEADLINE = {
    "vocab_tfidf": "vocab_tfidf",
    "feature_rows": "feature_rows",
    "neighbour_edges": "neighbour_edges",
    "neighbour_recs": "neighbour_recs",
    "ranking_metrics": "popularity_eval_summary",
    "als_implicit": "als_recs",
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    scratch = tempfile.mkdtemp(prefix="quillon-bench-")
    spark = build_session(f"local[{cpus}]", app="quillon-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g"),
                                 "spark.local.dir": scratch})
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(os.path.join(scratch, "ckpt"))
    Q = queries()
    Q["vocab_tfidf"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    out = {}
    for label, name in HEADLINE.items():
        if name not in Q:
            continue
        times = []
        for _ in range(max(1, runs)):
            t0 = time.time()
            Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t0)
        out[label] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
