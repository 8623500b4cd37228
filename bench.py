"""Headline queries, seconds each: median of the timed runs after one warm-up.

Prints one JSON line.  BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the input, the
cores and the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.operators import labeling, models, resampling  # noqa: E402
from riskloom.plans import catalog  # noqa: E402
from riskloom.sources import stand_ins as si  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def cohort_label(spark):
    labeling.label_sensitivity(si.cohort(spark, SF_DIR)).collect()


def evaluation_block(spark):
    catalog.metric_block(spark, SF_DIR).collect()


def segment_audit(spark):
    catalog.segment_audit(spark, SF_DIR).collect()


def psi_all_features(spark):
    catalog.psi_report(spark, SF_DIR).collect()


def paired_bootstrap(spark):
    resampling.bootstrap_ci(catalog.scored(spark, SF_DIR, "p2"), replicates=1000).collect()


def exact_split(spark):
    catalog.split_summary(spark, SF_DIR).collect()


def logistic_fit_score(spark):
    train, val = catalog._piles(spark, SF_DIR)
    models.fit_scorecard(train, catalog.SPEC).score(val).agg({"p": "avg"}).collect()


QUERIES = [cohort_label, evaluation_block, segment_audit, psi_all_features, paired_bootstrap, exact_split, logistic_fit_score]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for fn in QUERIES:
        fn(spark)
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            fn(spark)
            times.append(time.perf_counter() - start)
        seconds[fn.__name__] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
