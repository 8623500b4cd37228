"""Run one stage of the job: ``spark-submit riskloom/__main__.py STAGE --raw CSV --out DIR [feature ...]``."""

from __future__ import annotations

import argparse
import os
import sys

if not __package__:  # started as a file: the package's parent is not on the path yet
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from riskloom.plans.stages import Job  # noqa: E402

STAGES = ("inspect", "build_cohort", "cleared", "label_reports", "lag", "inventory", "split", "split_report", "missingness",
          "fit_baseline", "class_weighting", "smote", "bench_models", "fit_challenger", "evaluate", "segments", "money", "robustness", "final_test", "ablate", "explain")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="riskloom")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--raw", required=True, help="raw snapshot CSV")
    p.add_argument("--out", required=True, help="folder for tables and models")
    p.add_argument("--key", default="id", help="unique id column of the raw file")
    p.add_argument("--challenger", action="store_true", help="for final_test, robustness and explain: take the saved challenger too")
    p.add_argument("features", nargs="*", help="for ablate: the features to leave out")
    args = p.parse_args(argv)
    if args.stage == "ablate" and not args.features:
        p.error("ablate needs at least one feature")
    job = Job(SparkSession.builder.appName(f"riskloom {args.stage}").getOrCreate(), args.raw, args.out, args.key)
    given = [args.features] if args.stage == "ablate" else [job.challenger()] if args.challenger else []
    result = getattr(job, args.stage)(*given)
    tables = {args.stage: result} if isinstance(result, DataFrame) else result or {}
    for name, df in tables.items():
        print(name)
        df.show(200, truncate=False)


if __name__ == "__main__":
    main()
