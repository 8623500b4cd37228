"""The whole job on a raw CSV with the full 151-column header."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import profiling
from riskloom.plans.stages import Job
from riskloom.sources import files, policy
from riskloom.sources import stand_ins as si
from riskloom.staging import shared_dir


@pytest.fixture(scope="module")
def job(spark, small):
    import uuid
    root = f"{shared_dir(spark)}/riskloom-test/{uuid.uuid4().hex}"
    pol = policy.loan_policy()
    apps = si.applications(spark, small, ("1996-01", "1998-12"))
    header = [c for g in pol.groups.values() for c in g.columns]
    have = {"id": F.col("app_id"), "loan_amnt": F.col("loan_amnt"), "annual_inc": F.col("annual_inc") * 20,
            "dti": F.col("dti") / 3, "term": F.col("term"), "purpose": F.col("purpose"), "emp_length": F.col("emp_length"),
            "home_ownership": F.col("home_ownership"), "fico_range_low": F.col("fico_range_low"), "issue_d": F.col("issue_d"),
            "loan_status": F.col("loan_status"), "last_pymnt_d": F.col("last_pymnt_d"),
            "last_credit_pull_d": F.col("last_credit_pull_d"), "bc_util": F.col("disc_r") * 100,
            "application_type": F.lit("Individual"), "revol_util": F.col("u") * 160,
            "all_util": F.when(F.col("issue_d").endswith("1997"), F.col("u"))}
    noise = {c: (F.pmod(F.xxhash64("app_id", F.lit(c)), F.lit(50))).cast("double") for c in pol.numeric()}
    cols = [have.get(c, noise.get(c, F.lit(None).cast("string"))).alias(c) for c in header]
    files.write_csv(apps.select(*cols), f"{root}/raw")
    return Job(spark, f"{root}/raw", f"{root}/out", months=("1996-01", "1997-12"))


@pytest.fixture(scope="module")
def built(job):
    job.build_cohort()
    job.split()
    job.fit_baseline()
    return job


def test_reports_before_the_cohort(job):
    assert [(r["issue_year"], r["in_cohort"]) for r in job.inspect().collect()] == [(1996, True), (1997, True), (1998, False)]
    assert job.label_reports()["summary"].first()["n_target"] == 128
    cleared = {r["column"]: r["n_cleared"] for r in job.cleared().collect()}
    assert set(cleared) == set(job.policy.limits)
    assert cleared["total_rev_hi_lim"] == 0 and all(cleared[c] > 0 for c in ("annual_inc", "revol_util", "pub_rec"))
    inv = job.inventory().collect()
    assert len(inv) == 151 and [r["status"] for r in inv] == sorted((r["status"] for r in inv), key=policy.STATUS_ORDER.get)
    ladder = job.lag()["global"].collect()
    assert len(ladder) == 4 and sum(r["n_rows"] > 0 for r in ladder) == 2
    assert policy.policy_gaps(profiling.header_table(job.raw_rows()), job.policy.table(job.spark)).count() == 0


def test_cohort_holds_no_label_source(built):
    cohort = built.spark.read.parquet(f"{built.out}/cohort")
    assert cohort.count() == 4514 and len(cohort.columns) == 63
    assert not {"loan_status", "last_pymnt_d", "issue_d"} & set(cohort.columns)
    assert {r["pile"]: r["n"] for r in built.split_report().collect()} == {"test": 903, "val": 903, "train": 2708}


def test_model_input_is_complete(built):
    names = built.scorecard().prep.names
    assert {f"{c}_missing" for c in built.policy.flagged} <= set(names)


def test_reports_after_the_fit(built):
    boosted = built.fit_challenger(rounds=4, patience=2, maxDepth=2).forest
    metrics = built.evaluate()["metrics"].first()
    assert metrics["n"] == 903 and 0.5 < metrics["auc"] <= 1
    final = built.final_test(boosted)
    assert final["metrics"].count() == 4 and final["delta"].count() == 1 and final["gap"].count() == 14
    assert built.segments(min_defaults=3)["groups"].count() > 3
    assert built.money()["grid"].count() == 9
    robust = built.robustness(boosted, 50)
    assert robust["psi"].count() == 60 and robust["intervals"].count() == 3 and robust["unseen"].count() == 0
    assert built.explain().count() == 24 and built.explain(boosted).count() == 24
    miss = built.missingness(["all_util"])
    assert miss["joint"].first()["identical"] and miss["months"].count() == 24
    assert built.month_sample(["loan_status", "dti"], 5).count() == 120


def test_ablation_by_name(built):
    assert built.ablate(["dti"]).count() == 2


def test_command_line_rejects_missing_features():
    from riskloom.__main__ import main
    with pytest.raises(SystemExit):
        main(["ablate", "--raw", "x", "--out", "y"])


def test_command_starts_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys
    main = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "riskloom", "__main__.py")
    done = subprocess.run([sys.executable, main, "--help"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and "smote" in done.stdout


def test_functions_for_workers_travel_by_value():
    from pyspark import cloudpickle

    import riskloom
    from riskloom.operators.trees import Tree
    assert riskloom.__name__ in cloudpickle.list_registry_pickle_by_value()
    assert b"def_types" in cloudpickle.dumps(Tree) or b"_make_skeleton_class" in cloudpickle.dumps(Tree)
