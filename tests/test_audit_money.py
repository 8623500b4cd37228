import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit, economics, evaluation
from riskloom.operators.variants import group_fpr_change, variant_audit
from riskloom.sources import stand_ins as si


def test_filter_drops_the_small_group(scored):
    rows = audit.segment_audit(scored, ["home_ownership"], min_defaults=20).collect()
    assert {r["grp"] for r in rows} == {"AUTOMOBILE", "BUILDING", "MACHINERY", "FURNITURE"}
    assert audit.segment_audit(scored, ["home_ownership"]).count() == 0


def test_zero_flag_rate_segment_is_skipped(scored):
    groups = audit.segment_audit(scored, ["home_ownership", "purpose"], min_defaults=20)
    assert {r["segment"] for r in audit.amplification(groups).collect()} == {"purpose"}


def test_amplification_of_known_rates(spark):
    groups = spark.createDataFrame([("s", "a", 100, 10, 0.10, 0.5, 0.40, 0.30), ("s", "b", 100, 5, 0.05, 0.4, 0.05, 0.02)],
                                   "segment string, grp string, people int, defaults int, base_rate double, recall double, flag_rate double, fpr double")
    row = audit.amplification(groups).first()
    assert (row["risk_ratio"], row["flag_ratio"], row["verdict"]) == (pytest.approx(2), pytest.approx(8), "review")
    assert row["amplification"] == pytest.approx(4) and row["fpr_gap_pp"] == pytest.approx(28)
    assert audit.tpr_gap(groups).first()["tpr_gap"] == pytest.approx(0.1)


def test_empty_segment(scored):
    none = scored.withColumn("empty", F.lit(None).cast("string"))
    assert audit.segment_audit(none, ["empty"], min_defaults=0).count() == 0


def test_money_adds_up(scored):
    rows = economics.break_even(scored).collect()
    by = {r["capacity"]: r for r in rows}
    assert by[0.1]["reviews"] == 451 and by[0.1]["chosen"]
    assert by[0.1]["break_even"] == pytest.approx(451 * 50 / (by[0.1]["exposure"] * 0.65))
    best = economics.best_break_even(economics.break_even(scored)).first()
    assert best["break_even"] == min(r["break_even"] for r in rows)
    grid = economics.sensitivity_grid(scored).collect()
    assert len(grid) == 9
    mid = next(r for r in grid if r["review_cost"] == 50 and r["lgd"] == 0.65)
    assert mid["break_even"] == pytest.approx(by[0.1]["break_even"])


def test_curve_ends_at_everything(scored):
    row = evaluation.capacity_curve(scored).where("capacity = 1.0").first()
    assert (row["k"], row["caught"], row["recall"]) == (4514, 128, 1.0)


def test_variant_audit_baseline_costs_nothing(scored):
    rows = variant_audit(scored, {"now": "p", "mix": "p2"}, "now", ["purpose"], min_defaults=20).collect()
    assert {r["variant"]: r["cost"] for r in rows}["now"] == 0
    long = scored.unpivot(["app_id", "y", "purpose"], ["p", "p2"], "variant", "score")
    groups = audit.segment_audit(long, ["purpose"], min_defaults=20, score="score", by=["variant"])
    change = group_fpr_change(groups, "p", "p").collect()
    assert change and all(r["change"] == 0 for r in change)


def test_segments_of_the_stand_in(scored):
    assert set(si.SEGMENTS) <= set(scored.columns)
