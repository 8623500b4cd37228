from pyspark.sql import functions as F

from riskloom.functions import dates, scalars
from riskloom.operators import cleaning, labeling


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_facts_of_the_fixture(spark, scored):
    row = labeling.label_summary(scored, "y").first()
    assert (row["n"], row["n_target"]) == (4514, 128)
    assert scored.where("last_pymnt_dt is null").count() == 81
    assert scored.where("disc_r is null").count() == 1185
    assert {r["cutoff"]: r["defaults"] for r in labeling.label_sensitivity(scored).collect()} == {8: 128, 9: 135, 12: 162}


def test_months_bad_text_and_negative_gaps(spark):
    df = frame(spark, [("Dec-2015", "Mar-2016"), ("Dec-2015", "Oct-2015"), ("Dec-2015", "soon"), ("13-2015", None)],
               "issue_d string, last_pymnt_d string")
    got = [r["m"] for r in labeling.with_dates(df).collect()]
    assert got == [3, -2, None, None]


def test_label_counts_never_paid_and_ignores_other_statuses(spark):
    df = frame(spark, [("Charged Off", 8), ("Charged Off", 9), ("Default", None), ("Current", None), (None, 1)],
               "loan_status string, m int")
    assert [r[0] for r in df.select(labeling.failed_within(8)).collect()] == [1, 0, 1, 0, 0]


def test_label_summary_without_positives(spark):
    df = frame(spark, [("Current", 3, 0)], "loan_status string, m int, y int")
    row = labeling.label_summary(df, "y").first()
    assert row["n_target"] == 0 and row["class_ratio"] == 1.0


def test_bands_are_right_closed_with_lowest_edge(spark):
    df = frame(spark, [(0.0,), (10.0,), (10.5,), (99.0,), (-0.1,), (None,)], "x double")
    b = scalars.band("x", [0.0, 10.0, 20.0, float("inf")], ["a", "b", "c"])
    assert [r[0] for r in df.select(b).collect()] == ["a", "a", "b", "c", None, None]
    closed = scalars.band("x", [0.0, 10.0, 20.0], ["a", "b"])
    assert [r[0] for r in df.select(closed).collect()] == ["a", "a", "b", None, None, None]


def test_limits_clear_only_values_beyond_the_bounds(spark):
    df = frame(spark, [(4999.0,), (5000.0,), (None,)], "annual_inc double")
    rule = {"annual_inc": {"min": 5000}}
    assert [r[0] for r in cleaning.clear_impossible(df, rule).collect()] == [None, 5000.0, None]
    assert cleaning.cleared_counts(df, rule).first()["n_cleared"] == 1


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in scalars.nan_to_null(df).collect()] == [None, 1.0]


def test_month_range_covers_the_last_day():
    assert str(dates.month_range("2015-01", "2016-02")[1]) == "2016-02-29"


def test_half_even_and_safe_ratio(spark):
    row = spark.range(1).select(scalars.half_even(F.lit(2.5)).alias("a"), scalars.half_even(F.lit(3.5)).alias("b"),
                                scalars.safe_ratio(F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(row) == (2, 4, None)
