from riskloom.operators import profiling
from riskloom.sources import policy


def test_every_raw_column_has_one_place():
    pol = policy.loan_policy()
    names = [c for g in pol.groups.values() for c in g.columns]
    assert len(names) == len(set(names)) == 151
    assert [len(pol.columns(s)) for s in (policy.KEEP, policy.TARGET, policy.DROP)] == [60, 3, 88]
    assert (len(pol.numeric()), len(pol.flags()), len(pol.categorical)) == (55, 11, 5)


def test_gaps_report_each_kind(spark):
    pol = spark.createDataFrame([("a", "g"), ("b", "g"), ("b", "h"), ("z", "g")], "column string, `group` string")
    header = spark.createDataFrame([("a",), ("b",), ("new",)], "column string")
    got = {tuple(r) for r in policy.policy_gaps(header, pol).collect()}
    assert got == {("new", "unclassified"), ("z", "not in header"), ("b", "classified more than once")}


def test_raw_schema_declares_numbers_and_text():
    schema = policy.loan_policy().raw_schema(["loan_amnt", "issue_d", "grade"])
    assert [f.dataType.simpleString() for f in schema] == ["double", "string", "string"]


def test_all_null_column_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    rates = {r["column"]: r["null_rate"] for r in profiling.null_rates(df).collect()}
    assert rates == {"a": 0.0, "b": 1.0}
    assert {r["column"]: r["band"] for r in profiling.missing_bands(profiling.null_rates(df)).collect()} == {"b": "almost entirely empty"}
