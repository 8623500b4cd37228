import uuid

import pytest

from riskloom.sources import files
from riskloom.staging import shared_dir


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/riskloom-test/{uuid.uuid4().hex}"


def test_csv_header_and_pruned_read(spark, path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id int, t string, x double")
    files.write_csv(df, path, single_file=True)
    assert files.csv_header(spark, path) == ["id", "t", "x"]
    back = files.read_csv(spark, path, df.schema, ["id", "x"])
    assert sorted(map(tuple, back.collect())) == [(1, 1.5), (2, None)]


def test_parquet_piles_are_pruned(spark, path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "id int, pile string")
    files.write_parquet(df, path, ["pile"])
    one = files.read_parquet(spark, path).where("pile = 'val'")
    assert [r["id"] for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(pile" in one._jdf.queryExecution().executedPlan().toString()


def test_bronze_year_is_a_partition(spark, path):
    df = spark.createDataFrame([(1, "Dec-2015"), (2, "Jan-2016"), (3, "bad")], "id int, issue_d string")
    files.write_month_bronze(df, path)
    got = files.read_parquet(spark, path).where("issue_year = 2016").select("id", "issue_dt").collect()
    assert [(r["id"], str(r["issue_dt"])) for r in got] == [(2, "2016-01-01")]
    assert files.read_parquet(spark, path).count() == 3


def test_append_matches_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([("y", 2)], "t string, id int")
    assert sorted(map(tuple, files.append([a, b]).collect())) == [(1, "x"), (2, "y")]
