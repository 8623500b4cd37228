import pytest
from pyspark.sql import functions as F

from riskloom.operators import splitting


def test_published_quotas():
    quotas = splitting.split_quotas({0: 855_502 - 31_629, 1: 31_629}, 0.2, 0.2)
    test, val = (sum(q[i] for q in quotas.values()) for i in (0, 1))
    assert (test, val, 855_502 - test - val) == (171_101, 171_101, 513_300)
    assert quotas[1] == (6_326, 6_326) and 31_629 - sum(quotas[1]) == 18_977


def test_split_is_complete_and_stratified(piles):
    row = splitting.split_integrity(piles).first()
    assert row["ok"] and row["n_rows"] == 4514
    sizes = {r["pile"]: (r["n"], r["defaults"]) for r in splitting.split_summary(piles).collect()}
    assert sizes == {"test": (903, 26), "val": (903, 26), "train": (2708, 76)}


def test_membership_does_not_depend_on_layout(scored, piles):
    again = splitting.stratified_split(scored.repartition(13).orderBy(F.desc("loan_amnt")))
    diff = again.select("app_id", "pile").exceptAll(piles.select("app_id", "pile"))
    assert diff.count() == 0


def test_integrity_sees_overlap(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val"), (3, None)], "app_id bigint, pile string")
    row = splitting.split_integrity(df).first()
    assert (row["n_overlap"], row["n_unassigned"], row["ok"]) == (1, 1, False)


def test_one_class_split(spark):
    df = spark.range(100).select(F.col("id").alias("app_id"), F.lit(0).alias("y"))
    sizes = {r["pile"]: r["count"] for r in splitting.stratified_split(df).groupBy("pile").count().collect()}
    assert sizes == {"train": 60, "val": 20, "test": 20}


@pytest.mark.parametrize("n", [1, 2, 7])
def test_few_rows(spark, n):
    df = spark.range(n).select(F.col("id").alias("app_id"), (F.col("id") % 2).cast("int").alias("y"))
    assert splitting.stratified_split(df).count() == n


def test_group_sample_is_exact_also_for_a_hot_group(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") < 3500, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    got = splitting.sample_per_group(df, "g", 20, "id")
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"hot": 20, **{f"g{i}": 20 for i in range(5)}}
    want = df.where("g = 'hot'").orderBy(splitting.key_hash("id", splitting.SEED)).limit(20).select("id").toPandas()["id"]
    assert set(got.where("g = 'hot'").toPandas()["id"]) == set(want)


def test_small_group_is_kept_whole(spark):
    df = spark.range(7).select("id", F.lit("a").alias("g"))
    assert splitting.sample_per_group(df, "g", 50, "id").count() == 7


def test_holdout_share(piles):
    train = piles.where("pile = 'train'")
    got = {(r["y"], r["held_out"]): r["count"] for r in splitting.stratified_holdout(train).groupBy("y", "held_out").count().collect()}
    assert got[(0, True)] + got[(1, True)] == 407 and got[(1, True)] == 11


def test_class_weights_sum_to_n(scored):
    rows = splitting.class_weights(scored).collect()
    assert sum(r["n_class"] * r["weight"] for r in rows) == pytest.approx(4514)
    weighted = splitting.with_class_weight(scored.select("y")).agg(F.sum("weight")).first()[0]
    assert weighted == pytest.approx(4514)


@pytest.mark.parametrize("rows_per_cell", [1, 20, 500_000])
def test_hash_cuts_descend_to_small_cells(spark, rows_per_cell):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 2).cast("int")).alias("s"))
    hashes = {}
    for r in df.select("s", splitting.key_hash("k", 1).alias("h")).collect():
        hashes.setdefault(r["s"], []).append(r["h"])
    wanted = {s: [0, 1, 7, len(h) // 2, len(h)] for s, h in hashes.items()}
    got = splitting.hash_cuts(df, "s", "k", 1, wanted, rows_per_cell)
    assert got == {s: [None, *[sorted(hashes[s])[q - 1] for q in qs[1:]]] for s, qs in wanted.items()}


def test_hash_cuts_of_one_repeated_key(spark):
    df = spark.range(300).select(F.lit(5).alias("k"), F.lit("x").alias("s"))
    h = df.select(splitting.key_hash("k", 1)).first()[0]
    assert splitting.hash_cuts(df, "s", "k", 1, {"x": [10, 300]}, 50) == {"x": [h, h]}
