import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import comparison, evaluation, quantiles, ranking
from riskloom.staging import stage


@pytest.fixture(scope="module")
def tied(spark):
    """A third of all rows share one score, another quarter a second one."""
    rng = np.random.default_rng(5)
    n = 12_000
    draw = rng.random(n)
    p = np.where(draw < 0.34, 0.25, np.where(draw < 0.6, 0.75, np.round(rng.random(n), 3)))
    pdf = pd.DataFrame({"app_id": rng.permutation(n).astype("int64") * 1_000_003, "p": p,
                        "y": (rng.random(n) < 0.05 + 0.1 * p).astype("int32")})
    pdf = pdf.sort_values(["p", "app_id"], ascending=[False, True]).reset_index(drop=True)
    return pdf, stage(spark.createDataFrame(pdf), "tied")


@pytest.mark.parametrize("rows_per_range", [1_000_000, 10])
def test_rank_is_exact_and_balanced_under_mass_ties(tied, rows_per_range, monkeypatch):
    monkeypatch.setattr(ranking, "SKETCH_RANGES", 200)
    pdf, df = tied
    layout = ranking.fit_layout(df, rows_per_range=rows_per_range)
    ranges = max(64, len(pdf) // rows_per_range)
    assert max(t["n"] for t in layout.totals) < 6 * len(pdf) / ranges + 20
    got = layout.ranked(df).select("app_id", "rank").toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(1, len(pdf) + 1))
    assert list(got["app_id"]) == list(pdf["app_id"])


def test_cuts_pick_the_kth_row(tied):
    pdf, df = tied
    layout = ranking.fit_layout(df)
    for cut in layout.cuts(df, {(): [0, 1, 4000, len(pdf)]})[()]:
        assert df.where(layout.above(cut)).count() == cut.k
        if cut.k:
            assert cut.key == pdf["app_id"][cut.k - 1]


def test_cut_beyond_the_rows_is_refused(tied):
    _, df = tied
    with pytest.raises(ValueError):
        ranking.fit_layout(df).cuts(df, {(): [10 ** 9]})


def test_average_rank_of_ties(tied):
    pdf, df = tied
    got = ranking.average_rank(df, "p").select("app_id", "avg_rank").toPandas().set_index("app_id")["avg_rank"]
    want = pdf.set_index("app_id")["p"].rank(ascending=False)
    assert np.allclose(got.reindex(want.index), want)


def test_metrics_against_plain_numpy(tied):
    pdf, df = tied
    row = evaluation.metric_block(df).first()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    k = round(len(y) * 0.1)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)
    gap = np.cumsum(y) / y.sum() - np.cumsum(1 - y) / (1 - y).sum()
    assert row["tp"] == y[:k].sum() and row["k"] == k
    assert row["auc"] == pytest.approx(auc, abs=1e-12)
    assert row["ks"] == pytest.approx(gap.max() * 100, abs=1e-9)
    depth = evaluation.ks(df).first()
    assert depth["ks_rank"] == int(np.argmax(gap)) + 1


def test_groups_are_ranked_apart(tied):
    _, df = tied
    two = df.withColumn("g", F.when(F.col("app_id") % 3 == 0, "a").otherwise("b"))
    together = {r["g"]: r for r in evaluation.metric_block(two, by=["g"]).collect()}
    for g in "ab":
        alone = evaluation.metric_block(two.where(F.col("g") == g)).first()
        for name in ("n", "tp", "auc", "ks", "recall"):
            assert together[g][name] == pytest.approx(alone[name])


def test_one_class_gives_null_not_an_error(spark):
    df = spark.createDataFrame([(i, 0, i / 10) for i in range(20)], "app_id bigint, y int, p double")
    row = evaluation.metric_block(df).first()
    assert row["tp"] == 0 and row["recall"] is None and row["auc"] is None and row["ks"] is None


def test_all_scores_equal(spark):
    df = stage(spark.range(5000).select(F.col("id").alias("app_id"), (F.col("id") % 9 == 0).cast("int").alias("y"),
                                        F.lit(0.5).alias("p")), "equal")
    layout = ranking.fit_layout(df)
    assert max(t["n"] for t in layout.totals) < 500
    assert evaluation.auc_gini(df).first()["auc"] == 0.5
    got = layout.ranked(df).orderBy("rank").select("app_id").toPandas()["app_id"]
    assert list(got) == list(range(5000))


def test_null_scores_come_last(spark):
    df = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.9), (4, float("nan"))], "app_id bigint, p double")
    got = [r["app_id"] for r in ranking.global_rank(df).orderBy("rank").collect()]
    assert got == [3, 1, 2, 4]


def test_rank_flag_and_decile_agree_on_unknown_scores(spark):
    """NaN and NULL scores stand last by key for every operator, also when a cut falls among them."""
    rows = [(i, float("nan") if i % 20 == 3 else None if i % 20 == 5 else ((i * 7919) % 1000) / 1000, i % 3 == 0) for i in range(1000)]
    df = stage(spark.createDataFrame([(a, p, int(y)) for a, p, y in rows], "app_id bigint, p double, y int"), "unknown")
    known = sorted(((p, i) for i, p, _ in rows if p is not None and p == p), key=lambda x: (-x[0], x[1]))
    order = [i for _, i in known] + [i for i, p, _ in rows if p is None or p != p]
    assert [r.app_id for r in ranking.global_rank(df).orderBy("rank").collect()] == order
    for share in (0.1, 0.95):
        flagged = {r.app_id for r in ranking.topk_flag(df, share).where("reviewed").collect()}
        assert flagged == set(order[:round(1000 * share)])
    deciles = {r.app_id: r.decile for r in ranking.with_decile(df).collect()}
    assert deciles == {i: 1 + at // 100 for at, i in enumerate(order)}


def test_negative_zero_ties_with_zero(spark):
    df = spark.createDataFrame([(i, -0.0 if i % 2 else 0.0) for i in range(50)], "app_id bigint, p double")
    assert [r["app_id"] for r in ranking.global_rank(df).orderBy("rank").collect()] == list(range(50))


def test_same_ranks_under_other_partitionings(spark, scored):
    want = ranking.global_rank(scored).select("app_id", "rank").orderBy("app_id").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        again = ranking.global_rank(scored.repartition(3)).select("app_id", "rank").orderBy("app_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert want == again


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_a_single_partition(scored):
    frames = [ranking.global_rank(scored), evaluation.ks(scored), evaluation.auc_gini(scored),
              evaluation.roc_points(scored), ranking.cumulative_shares(scored)]
    for df in frames:
        lines = plan_of(df).splitlines()
        windows = [i for i, line in enumerate(lines) if "Window " in line]
        for i in windows:
            below = "\n".join(lines[i:i + 4])
            assert "SinglePartition" not in below, below


def test_flags_move_no_rows(scored):
    assert "Exchange" not in plan_of(ranking.topk_flag(scored, 0.1))
    assert "Exchange" not in plan_of(ranking.with_decile(scored))


def test_exact_quantiles_agree_with_percentile(tied):
    _, df = tied
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    wide = df.withColumn("z", F.when(F.col("app_id") % 5 > 0, F.col("app_id") / 7)).withColumn("empty", F.lit(None).cast("double"))
    cols = ["p", "z", "empty"]
    at = F.array(*[F.lit(float(p)) for p in probs])
    want = wide.agg(*[F.percentile(F.col(c).cast("double"), at).alias(c) for c in cols]).first()
    assert quantiles.exact_quantiles(wide, cols, probs) == {c: list(want[c]) if want[c] else [None] * 7 for c in cols}


def test_spearman_matches_pandas(scored):
    want = scored.select("p", "p2").toPandas().rank().corr().iloc[0, 1]
    assert comparison.spearman(scored).first()[0] == pytest.approx(want, abs=1e-12)


def test_decile_sizes():
    assert ranking.equal_parts(23, 10) == [3, 6, 9, 11, 13, 15, 17, 19, 21, 23]
