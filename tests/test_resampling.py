import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation, resampling
from riskloom.staging import stage


def test_unit_weights_give_the_plain_gini(scored):
    want = evaluation.auc_gini(scored).first()["gini"]
    got = resampling.bootstrap_gini(scored, ["p"], 2, point=True)
    assert got.count() == 3
    assert got.where(f"replicate = {resampling.POINT}").first()["gini"] == pytest.approx(want, abs=1e-12)


def test_unit_weights_under_mass_ties(spark):
    df = stage(spark.range(6000).select(F.col("id").alias("app_id"), (F.col("id") % 11 == 0).cast("int").alias("y"),
                                        F.when(F.col("id") % 5 < 3, 0.5).otherwise((F.col("id") % 97) / 100).alias("p")), "ties")
    want = evaluation.auc_gini(df).first()["gini"]
    assert resampling.bootstrap_gini(df, ["p"], 0, point=True).first()["gini"] == pytest.approx(want, abs=1e-12)


def test_replicates_do_not_depend_on_partitions(spark, scored):
    def run(df):
        rows = resampling.bootstrap_gini(df, ["p", "p2"], 20).collect()
        return sorted((r["model"], r["replicate"], round(r["gini"], 12)) for r in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = run(scored)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert run(scored.coalesce(1)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_interval_holds_the_point(scored):
    for r in resampling.bootstrap_ci(scored, replicates=200).collect():
        assert r["low"] < r["gini"] < r["high"] and r["n_replicates"] == 200


def test_weights_look_like_poisson():
    w = resampling.poisson_weights(np.arange(20_000), 0, 5, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert not np.array_equal(w[:, 0], w[:, 1])


def test_empty_class_replicates_are_left_out(spark):
    df = spark.createDataFrame([(i, int(i == 0), i / 10) for i in range(30)], "app_id bigint, y int, p double")
    n = resampling.bootstrap_gini(df, ["p"], 100).count()
    assert 0 < n < 100


def brute(points, labels, k):
    out = {}
    for i in range(len(points)):
        idx = np.array([j for j in range(len(points)) if j != i and labels[j] == labels[i]])
        d = np.round(np.sqrt(((points[idx] - points[i]) ** 2).sum(1)), 9)
        out[i] = list(idx[np.lexsort((idx, d))[:k]])
    return out


@pytest.mark.parametrize("settings", [{}, {"rows_per_cell": 20, "chunk": 9, "rows_per_salt": 50}])
def test_neighbours_against_brute_force(spark, settings):
    """Half of one group are copies of one vector."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(240, 4))
    points[:100] = points[0]
    points[100:110] = points[105]
    labels = (np.arange(240) % 6 == 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(240), "label": labels.astype("int32"),
                                             "embedding": [list(map(float, p)) for p in points]}))
    got = resampling.nearest_neighbours(df, **settings).toPandas().sort_values("nn_rank")
    want = brute(points, labels, 5)
    assert {i: list(g["nn_id"]) for i, g in got.groupby("vec_id")} == want


def test_rows_ask_few_other_cells():
    """Cells with a row within the distance are asked, and most others are not, though every cell reaches far."""
    from types import SimpleNamespace
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 5))
    pivots = points[:40].copy()
    far = np.sqrt(((points[:, None] - pivots) ** 2).sum(axis=2))
    cell, theta = far.argmin(axis=1), rng.uniform(0, 0.5, len(points))
    radii = {(0, j): far[cell == j, j].max() for j in range(40)}
    pdf = pd.DataFrame({"g": 0, "cell": cell, "copy": np.arange(len(points)), "vec": list(points), "theta": theta})[:300]
    asked = {(r.copy, r.target) for out in resampling._other_cells(SimpleNamespace(value={0: pivots}), radii, "g")([pdf]) for r in out.itertuples()}
    for i in range(300):
        within = np.sqrt(((points - points[i]) ** 2).sum(axis=1)) <= theta[i]
        assert {(i, j) for j in np.unique(cell[within]) if j != cell[i]} <= asked
    assert len(asked) < 300 * 39 / 4


def clustered(spark, n, copies=0):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(60, 24))[rng.integers(0, 60, n)] * 4 + rng.normal(size=(n, 24)) * 0.4
    points[:copies] = points[0]
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "label": (np.arange(n) % 2).astype("int32"), "embedding": [list(map(float, p)) for p in points]}))


def test_hashed_neighbours_find_most_with_few_comparisons(spark):
    df = clustered(spark, 3000, copies=400)
    found = stage(resampling.hashed_neighbours(df, tables=8, leaf=64, rows_per_salt=100), "found")
    recall = resampling.neighbour_recall(found, resampling.nearest_neighbours(df)).first()
    assert recall["n_exact"] == 15_000 and recall["recall"] >= 0.9
    _, points = resampling._points(df, 5, "vec_id", "embedding", "label")
    sizes = resampling.hash_tables(points, "label", 8, 64).groupBy("label", "table", "bucket").count()
    most, pairs = sizes.agg(F.max("count"), F.sum(F.col("count") ** 2)).first()
    assert most <= 64 and pairs < 0.3 * 2 * 1300 ** 2
    distances = found.join(resampling.nearest_neighbours(df).withColumnRenamed("distance", "d"), ["label", "vec_id", "nn_id"])
    assert distances.where("distance <> d").count() == 0


def test_hashed_neighbours_of_equal_and_few_vectors(spark):
    df = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(40)] + [(90, 1, [0.0, 0.0]), (91, 1, [0.0, 1.0])],
                               "vec_id bigint, label int, embedding array<double>")
    got = {(r["vec_id"], r["nn_rank"]): r["nn_id"] for r in resampling.hashed_neighbours(df, tables=2, leaf=3).collect()}
    assert len(got) == 202 and got[(7, 1)] == 0 and got[(0, 5)] == 5 and got[(90, 1)] == 91
    assert resampling.hashed_neighbours(df.where("label = 7")).count() == 0


def test_synthetic_rows_from_hashed_neighbours(spark):
    df = clustered(spark, 300).withColumnsRenamed({"vec_id": "app_id", "embedding": "x"})
    rows = resampling.synthetic_minority(df, 50, neighbours=resampling.hashed_neighbours).collect()
    assert len(rows) == 50 and all(r["base_id"] != r["nn_id"] for r in rows)


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [5.0])], "vec_id bigint, label int, embedding array<double>")
    got = {(r["vec_id"], r["nn_id"]) for r in resampling.nearest_neighbours(df).collect()}
    assert got == {(1, 2), (2, 1)}


def test_synthetic_rows_lie_on_their_segment(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame(pd.DataFrame({"app_id": np.arange(60) * 7, "x": [list(map(float, v)) for v in x]}))
    rows = resampling.synthetic_minority(df, 500).collect()
    assert len(rows) == 500 and len({r["synthetic_id"] for r in rows}) == 500
    near = brute(x, np.zeros(60), 5)
    for r in rows:
        b, n = r["base_id"] // 7, r["nn_id"] // 7
        assert n in near[b] and 0 <= r["gap"] < 1
        assert np.allclose(r["x"], x[b] + r["gap"] * (x[n] - x[b]))
    again = resampling.synthetic_minority(df.repartition(5), 500).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_oversampling_balances(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"app_id": np.arange(120), "y": (np.arange(120) % 8 == 0).astype("int32"),
                                             "x": [list(map(float, v)) for v in rng.normal(size=(120, 2))]}))
    out = resampling.oversample(df)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 105, 1: 105}
    assert df.select("y", "x").exceptAll(out).count() == 0


def test_one_minority_row_is_refused(spark):
    df = spark.createDataFrame([(1, [0.0])], "app_id bigint, x array<double>")
    with pytest.raises(ValueError):
        resampling.synthetic_minority(df, 3)


def test_points_of_small_buckets_are_written_once(spark, monkeypatch):
    """Hash tables write a point again only while its bucket splits, and stop when none does."""
    rng = np.random.default_rng(4)
    rows = [(i, int(i < 60), [float(v) for v in rng.normal(size=4)]) for i in range(360)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    _, points = resampling._points(df, 5, "vec_id", "embedding", "label")
    written, stage = [], resampling.stage

    def counted(out, name, *rest):
        got = stage(out, name, *rest)
        written.append(got.count())
        return got
    monkeypatch.setattr(resampling, "stage", counted)
    sizes = resampling.hash_tables(points, "label", 3, 64).groupBy("label", "table", "bucket").count().collect()
    assert written[0] == 3 * 360 and written[1] == 3 * 300 and len(written) < 8 and written == sorted(written, reverse=True)
    assert sum(r["count"] for r in sizes) == 3 * 360 and max(r["count"] for r in sizes) <= 64
