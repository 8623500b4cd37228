import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import explain, features, models, trees
from riskloom.plans.catalog import SPEC
from riskloom.staging import shared_dir, stage


@pytest.fixture(scope="module")
def train(piles):
    return stage(piles.where("pile = 'train'"), "test-train")


@pytest.fixture(scope="module")
def val(piles):
    return stage(piles.where("pile = 'val'"), "test-val")


@pytest.fixture(scope="module")
def card(train):
    return models.fit_scorecard(train, SPEC)


@pytest.fixture(scope="module")
def boosted(card, train):
    vectors = stage(card.vectors(train, ["app_id", "y"]), "test-vectors")
    return models.fit_boosted_prefix(vectors, rounds=6, patience=3, maxDepth=3), vectors


def matrix(df):
    rows = df.select(vector_to_array("features").alias("x"), "y").toPandas()
    return np.stack(rows["x"]), rows["y"].to_numpy(float)


def test_constants_come_from_train_only(piles, card):
    spoiled = piles.withColumn("loan_amnt", F.when(F.col("pile") == "train", F.col("loan_amnt")).otherwise(1e9))
    assert SPEC.fit(spoiled.where("pile = 'train'")) == card.prep


def test_preparation_edges(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, "b"), (3.0, None, 5.0, None), (None, None, 5.0, "a")],
                               "x double, empty double, flat double, t string")
    prep = features.fit_preparation(df, ["x", "empty", "flat"], [], ["t"])
    assert prep.numeric == ("x", "flat") and prep.scales["flat"] == 1.0 and prep.medians["x"] == 2.0
    assert prep.categories["t"] == ("Unknown", "a", "b") and prep.names == ["x", "flat", "t_a", "t_b"]
    new = spark.createDataFrame([(2.0, 1.0, 6.0, "never seen")], df.schema)
    assert list(prep.matrix(new).first()) == [0.0, 1.0, 0.0, 0.0]


def test_preparation_uses_population_spread(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    assert features.fit_preparation(df, ["x"]).scales["x"] == pytest.approx(np.std([1, 2, 6]))


def test_categories_have_no_limit(spark):
    df = spark.range(12_000).select(F.col("id").cast("string").alias("t"))
    assert len(features.fit_preparation(df, [], [], ["t"]).categories["t"]) == 12_000


def test_loaded_preparation_keeps_the_fill_text(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    prep = features.fit_preparation(df, [], [], ["t"], unknown="blank")
    prep.save(spark, str(tmp_path / "prep"))
    assert features.Preparation.load(spark, str(tmp_path / "prep")) == prep


def test_logistic_is_at_the_optimum_of_its_objective(card, train):
    x, y = matrix(card.vectors(train, ["y"]))
    beta, b0 = card.model.coefficients.toArray(), card.model.intercept
    p = 1 / (1 + np.exp(-(x @ beta + b0)))
    gradient = x.T @ (p - y) + beta
    assert np.abs(gradient).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_balanced_fit_raises_the_level(card, train, val):
    rows = {r["model"]: r for r in models.weighted_comparison(train, val, SPEC).collect()}
    assert rows["balanced"]["mean_p"] > 3 * rows["plain"]["mean_p"]


def test_scorecard_survives_saving(spark, card, val):
    path = f"{shared_dir(spark)}/riskloom-test/card-{np.random.default_rng().integers(1 << 60)}"
    card.save(spark, path)
    again = models.Scorecard.load(spark, path)
    assert again.prep == card.prep
    assert card.score(val).exceptAll(again.score(val)).count() == 0


def test_coefficients_are_sorted_by_size(spark, card):
    sizes = [abs(r["coefficient"]) for r in card.coefficients(spark).collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == len(card.prep.names)


def test_ablation_keeps_the_flag_and_rejects_unknown_names(train, val):
    with pytest.raises(ValueError):
        models.ablation(train, val, SPEC, ["nope"])
    rows = {r["model"]: r for r in models.ablation(train, val, SPEC, ["dti"]).collect()}
    assert rows["baseline"]["cost"] == 0 and set(rows) == {"baseline", "without dti"}
    reduced = models.ColumnSpec(tuple(c for c in SPEC.numeric if c != "dti"), SPEC.flagged, SPEC.categorical)
    assert "dti_missing" in reduced.fit(train).names


def test_forest_arrays_give_the_model_probability(spark, card, train):
    vectors = stage(card.vectors(train, ["app_id", "y"]), "test-vectors")
    model = models.fit_boosting(vectors, rounds=4, maxDepth=3)
    ours = trees.forest_of(model).score(vectors, ["app_id"]).withColumnRenamed("p", "q")
    theirs = models.score_rows(model, vectors, ["app_id"])
    assert ours.join(theirs, "app_id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_prefix_is_the_best_round(boosted):
    prefix, _ = boosted
    assert prefix.best_round == int(np.argmax(prefix.auc_by_round)) + 1 == prefix.forest.n_trees


def test_prefix_does_not_depend_on_how_rounds_are_fitted(boosted):
    """Doubling steps end with the trees and the AUC of one fit of all rounds, and stop when patience is used up."""
    prefix, vectors = boosted
    whole = trees.forest_of(models.fit_boosting(stage(models.stratified_holdout(vectors, 0.15, "y", "app_id"), "t").where("not held_out"),
                                                rounds=12, maxDepth=3))
    again = models.fit_boosted_prefix(vectors, rounds=12, patience=2, maxDepth=3)
    assert len(again.auc_by_round) - again.best_round == 2 or len(again.auc_by_round) == 12
    for a, b in zip(whole.trees, again.forest.trees):
        assert np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value)
    n = min(len(prefix.auc_by_round), len(again.auc_by_round))
    assert prefix.auc_by_round[:n] == again.auc_by_round[:n]


def test_refits_add_little_when_all_rounds_are_needed(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models, "fit_boosting", lambda train, label, rounds: made.append(rounds))
    monkeypatch.setattr(models, "forest_of", lambda model: trees.Forest((None,) * made[-1]))
    monkeypatch.setattr(models, "best_prefix", lambda forest, *rest: (list(range(forest.n_trees)), False))
    rows = spark.range(40).selectExpr("id as app_id", "id % 2 as y")
    assert models.fit_boosted_prefix(rows).best_round == made[-1] == models.BOOSTING_ROUNDS
    assert sum(made) <= 1.3 * models.BOOSTING_ROUNDS


def test_round_auc_against_the_metric(boosted):
    """Several ranges and the block of rounds give the AUC of each round's own scores."""
    from riskloom.operators.evaluation import auc_gini
    prefix, vectors = boosted
    n = prefix.forest.n_trees
    got = trees.auc_by_round(prefix.forest, vectors, 0, n, rows_per_range=300)
    for r in (0, n - 1):
        want = auc_gini(prefix.forest.prefix(r + 1).score(vectors, ["app_id", "y"])).first()["auc"]
        assert got[r] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        trees.auc_by_round(prefix.forest, vectors.where("y = 0"), 0, 1)


def test_later_rounds_do_not_add_up_early_trees_again(boosted):
    """Margins of the rows go along with the rounds, in refits too, and the AUC of every round stays as it is."""
    prefix, vectors = boosted
    forest = trees.Forest((prefix.forest.trees * 14)[:14])
    walk = trees.Walk(vectors, every=4)
    known, done = models.best_prefix(forest.prefix(9), vectors, patience=99, walk=walk, block=3)
    assert len(known) == 9 and not done and 9 - walk.at <= 4 + 3
    known, _ = models.best_prefix(forest, vectors, patience=99, history=known, walk=walk, block=3)
    assert 14 - walk.at <= 4 + 3 and known == trees.auc_by_round(forest, vectors, 0, 14)


def test_rows_that_pass_the_same_tests_are_explained_once(monkeypatch):
    made, shares = [], trees._shares
    monkeypatch.setattr(trees, "_shares", lambda leaves, columns: made.append(columns.shape[1]) or shares(leaves, columns))
    tree = trees.Tree(np.array([0, 1, -1, -1, -1]), np.array([0.5, 0.3, np.inf, np.inf, np.inf]), np.array([1, 2, -1, -1, -1]),
                      np.array([4, 3, -1, -1, -1]), np.array([0, 0, 1.0, -2.0, 3.0]), np.array([10, 6, 4, 2, 4.0]))
    x = np.random.default_rng(3).random((500, 2))
    x[:6] = [[np.nan, 0.1], [np.inf, 0.1], [-np.inf, 0.1], [0.1, np.nan], [0.1, -np.inf], [np.nan, np.nan]]
    forest = trees.Forest((tree,))
    got = trees.shapley(forest, x)
    assert made == [4]
    assert np.allclose(got.sum(axis=1) + forest.base(), forest.margins(x))


def test_forest_of_a_rare_class_has_probabilities(card, train):
    vectors = stage(card.vectors(train, ["app_id", "y"]), "test-vectors")
    model = models.fit_forest(vectors, numTrees=5)
    rows = models.score_forest(model, vectors).agg(F.countDistinct("p").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y")).first()
    assert max(t.depth for t in model.trees) > 1 and rows["n"] > 10 and abs(rows["p"] - rows["y"]) < 0.02


def test_deep_paths_without_a_table():
    """Patterns looked up and patterns worked out give the same shares."""
    rng = np.random.default_rng(5)
    inside, share = (rng.random((40, 12)) < 0.5).astype(float), rng.uniform(0.05, 0.95, 12)
    got = trees.pattern_shares(inside, share)
    assert np.allclose(got.sum(axis=1), np.prod(inside, axis=1) - np.prod(share), atol=1e-9)


def test_attributions_add_up(boosted):
    prefix, vectors = boosted
    assert explain.additivity(prefix.forest, vectors).agg(F.max("error")).first()[0] < 1e-9


def test_shapley_against_all_coalitions():
    from itertools import combinations
    from math import factorial
    tree = trees.Tree(np.array([0, 1, -1, -1, 0, -1, 2, -1, -1]), np.array([0.5, 0.3, 0, 0, 0.8, 0, 0.1, 0, 0]),
                      np.array([1, 2, -1, -1, 5, -1, 7, -1, -1]), np.array([4, 3, -1, -1, 6, -1, 8, -1, -1]),
                      np.array([0, 0, 1.0, -2.0, 0, 0.5, 0, 3.0, 4.0]), np.array([10, 6, 4, 2, 4, 1, 3, 2, 1.0]))
    forest = trees.Forest((tree,))
    x = np.array([[0.6, 0.2, 0.05], [0.1, 0.9, 0.4], [0.9, 0.1, 0.2]])

    def known(row, s, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if f in s:
            return known(row, s, l if row[f] <= tree.threshold[node] else r)
        return (tree.cover[l] * known(row, s, l) + tree.cover[r] * known(row, s, r)) / tree.cover[node]
    got = trees.shapley(forest, x)
    for i, row in enumerate(x):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (known(row, {*s, f}) - known(row, set(s)))
                       for n in range(3) for s in combinations(rest, n))
            assert got[i, f] == pytest.approx(want, abs=1e-12)
    assert forest.base() == pytest.approx(known(x[0], set()))


def test_linear_attribution_adds_up(card, train, val):
    n = len(card.prep.names)
    rows = explain.scorecard_attribution(card, train, val, n)
    means = explain.encoded_means(card.prep.matrix(SPEC.with_flags(train)), card.prep.names)
    base = card.model.intercept + sum(b * means[f] for f, b in zip(card.prep.names, card.model.coefficients.toArray()))
    total = rows.groupBy("app_id").agg(F.sum("phi").alias("s"))
    odds = card.score(val).select("app_id", F.ln(F.col("p") / (1 - F.col("p"))).alias("margin"))
    assert total.join(odds, "app_id").agg(F.max(F.abs(F.col("s") + base - F.col("margin")))).first()[0] < 1e-8


def test_global_attribution_is_sorted(boosted, card):
    prefix, vectors = boosted
    rows = explain.global_attribution(prefix.forest, vectors, card.prep.names).collect()
    sizes = [r["mean_abs"] for r in rows]
    assert len(rows) == 15 and sizes == sorted(sizes, reverse=True)
