"""Scoring models on prepared vectors, fitted with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.functions.verdicts import ABLATION_NOISE, challenger_band, keep_band, noise_band
from riskloom.operators.cleaning import add_missing_flags
from riskloom.operators.comparison import align_scores, caught_change, review_overlap, spearman
from riskloom.operators.evaluation import metric_block
from riskloom.operators.features import Preparation, fit_preparation
from riskloom.operators.resampling import oversample
from riskloom.operators.splitting import stratified_holdout, with_class_weight
from riskloom.operators.trees import Forest, Walk, auc_by_round, forest_of
from riskloom.sources.policy import REVIEW_CAPACITY
from riskloom.staging import stage

# Settings of the compared models.
FOREST = {"numTrees": 300, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt", "maxDepth": 30, "maxBins": 128}
BOOSTING = {"stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
            "minInstancesPerNode": 20}
BOOSTING_ROUNDS = 2000
STALE_ROUNDS = 50
STOP_SHARE = 0.15
SEED = 42


@dataclass(frozen=True)
class ColumnSpec:
    """Input columns of a model, before encoding."""

    numeric: tuple[str, ...]
    flagged: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def flags(self) -> list[str]:
        return [f"{c}_missing" for c in self.flagged]

    def with_flags(self, df: DataFrame) -> DataFrame:
        return add_missing_flags(df, self.flagged) if self.flagged else df

    def fit(self, train: DataFrame) -> Preparation:
        return fit_preparation(self.with_flags(train), self.numeric, self.flags, self.categorical)


def fit_logistic(vectors: DataFrame, label: str = "y", weight: str | None = None, C: float = 1.0,
                 n: int | None = None) -> LogisticRegressionModel:
    """L2 logistic regression with inverse strength ``C`` on a summed loss, hence regParam 1/(C n).

    Balanced class weights sum to n, so they use the same regParam.
    """
    rows = vectors.count() if n is None else n
    est = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (C * max(rows, 1)),
                             elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8)
    return (est.setWeightCol(weight) if weight else est).fit(vectors)


def fit_forest(vectors: DataFrame, label: str = "y", seed: int = SEED, **settings) -> RandomForestRegressionModel:
    """A forest of probability trees: variance of a 0/1 label splits as Gini does, and a leaf predicts its share of class 1.

    Spark's forest classifier merges leaves that agree on the majority class, which for a rare
    class leaves trees of one node.
    """
    return RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, **{**FOREST, **settings}).fit(vectors)


def score_forest(model: RandomForestRegressionModel, vectors: DataFrame, keep: Sequence[str] = ("app_id", "y")) -> DataFrame:
    """Mean share of class 1 over the trees next to the kept columns."""
    return model.transform(vectors).select(*keep, F.col("prediction").alias("p"))


def fit_boosting(vectors: DataFrame, label: str = "y", rounds: int = BOOSTING_ROUNDS, seed: int = SEED,
                 **settings) -> GBTClassificationModel:
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed,
                         **{**BOOSTING, **settings}).fit(vectors)


def score_rows(model, vectors: DataFrame, keep: Sequence[str] = ("app_id", "y")) -> DataFrame:
    """Probability of class 1 next to the kept columns."""
    return model.transform(vectors).select(*keep, vector_to_array("probability")[1].alias("p"))


def coefficient_table(spark: SparkSession, model: LogisticRegressionModel, names: Sequence[str]) -> DataFrame:
    """``(feature, coefficient)``, largest absolute value first."""
    rows = [(n, float(c)) for n, c in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature")


def optimality(model: LogisticRegressionModel, vectors: DataFrame, names: Sequence[str], label: str = "y", weight: str | None = None,
               C: float = 1.0) -> DataFrame:
    """Gradient of the fitted objective per coefficient: ``(feature, gradient)``; all are near 0 at the optimum.

    The sums over the rows are taken from the data again, a row per task and coefficient.
    """
    beta, size = model.coefficients.toArray(), len(names)

    def slopes(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                total += x.T @ ((1 / (1 + np.exp(-(x @ beta + model_intercept))) - pdf["y"].to_numpy(float)) * pdf["w"].to_numpy(float))
        yield pd.DataFrame({"i": np.arange(size), "slope": total})

    model_intercept = float(model.intercept)
    rows = vectors.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"),
                          (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    sums = rows.mapInPandas(slopes, "i int, slope double").groupBy("i").agg(F.sum("slope").alias("slope"))
    table = vectors.sparkSession.createDataFrame([(i, n, float(b) / C) for i, (n, b) in enumerate(zip(names, beta))], "i int, feature string, pull double")
    return table.join(sums, "i", "left").select("feature", (F.col("pull") + F.coalesce("slope", F.lit(0.0))).alias("gradient"))


@dataclass(frozen=True)
class Scorecard:
    """Preparation plus logistic model: fitted, saved and applied together."""

    spec: ColumnSpec
    prep: Preparation
    model: LogisticRegressionModel

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return self.prep.vectors(self.spec.with_flags(df), keep)

    def score(self, df: DataFrame, keep: Sequence[str] = ("app_id", "y")) -> DataFrame:
        return score_rows(self.model, self.vectors(df, keep), keep)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return coefficient_table(spark, self.model, self.prep.names)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/preparation")
        self.model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorecard:
        prep = Preparation.load(spark, f"{path}/preparation")
        flagged = tuple(f.removesuffix("_missing") for f in prep.flags)
        return cls(ColumnSpec(prep.numeric, flagged, prep.categorical), prep, LogisticRegressionModel.load(f"{path}/model"))


def fit_scorecard(train: DataFrame, spec: ColumnSpec, label: str = "y", balanced: bool = False) -> Scorecard:
    prep = spec.fit(train)
    extra = []
    if balanced:
        train, extra = with_class_weight(train, label), ["weight"]
    vectors = stage(prep.vectors(spec.with_flags(train), [label, *extra]), "train-vectors")
    return Scorecard(spec, prep, fit_logistic(vectors, label, "weight" if balanced else None))


def fit_oversampled(train: DataFrame, spec: ColumnSpec, label: str = "y", key: str = "app_id") -> Scorecard:
    """A scorecard fitted on the training rows plus synthetic minority rows; preparation sees the real rows only."""
    prep = spec.fit(train)
    rows = prep.vectors(spec.with_flags(train), [key, label]).select(key, label, vector_to_array("features").alias("x"))
    filled = oversample(stage(rows, "train-arrays"), label=label, key=key)
    vectors = stage(filled.select(label, array_to_vector("x").alias("features")), "oversampled")
    return Scorecard(spec, prep, fit_logistic(vectors, label))


def refit_comparison(train: DataFrame, val: DataFrame, spec: ColumnSpec, how: str, capacity: float = REVIEW_CAPACITY,
                     label: str = "y", key: str = "app_id") -> DataFrame:
    """What a ``balanced`` or ``oversampled`` refit changes against the plain fit; one row.

    Level (mean score), ranking (AUC, caught at capacity, recall), order (shared review
    list, rank correlation), whether the change is noise, and the verdict on keeping it.
    """
    fits = {"balanced": lambda: fit_scorecard(train, spec, label, True), "oversampled": lambda: fit_oversampled(train, spec, label, key)}
    plain = fit_scorecard(train, spec, label).score(val, [key, label])
    both = stage(align_scores(plain, fits[how]().score(val, [key, label]), key), "refit-scores")
    long = both.unpivot([key, label], ["p", "p2"], "model", "score")
    rows = {r["model"]: r for r in metric_block(stage(long, "refit-long"), capacity, "score", label, key, ["model"]).collect()}
    same = review_overlap(both, "p", "p2", capacity, key).first()
    rank = spearman(both, "p", "p2", key).first()["spearman"]
    level = both.agg(F.avg("p").alias("p"), F.avg("p2").alias("p2")).first()
    change = caught_change(both, "p", "p2", capacity, label, key)
    figures = {"mean_p_plain": level["p"], "mean_p_refit": level["p2"], "auc_plain": rows["p"]["auc"], "auc_refit": rows["p2"]["auc"],
               "recall_plain": rows["p"]["recall"], "recall_refit": rows["p2"]["recall"], "same": same["same"], "overlap": same["share"],
               "spearman": rank}
    return change.select(F.lit(how).alias("refit"), "caught_first", "caught_second", "diff", "noise", F.col("verdict").alias("noise_verdict"),
                         keep_band("diff").alias("verdict"), *[F.lit(v).alias(n) for n, v in figures.items()])


def weighted_comparison(train: DataFrame, val: DataFrame, spec: ColumnSpec, capacity: float = REVIEW_CAPACITY,
                        label: str = "y", key: str = "app_id") -> DataFrame:
    """Plain against class-balanced fit: one row per model with level and order figures."""
    parts = [fit_scorecard(train, spec, label, balanced).score(val, [key, label]).withColumn("model", F.lit(name))
             for name, balanced in (("plain", False), ("balanced", True))]
    scores = stage(parts[0].unionByName(parts[1]), "weighted-scores")
    level = scores.groupBy("model").agg(F.avg("p").alias("mean_p"), F.count_if(F.col("p") >= 0.5).alias("n_at_half"))
    order = metric_block(scores, capacity, "p", label, key, ["model"]).select("model", "tp", "recall", "auc")
    return level.join(order, "model")


def ablation(train: DataFrame, val: DataFrame, spec: ColumnSpec, drop: Sequence[str], capacity: float = REVIEW_CAPACITY,
             label: str = "y", key: str = "app_id", noise: float = ABLATION_NOISE) -> DataFrame:
    """Refit without some features and compare what is caught at capacity.

    The missing flag of a dropped column stays in the model.
    """
    unknown = [c for c in drop if c not in (*spec.numeric, *spec.categorical)]
    if unknown:
        raise ValueError(f"not in the model: {unknown}")
    reduced = ColumnSpec(tuple(c for c in spec.numeric if c not in drop), spec.flagged,
                         tuple(c for c in spec.categorical if c not in drop))
    without = "without " + ", ".join(drop)
    parts = [fit_scorecard(train, s, label).score(val, [key, label]).withColumn("model", F.lit(name))
             for name, s in (("baseline", spec), (without, reduced))]
    scores = stage(parts[0].unionByName(parts[1]), "ablation-scores")
    rows = metric_block(scores, capacity, "p", label, key, ["model"]).select(
        "model", F.col("tp").alias("caught"), "recall", "auc").collect()
    base = next(r for r in rows if r["model"] == "baseline")
    out = val.sparkSession.createDataFrame(rows, "model string, caught bigint, recall double, auc double")
    cost = F.lit(base["caught"]) - F.col("caught")
    return (out.withColumn("cost", cost)
            .withColumn("cost_pct", safe_ratio(cost * 100, F.lit(base["caught"])))
            .withColumn("auc_change", F.col("auc") - F.lit(base["auc"]))
            .withColumn("noise", F.lit(base["caught"] ** 0.5))
            .withColumn("verdict", noise_band("cost", noise)))


@dataclass(frozen=True)
class BoostedPrefix:
    """The leading trees of a boosted model that did best on the stop set."""

    forest: Forest
    best_round: int
    auc_by_round: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        rounds = [(i, float(a)) for i, a in enumerate(self.auc_by_round)]
        spark.createDataFrame(rounds, "round int, auc double").write.mode("overwrite").parquet(f"{path}/rounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedPrefix:
        forest = Forest.load(spark.read.parquet(f"{path}/nodes"))
        rounds = sorted(spark.read.parquet(f"{path}/rounds").collect(), key=lambda r: r["round"])
        return cls(forest, forest.n_trees, tuple(r["auc"] for r in rounds))


def best_prefix(forest: Forest, stop: DataFrame, label: str = "y", patience: int = STALE_ROUNDS,
                history: Sequence[float] = (), walk: Walk | None = None, block: int = 64) -> tuple[list[float], bool]:
    """AUC by round on the stop set, up to the round at which ``patience`` rounds brought nothing better.

    ``history`` holds the rounds already known, ``walk`` the rows' margins after some of them.
    Returns the longer history and whether it ended for lack of progress.  A stop set of one class has no AUC and is refused.
    """
    known, walk = list(history), walk or Walk(stop, label)
    while True:
        best = int(np.argmax(known)) if known else 0
        for r in range(best, len(known)):
            if r - best >= patience:
                return known[:r + 1], True
        if len(known) >= forest.n_trees:
            return known, False
        known += auc_by_round(forest, stop, len(known), min(len(known) + block, forest.n_trees), label, walk=walk)


def fit_boosted_prefix(vectors: DataFrame, label: str = "y", key: str = "app_id", rounds: int = BOOSTING_ROUNDS,
                       patience: int = STALE_ROUNDS, stop_share: float = STOP_SHARE, **settings) -> BoostedPrefix:
    """Boost on a stratified 85%, pick the prefix on the other 15%; validation rows take no part.

    A boosted model's first trees do not depend on how many follow, so rounds are fitted in
    steps, each four times the one before, until the stop set has seen ``patience`` rounds
    without progress or all ``rounds`` are there; a step beyond half of ``rounds`` takes them all.
    The result is that of one fit of all rounds; where all are needed, two thirds more at most
    are fitted, a quarter more with the default settings.
    """
    marked = stage(stratified_holdout(vectors, stop_share, label, key), "boost-train")
    train, stop = marked.where(~F.col("held_out")), marked.where("held_out")
    made, history, walk = min(rounds, 2 * (patience + 1)), [], Walk(stop, label)
    while True:
        forest = forest_of(fit_boosting(train, label, made, **settings))
        history, done = best_prefix(forest, stop, label, patience, history, walk)
        if done or made >= rounds:
            best = int(np.argmax(history)) + 1
            return BoostedPrefix(forest.prefix(best), best, tuple(history))
        made = 4 * made if 8 * made <= rounds else rounds


def model_bench(train: DataFrame, val: DataFrame, spec: ColumnSpec, capacity: float = REVIEW_CAPACITY, label: str = "y",
                key: str = "app_id", forest_settings: Mapping[str, object] | None = None,
                boosting_settings: Mapping[str, object] | None = None) -> DataFrame:
    """Logistic, forest and boosting on the same prepared rows, scored on the same validation rows."""
    prep = spec.fit(train)
    tv = stage(prep.vectors(spec.with_flags(train), [key, label]), "bench-train")
    vv = stage(prep.vectors(spec.with_flags(val), [key, label]), "bench-val")
    boosted = fit_boosted_prefix(tv, label, key, **(boosting_settings or {}))
    fits: dict[str, Callable[[], DataFrame]] = {
        "logistic": lambda: score_rows(fit_logistic(tv, label), vv, [key, label]),
        "forest": lambda: score_forest(fit_forest(tv, label, **(forest_settings or {})), vv, [key, label]),
        "boosting": lambda: boosted.forest.score(vv, [key, label]),
    }
    out = None
    for name, scores in fits.items():
        part = scores().withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    block = metric_block(stage(out, "bench-scores"), capacity, "p", label, key, ["model"])
    rows = block.select("model", F.col("tp").alias("caught"), "recall", "auc", "gini").collect()
    base = next(r["caught"] for r in rows if r["model"] == "logistic")
    table = val.sparkSession.createDataFrame(rows, "model string, caught bigint, recall double, auc double, gini double")
    gain = F.col("caught") - F.lit(base)
    return table.withColumn("gain", gain).withColumn(
        "verdict", F.when(F.col("model") == "logistic", "baseline").otherwise(challenger_band(gain)))
