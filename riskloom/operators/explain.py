"""Why a row got its score: per-row and overall attributions in log-odds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import sigmoid
from riskloom.operators.models import Scorecard
from riskloom.operators.splitting import fixed_sample
from riskloom.operators.trees import Forest, attributions

SAMPLE_ROWS = 5000
ROW_TOP, GLOBAL_TOP = 8, 15


def encoded_means(matrix: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Average of every encoded column; the baseline of a linear attribution."""
    row = matrix.agg(*[F.avg(n).alias(f"a{i}") for i, n in enumerate(names)]).first()
    return {n: row[f"a{i}"] for i, n in enumerate(names)}


def top_contributions(df: DataFrame, phi: Mapping[str, Column], n: int = ROW_TOP, keep: Sequence[str] = ("app_id",),
                      raw: Mapping[str, Column] | None = None) -> DataFrame:
    """The ``n`` largest absolute contributions of every row, with place, raw value and direction.

    They are sorted inside the row as one array, so no row is moved.
    """
    raw = raw or {}
    items = F.array(*[F.struct((-F.abs(expr)).alias("order"), F.lit(name).alias("feature"), expr.alias("phi"),
                               raw.get(name, F.lit("")).cast("string").alias("raw_value")) for name, expr in phi.items()])
    best = F.slice(F.array_sort(items), 1, n)
    return (df.select(*keep, F.posexplode(best).alias("i", "t"))
            .select(*keep, (F.col("i") + 1).alias("place"), F.col("t.feature").alias("feature"),
                    F.col("t.raw_value").alias("raw_value"), F.col("t.phi").alias("phi"),
                    F.when(F.col("t.phi") > 0, "up").otherwise("down").alias("direction")))


def linear_attribution(df: DataFrame, coefficients: Mapping[str, float], encoded: Mapping[str, Column],
                       means: Mapping[str, float], n: int = ROW_TOP, keep: Sequence[str] = ("app_id",),
                       raw: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact contributions b_j (x_j - mean_j) of a linear model, top ``n`` per row."""
    phi = {f: F.lit(float(b)) * (encoded[f] - F.lit(means[f])) for f, b in coefficients.items()}
    return top_contributions(df, phi, n, keep, raw)


def scorecard_attribution(card: Scorecard, reference: DataFrame, rows: DataFrame, n: int = ROW_TOP,
                          keep: Sequence[str] = ("app_id",)) -> DataFrame:
    """``linear_attribution`` of a fitted scorecard against the mean of ``reference``."""
    names = card.prep.names
    means = encoded_means(card.prep.matrix(card.spec.with_flags(reference)), names)
    encoded = dict(zip(names, card.prep.encoded()))
    coefs = dict(zip(names, card.model.coefficients.toArray()))
    raw = {c: F.col(c) for c in card.prep.numeric}
    return linear_attribution(card.spec.with_flags(rows), coefs, encoded, means, n, keep, raw)


def scorecard_additivity(card: Scorecard, reference: DataFrame, rows: DataFrame, key: str = "app_id") -> DataFrame:
    """Per row: contributions plus the base of the reference rows, the log-odds, and how far they are apart."""
    names = card.prep.names
    means = encoded_means(card.prep.matrix(card.spec.with_flags(reference)), names)
    coefs = dict(zip(names, card.model.coefficients.toArray()))
    base = float(card.model.intercept) + sum(float(b) * means[f] for f, b in coefs.items())
    phi = scorecard_attribution(card, reference, rows, len(names), [key]).groupBy(key).agg((F.sum("phi") + F.lit(base)).alias("total"))
    odds = card.score(rows, [key]).select(key, F.ln(F.col("p") / (1 - F.col("p"))).alias("margin"))
    return phi.join(odds, key).select(key, F.abs(F.col("total") - F.col("margin")).alias("error"))


def tree_attribution(forest: Forest, vectors: DataFrame, names: Sequence[str], n: int = ROW_TOP,
                     keep: Sequence[str] = ("app_id",), raw: Mapping[str, Column] | None = None) -> DataFrame:
    """Top ``n`` Shapley contributions of a boosted model per row."""
    phi = attributions(forest, vectors, keep)
    return top_contributions(phi, {f: F.col("phi")[i] for i, f in enumerate(names)}, n, keep, raw)


def additivity(forest: Forest, vectors: DataFrame, keep: Sequence[str] = ("app_id",)) -> DataFrame:
    """Per row: contributions plus base, the margin, and how far they are apart."""
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v) + F.lit(forest.base())
    return (attributions(forest, vectors, keep).select(*keep, total.alias("total"), "margin")
            .withColumn("error", F.abs(F.col("total") - F.col("margin"))))


def global_attribution(forest: Forest, vectors: DataFrame, names: Sequence[str], key: str = "app_id",
                       sample: int = SAMPLE_ROWS, top: int = GLOBAL_TOP) -> DataFrame:
    """Mean absolute contribution per feature over a fixed-size hash sample."""
    phi = attributions(forest, fixed_sample(vectors, sample, key), [key])
    labels = F.array(*[F.lit(f) for f in names])
    return (phi.select(F.posexplode("phi").alias("i", "v"))
            .groupBy(F.element_at(labels, F.col("i") + 1).alias("feature"))
            .agg(F.avg(F.abs("v")).alias("mean_abs"))
            .orderBy(F.desc("mean_abs"), "feature").limit(top))


def base_risk(forest: Forest, spark) -> DataFrame:
    """Probability at the expected margin."""
    one = spark.createDataFrame([(forest.base(),)], "base_margin double")
    return one.withColumn("base_risk", sigmoid("base_margin"))
