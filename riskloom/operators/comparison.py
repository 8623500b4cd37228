"""Two scores on the same rows: overlap of review lists, rank correlation, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.functions.verdicts import noise_band
from riskloom.operators.ranking import average_rank, capacity_cuts, fit_layout
from riskloom.sources.policy import REVIEW_CAPACITY
from riskloom.staging import stage


def align_scores(first: DataFrame, second: DataFrame, key: str = "app_id", first_name: str = "p",
                 second_name: str = "p2", score: str = "p") -> DataFrame:
    """Rows both models scored, one column per model."""
    return first.withColumnRenamed(score, first_name).join(
        second.select(key, F.col(score).alias(second_name)), key)


def _two_flags(df: DataFrame, first: str, second: str, share: float, key: str):
    flags = []
    for score in (first, second):
        layout = fit_layout(df, score, key)
        flags.append(layout.above(capacity_cuts(df, layout, [share])[()][0]))
    return flags


def review_overlap(df: DataFrame, first: str = "p", second: str = "p2", share: float = REVIEW_CAPACITY,
                   key: str = "app_id") -> DataFrame:
    """How many rows both scores send to review."""
    a, b = _two_flags(df, first, second, share, key)
    out = df.agg(F.count_if(a).alias("k"), F.count_if(a & b).alias("same"))
    return out.withColumn("share", safe_ratio(F.col("same"), F.col("k")))


def spearman(df: DataFrame, first: str = "p", second: str = "p2", key: str = "app_id") -> DataFrame:
    """Rank correlation with ties at their mean rank."""
    ranked = average_rank(df.select(key, first, second), first, key, "rank_first")
    ranked = stage(ranked, "ranks")
    both = average_rank(ranked, second, key, "rank_second")
    return both.agg(F.corr("rank_first", "rank_second").alias("spearman"))


def caught_change(df: DataFrame, first: str = "p", second: str = "p2", share: float = REVIEW_CAPACITY,
                  label: str = "y", key: str = "app_id") -> DataFrame:
    """Positives caught by each score, the change, and the sqrt-of-count noise rule."""
    a, b = _two_flags(df, first, second, share, key)
    hit = F.col(label) == 1
    out = df.agg(F.count_if(a & hit).alias("caught_first"), F.count_if(b & hit).alias("caught_second"))
    return (out.withColumn("diff", F.col("caught_second") - F.col("caught_first"))
            .withColumn("relative_pct", safe_ratio(F.col("diff") * 100, F.col("caught_first")))
            .withColumn("noise", F.sqrt("caught_first"))
            .withColumn("verdict", noise_band("diff", "noise")))
