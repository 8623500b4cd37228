"""Does one cut-off treat groups alike?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.functions.verdicts import amplification_band
from riskloom.operators.ranking import capacity_cuts, fit_layout
from riskloom.sources.policy import REVIEW_CAPACITY

MIN_DEFAULTS = 50


def segment_audit(df: DataFrame, segments: Sequence[str], share: float = REVIEW_CAPACITY,
                  min_defaults: int = MIN_DEFAULTS, score: str = "p", label: str = "y",
                  key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    """Per group of every segment: size, base rate, recall under the global cut, flag rate, FPR.

    All segments go through one unpivot and one map-side combined aggregate.
    Groups with fewer than ``min_defaults`` positives are left out.
    """
    layout = fit_layout(df, score, key, by)
    cuts = capacity_cuts(df, layout, [share])
    narrow = df.select(*by, F.col(label).cast("int").alias("y"), layout.above_by(cuts, 0).alias("reviewed"),
                       *[F.col(s).cast("string").alias(s) for s in segments])
    bad, rev = F.col("y") == 1, F.col("reviewed")
    sums = (narrow.unpivot([*by, "y", "reviewed"], list(segments), "segment", "grp")
            .where("grp is not null")
            .groupBy(*by, "segment", "grp")
            .agg(F.count(F.lit(1)).alias("people"), F.count_if(bad).alias("defaults"),
                 F.count_if(rev).alias("flagged"), F.count_if(bad & rev).alias("caught"))
            .where(F.col("defaults") >= min_defaults))
    good = F.col("people") - F.col("defaults")
    return (sums.select(*by, "segment", "grp", "people", "defaults",
                        safe_ratio(F.col("defaults"), F.col("people")).alias("base_rate"),
                        safe_ratio(F.col("caught"), F.col("defaults")).alias("recall"),
                        safe_ratio(F.col("flagged"), F.col("people")).alias("flag_rate"),
                        safe_ratio(F.col("flagged") - F.col("caught"), good).alias("fpr"))
            .orderBy(*by, "segment", F.desc("recall")))


def recall_spread(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best minus worst group recall per segment, percentage points."""
    return audit.groupBy(*by, "segment").agg(((F.max("recall") - F.min("recall")) * 100).alias("spread_pp"))


def tpr_gap(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall of the most and least flagged group per segment and their difference."""
    return (_extremes(audit, by)
            .select(*by, "segment", F.col("hi.grp").alias("most_flagged"), F.col("lo.grp").alias("least_flagged"),
                    (F.col("hi.recall") - F.col("lo.recall")).alias("tpr_gap")))


def _extremes(audit: DataFrame, by: Sequence[str]) -> DataFrame:
    row = F.struct("flag_rate", "grp", "base_rate", "fpr", "recall")
    return audit.groupBy(*by, "segment").agg(F.max(row).alias("hi"), F.min(row).alias("lo"))


def amplification(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flag-rate ratio over risk ratio of the most and least flagged groups.

    Segments whose least flagged group has no defaults or no flags are skipped;
    equal flag rates are ordered by group name.
    """
    return (_extremes(audit, by).where("lo.base_rate > 0 and lo.flag_rate > 0")
            .select(*by, "segment", F.col("hi.grp").alias("most_flagged"), F.col("lo.grp").alias("least_flagged"),
                    (F.col("hi.base_rate") / F.col("lo.base_rate")).alias("risk_ratio"),
                    (F.col("hi.flag_rate") / F.col("lo.flag_rate")).alias("flag_ratio"),
                    ((F.col("hi.fpr") - F.col("lo.fpr")) * 100).alias("fpr_gap_pp"))
            .withColumn("amplification", F.try_divide("flag_ratio", "risk_ratio"))
            .withColumn("verdict", amplification_band("amplification")))
