"""Several model variants under the same audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.audit import MIN_DEFAULTS, amplification, segment_audit
from riskloom.operators.evaluation import metric_block
from riskloom.sources.policy import REVIEW_CAPACITY
from riskloom.staging import stage


def variant_audit(df: DataFrame, variants: Mapping[str, str], baseline: str, segments: Sequence[str],
                  share: float = REVIEW_CAPACITY, min_defaults: int = MIN_DEFAULTS, label: str = "y",
                  key: str = "app_id") -> DataFrame:
    """Caught, cost, Gini, and amplification and FPR gap per segment, one row per variant and segment.

    ``variants`` maps a name to a score column.
    """
    renamed = df.select(key, label, *segments, *[F.col(s).alias(n) for n, s in variants.items()])
    long = stage(renamed.unpivot([key, label, *segments], list(variants), "variant", "p"), "variants")
    head = metric_block(long, share, "p", label, key, ["variant"]).select("variant", "tp", "gini").collect()
    base = next(r["tp"] for r in head if r["variant"] == baseline)
    table = df.sparkSession.createDataFrame([(r["variant"], r["tp"], base - r["tp"], r["gini"]) for r in head],
                                            "variant string, caught bigint, cost bigint, gini double")
    groups = segment_audit(long, segments, share, min_defaults, "p", label, key, ["variant"])
    amp = amplification(groups, ["variant"]).select("variant", "segment", "amplification", "fpr_gap_pp")
    return table.join(amp, "variant", "left")


def group_fpr_change(groups: DataFrame, before: str, after: str, variant: str = "variant") -> DataFrame:
    """False positive rate of every audited group under two variants."""
    def fpr(which: str):
        return F.max(F.when(F.col(variant) == which, F.col("fpr")))
    return (groups.groupBy("segment", "grp").agg(fpr(before).alias("fpr_before"), fpr(after).alias("fpr_after"))
            .withColumn("change", F.col("fpr_after") - F.col("fpr_before")))
