"""Bands fixed before a run, applied to metric rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.scalars import as_col

# Bounds that decide the published verdicts.
PSI_MODERATE = 0.10
PSI_SIGNIFICANT = 0.25
AMPLIFICATION_REVIEW = 2.0
RESAMPLE_BAR = 50
MODEL_REJECT_BELOW = 50
MODEL_RECONSIDER_FROM = 250
ABLATION_NOISE = 41
# Cost above which a feature stays, for a direct and for a sensitive feature.
REMOVAL_KEEP, REMOVAL_KEEP_SENSITIVE = 100, 150


def psi_band(value: Column | str) -> Column:
    v = as_col(value)
    return (F.when(v < PSI_MODERATE, "stable")
            .when(v < PSI_SIGNIFICANT, "moderate")
            .when(v.isNotNull(), "significant"))


def noise_band(diff: Column | str, noise: Column | str | float = ABLATION_NOISE) -> Column:
    """Is a change in a count smaller than its sampling noise?"""
    n = F.lit(noise) if isinstance(noise, (int, float)) else as_col(noise)
    return F.when(F.abs(as_col(diff)) < n, "within noise").otherwise("outside noise")


def removal_band(cost: Column | str, keep_above: float, noise: Column | str | float = ABLATION_NOISE) -> Column:
    """What to do with a feature whose removal costs so many caught cases: three steps, the upper one fixed per feature."""
    c = as_col(cost)
    n = F.lit(noise) if isinstance(noise, (int, float)) else as_col(noise)
    return F.when(c < n, "drop").when(c <= keep_above, "weigh up").when(c.isNotNull(), "keep")


def challenger_band(gain: Column | str, reject_below: int = MODEL_REJECT_BELOW,
                    reconsider_from: int = MODEL_RECONSIDER_FROM) -> Column:
    g = as_col(gain)
    return (F.when(g < reject_below, "reject")
            .when(g < reconsider_from, "challenger")
            .otherwise("reconsider"))


def keep_band(gain: Column | str, bar: int = RESAMPLE_BAR) -> Column:
    return F.when(as_col(gain) >= bar, "keep").otherwise("reject")


def amplification_band(value: Column | str) -> Column:
    return F.when(as_col(value) >= AMPLIFICATION_REVIEW, "review").otherwise("ok")


def zero_band(low: Column | str) -> Column:
    """Does an interval for a gain lie above zero?"""
    return F.when(as_col(low) > 0, "excludes zero").otherwise("includes zero")
