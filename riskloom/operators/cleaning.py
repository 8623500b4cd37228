"""Impossible values, missing flags, and which columns earn a flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import outside

Limits = Mapping[str, Mapping[str, float]]


def clear_impossible(df: DataFrame, limits: Limits) -> DataFrame:
    """Values outside their limits become NULL; the row and its other values stay."""
    return df.withColumns({c: F.when(~outside(c, rule), F.col(c)) for c, rule in limits.items()})


def cleared_counts(df: DataFrame, limits: Limits) -> DataFrame:
    """How many values each rule clears, from the uncleaned rows."""
    sums = df.agg(*[F.count_if(outside(c, rule)).alias(c) for c, rule in limits.items()])
    return sums.unpivot([], list(limits), "column", "n_cleared")


def add_missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_missing`` as 0/1."""
    return df.withColumns({f"{c}_missing": F.isnull(c).cast("int") for c in columns})


def flag_eligibility(null_rates: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Columns blank in at least ``threshold`` of the rows; input is a null-rate table."""
    return null_rates.withColumn("eligible", F.col("null_rate") >= threshold)
