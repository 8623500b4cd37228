"""Has the population moved?  PSI and categories never seen before."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.verdicts import PSI_MODERATE, psi_band
from riskloom.operators.quantiles import exact_quantiles
from riskloom.staging import stage

FLOOR = 1e-6
SIDE = "__expected"


def two_sides(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both samples in one frame with a boolean side column."""
    return (expected.select(*columns, F.lit(True).alias(SIDE))
            .unionByName(actual.select(*columns, F.lit(False).alias(SIDE))))


def psi_numeric(both: DataFrame, columns: Sequence[str], bins: int = 10, side: str = SIDE) -> DataFrame:
    """PSI per numeric column over quantile bins of the expected side.

    Bins are left-closed with open outer edges; empty bins count as 1e-6; fewer
    than three distinct edges give 0; a side without values gives NULL.  All
    columns share one unpivot and one map-side combined count.
    """
    spark = both.sparkSession
    cols = list(columns)
    probs = [i / bins for i in range(bins + 1)]
    quantiles = exact_quantiles(both.where(F.col(side)), cols, probs)
    inner = {}
    for c in cols:
        edges = sorted({q for q in quantiles[c] if q is not None})
        inner[c] = edges[1:-1] if len(edges) >= 3 else []
    ids = [f"__x{i}" for i in range(len(cols))]
    outs = [f"__b{i}" for i in range(len(cols))]
    binned = both.select(side, *[(F.col(c).cast("double") + F.lit(0.0)).alias(x) for c, x in zip(cols, ids)])
    splits = [[-math.inf, *(e + 0.0 for e in inner[c]), math.inf] if inner[c] else [-math.inf, 0.0, math.inf] for c in cols]
    binned = Bucketizer(inputCols=ids, outputCols=outs, splitsArray=splits, handleInvalid="keep").transform(binned)
    place = {c: F.when(F.col(x).isNotNull(), F.col(b) if inner[c] else F.lit(0.0)).cast("int")
             for c, x, b in zip(cols, ids, outs)}
    long = (binned.select(side, *[p.alias(c) for c, p in place.items()])
            .unpivot([side], cols, "feature", "bin").where("bin is not null"))
    counts = long.groupBy("feature", "bin").agg(F.count_if(F.col(side)).alias("e"), F.count_if(~F.col(side)).alias("a"))
    grid = spark.createDataFrame([(c, b) for c in cols for b in range(len(inner[c]) + 1)], "feature string, bin int")
    filled = (grid.join(counts, ["feature", "bin"], "left")
              .select("feature", "bin", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("a", F.lit(0)).alias("a")))
    return _psi(filled)


def psi_categorical(both: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """PSI per text column over the union of the categories, NULLs left out."""
    long = (both.select(side, *[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([side], list(columns), "feature", "bin").where("bin is not null"))
    return _psi(long.groupBy("feature", "bin").agg(F.count_if(F.col(side)).alias("e"), F.count_if(~F.col(side)).alias("a")))


def _psi(counts: DataFrame) -> DataFrame:
    """PSI from ``(feature, bin, e, a)`` counts.

    The counts feed both the totals and the terms, so they are staged: the input
    is scanned once however the two uses are planned.
    """
    counts = stage(counts, "psi-counts")
    totals = counts.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    e = F.greatest(F.try_divide(F.col("e").cast("double"), F.col("te").cast("double")), F.lit(FLOOR))
    a = F.greatest(F.try_divide(F.col("a").cast("double"), F.col("ta").cast("double")), F.lit(FLOOR))
    both_known = (F.col("te") > 0) & (F.col("ta") > 0)
    return (counts.join(totals, "feature")
            .select("feature", F.when(both_known, (a - e) * F.ln(a / e)).alias("term"))
            .groupBy("feature").agg(F.sum("term").alias("psi")))


def psi_report(psi: DataFrame, top: int = 5) -> DataFrame:
    """Largest values with their band; features without a value are left out."""
    return (psi.where("psi is not null").orderBy(F.desc("psi"), "feature").limit(top)
            .withColumn("band", psi_band("psi")))


def psi_summary(psi: DataFrame) -> DataFrame:
    known = psi.where("psi is not null")
    return known.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("psi") >= PSI_MODERATE).alias("n_moved"))


def unseen_categories(reference: DataFrame, candidate: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per candidate category that the reference never had; columns absent on a side are skipped."""
    shared = [c for c in columns if c in reference.columns and c in candidate.columns]
    if not shared:
        return candidate.sparkSession.createDataFrame([], "column string, value string, n bigint")

    def long(df: DataFrame) -> DataFrame:
        return (df.select(*[F.col(c).cast("string").alias(c) for c in shared])
                .unpivot([], shared, "column", "value").where("value is not null"))
    known = long(reference).distinct()
    counts = long(candidate).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, ["column", "value"], "left_anti")


def category_union(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Distinct categories of both frames."""
    return (first.select(F.col(column).alias("value")).union(second.select(F.col(column).alias("value")))
            .where("value is not null").distinct())
