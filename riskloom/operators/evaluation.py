"""Ranking metrics: confusion at capacity, AUC, Gini, KS, curves, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.operators.ranking import (RANGE, SLOT, Layout, capacity_cuts, cumulative_shares, fit_layout,
                                        half_even_k, sized_broadcast, with_decile)
from riskloom.sources.policy import REVIEW_CAPACITY

CURVE_SHARES = (0.01, 0.05, 0.10, 0.20, 0.50, 1.00)
POS, NEG = "__pos", "__neg"


def with_classes(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(POS, F.col(label).cast("bigint")).withColumn(NEG, 1 - F.col(POS))


def class_layout(df: DataFrame, score: str, key: str, by: Sequence[str]) -> Layout:
    return fit_layout(df, score, key, by, measures=[POS, NEG])


def _types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _merge(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Put one-row-per-group results side by side without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cols = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in cols])


def _confusion(df: DataFrame, flag: Column, by: Sequence[str]) -> DataFrame:
    hit = F.col(POS) == 1
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(POS).alias("n_def"),
        F.count_if(flag).alias("k"),
        F.count_if(flag & hit).alias("tp"),
        F.count_if(flag & ~hit).alias("fp"),
        F.count_if(~flag & hit).alias("fn"),
        F.count_if(~flag & ~hit).alias("tn"))


def confusion(df: DataFrame, capacity: float = REVIEW_CAPACITY, score: str = "p", label: str = "y",
              key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix with the riskiest ``capacity`` reviewed."""
    df = with_classes(df, label)
    layout = class_layout(df, score, key, by)
    cuts = capacity_cuts(df, layout, [capacity])
    return _confusion(df, layout.above_by(cuts, 0), by)


def add_rates(conf: DataFrame, capacity: float = REVIEW_CAPACITY) -> DataFrame:
    """Recall, precision and lift from confusion counts."""
    recall = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (conf.withColumn("recall", recall)
            .withColumn("precision", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("lift", recall / F.lit(capacity)))


def _auc(df: DataFrame, layout: Layout, by: Sequence[str]) -> DataFrame:
    """Share of concordant pairs, ties half, from counts per distinct score.

    Counts are combined map-side, so a score shared by many rows costs one row.
    """
    ties = layout.slotted(df).groupBy(*by, RANGE, layout.score).agg(F.sum(POS).alias("pos"), F.sum(NEG).alias("neg"))
    w = (Window.partitionBy(*by, RANGE).orderBy(F.asc_nulls_first(layout.score))
         .rowsBetween(Window.unboundedPreceding, -1))
    table = layout.range_table(df.sparkSession, NEG, _types(df))
    below = F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col(f"after_{NEG}")
    pairs = (ties.join(table, [*by, RANGE])
             .withColumn("conc", F.col("pos") * (below + F.col("neg") / 2.0)))
    auc = F.try_divide(F.sum("conc"), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    return pairs.groupBy(*by).agg(auc.alias("auc")).withColumn("gini", 2 * F.col("auc") - 1)


def auc_gini(df: DataFrame, score: str = "p", label: str = "y", key: str = "app_id",
             by: Sequence[str] = ()) -> DataFrame:
    df = with_classes(df, label)
    return _auc(df, class_layout(df, score, None, by), by)


def _ks(df: DataFrame, layout: Layout, by: Sequence[str]) -> DataFrame:
    """Largest gap of the cumulative shares over rows, and its first depth.

    A slot can reach at most its starting gap plus all its positives; slots whose
    bound lies under a gap already reached elsewhere are not read again.
    """
    sizes = layout.group_sizes()
    offs = [r for r in layout.offsets() if sizes[r["by"]][POS] and sizes[r["by"]][NEG]]
    best: dict[tuple, float] = {}
    for r in offs:
        P, N = sizes[r["by"]][POS], sizes[r["by"]][NEG]
        end = (r[f"before_{POS}"] + r[POS]) / P - (r[f"before_{NEG}"] + r[NEG]) / N
        best[r["by"]] = max(best.get(r["by"], -1.0), end)
    rows = []
    for r in offs:
        P, N = sizes[r["by"]][POS], sizes[r["by"]][NEG]
        bound = (r[f"before_{POS}"] + r[POS]) / P - r[f"before_{NEG}"] / N
        if bound >= best[r["by"]] - 1e-9:
            rows.append((*r["by"], r["slot"], r["before_n"], r[f"before_{POS}"], r[f"before_{NEG}"],
                         float(P), float(N)))
    types = _types(df)
    schema = ", ".join([*[f"`{b}` {types[b]}" for b in by], f"{SLOT} bigint", "bn bigint", "bp bigint", "bg bigint",
                        "tp double", "tn double"])
    table = df.sparkSession.createDataFrame(rows, schema)
    w = layout.window()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = ((F.sum(POS).over(run) + F.col("bp")).cast("double") / F.col("tp")
           - (F.sum(NEG).over(run) + F.col("bg")).cast("double") / F.col("tn"))
    inside = (layout.slotted(df).join(sized_broadcast(table, len(rows)), [*by, SLOT])
              .select(*by, gap.alias("gap"), (F.row_number().over(w) + F.col("bn")).alias("rank"),
                      (F.col("tp") + F.col("tn")).alias("size")))
    top = inside.groupBy(*by).agg(F.max(F.struct(F.col("gap"), -F.col("rank"), F.col("size"))).alias("top"))
    return top.select(*by, F.col("top.gap").alias("ks"), (-F.col("top.col2")).cast("bigint").alias("ks_rank"),
                      (-F.col("top.col2") / F.col("top.size")).alias("ks_depth"))


def ks(df: DataFrame, score: str = "p", label: str = "y", key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    df = with_classes(df, label)
    return _ks(df, class_layout(df, score, key, by), by)


def metric_block(df: DataFrame, capacity: float = REVIEW_CAPACITY, score: str = "p", label: str = "y",
                 key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    """All headline metrics, one row per group; KS in points (x100) as usually quoted."""
    df = with_classes(df, label)
    layout = class_layout(df, score, key, by)
    cuts = capacity_cuts(df, layout, [capacity])
    conf = add_rates(_confusion(df, layout.above_by(cuts, 0), by), capacity)
    gap = _ks(df, layout, by).select(*by, (F.col("ks") * 100).alias("ks"))
    return _merge([conf, _auc(df, layout, by), gap], by)


def capacity_curve(df: DataFrame, shares: Sequence[float] = CURVE_SHARES, chosen: float = REVIEW_CAPACITY,
                   score: str = "p", label: str = "y", key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    """Caught, recall, precision and lift at several review shares, one aggregate for all."""
    df = with_classes(df, label)
    layout = class_layout(df, score, key, by)
    cuts = capacity_cuts(df, layout, shares)
    flags = [layout.above_by(cuts, i) for i in range(len(shares))]
    sums = df.groupBy(*by).agg(
        F.sum(POS).alias("n_def"),
        *[F.count_if(f).alias(f"k{i}") for i, f in enumerate(flags)],
        *[F.sum(F.when(f, F.col(POS)).otherwise(0)).alias(f"c{i}") for i, f in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("capacity"), F.col(f"k{i}").alias("k"),
                              F.col(f"c{i}").alias("caught"), F.lit(abs(s - chosen) < 1e-9).alias("chosen"))
                     for i, s in enumerate(shares)])
    recall = safe_ratio(F.col("caught"), F.col("n_def"))
    return (sums.select(*by, "n_def", F.inline(rows))
            .select(*by, "capacity", "k", "caught", recall.alias("recall"),
                    safe_ratio(F.col("caught"), F.col("k")).alias("precision"),
                    (recall / F.col("capacity")).alias("lift"), "chosen"))


def roc_points(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """False and true positive share at every distinct score, plus the origin (NULL threshold)."""
    df = with_classes(df, label)
    layout = class_layout(df, score, None, ())
    sizes = layout.group_sizes().get((), {POS: 0, NEG: 0})
    ties = layout.slotted(df).groupBy(RANGE, score).agg(F.sum(POS).alias("pos"), F.sum(NEG).alias("neg"))
    w = Window.partitionBy(RANGE).orderBy(F.asc_nulls_first(score)).rowsBetween(Window.unboundedPreceding, -1)
    spark, types = df.sparkSession, _types(df)
    out = (ties.join(layout.range_table(spark, POS, types), RANGE)
           .join(layout.range_table(spark, NEG, types), RANGE))
    P, N = float(sizes[POS]), float(sizes[NEG])
    tp = F.lit(P) - F.col(f"after_{POS}") - F.coalesce(F.sum("pos").over(w), F.lit(0))
    fp = F.lit(N) - F.col(f"after_{NEG}") - F.coalesce(F.sum("neg").over(w), F.lit(0))
    points = out.select(F.col(score).alias("threshold"), F.try_divide(fp, F.lit(N)).alias("fpr"),
                        F.try_divide(tp, F.lit(P)).alias("tpr"))
    origin = spark.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def gains_points(df: DataFrame, score: str = "p", label: str = "y", key: str = "app_id",
                 depths: Sequence[float] | None = None) -> DataFrame:
    """Depth against cumulative shares at every rank, or at the ranks nearest to given ``depths``."""
    n = df.count()
    curve = cumulative_shares(df, score, key, label)
    if depths is not None:
        curve = curve.where(F.col("rank").isin([half_even_k(n, d) for d in depths]))
    return (curve.select("rank", (F.col("rank") / F.lit(float(max(n, 1)))).alias("depth"), "share_pos", "share_neg"))


def calibration(df: DataFrame, parts: int = 10, score: str = "p", label: str = "y", key: str = "app_id",
                by: Sequence[str] = ()) -> DataFrame:
    """Mean score against observed rate per decile; the ratio is NULL where nothing was observed."""
    binned = with_decile(df, score, key, by, parts)
    predicted, observed = F.avg(score), F.avg(F.col(label).cast("double"))
    return (binned.groupBy(*by, "decile")
            .agg(F.count(F.lit(1)).alias("n"), predicted.alias("predicted"), observed.alias("observed"))
            .withColumn("ratio", F.try_divide(F.col("predicted"), F.col("observed"))))


def score_summary(df: DataFrame, score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(score).alias("mean_p"), F.max(score).alias("max_p"),
                               F.count_if(F.col(score) >= 0.5).alias("n_at_half"))


def score_histogram(df: DataFrame, score: str = "p", label: str = "y", bins: int = 59,
                    floor_max: float = 0.35) -> DataFrame:
    """Count and density per class over equal bins from 0 to the largest score, empty ones too; the last bin is closed."""
    top = df.agg(F.max(score)).first()[0]
    width = max(top or 0.0, floor_max) / bins
    b = F.least(F.floor(F.col(score) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(F.col(label).alias("y"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("y").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counts = (grid.join(counts.where("bin is not null"), ["y", "bin"], "left")
              .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy("y"))
    return counts.withColumn("density", F.try_divide(F.col("n"), total * F.lit(width)))


def pile_gap(metrics: DataFrame, group: str, first: str, second: str, by: Sequence[str] = (),
             names: Sequence[str] = ("tp", "recall", "precision", "auc", "gini", "ks", "lift")) -> DataFrame:
    """Metric rows of two groups side by side with second minus first."""
    stacked = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    long = metrics.where(F.col(group).isin(first, second)).select(*by, group, F.inline(stacked))

    def value(which: str) -> Column:
        return F.max(F.when(F.col(group) == which, F.col("value")))
    return (long.groupBy(*by, "metric").agg(value(first).alias(first), value(second).alias(second))
            .withColumn("gap", F.col(second) - F.col(first)))


def model_delta(metrics: DataFrame, model: str, champion: str, challenger: str) -> DataFrame:
    """Extra defaulters caught and the two Ginis, one row."""
    def value(which: str, name: str) -> Column:
        return F.max(F.when(F.col(model) == which, F.col(name)))
    return metrics.agg(
        (value(challenger, "tp") - value(champion, "tp")).alias("extra_caught"),
        value(champion, "gini").alias("gini_champion"),
        value(challenger, "gini").alias("gini_challenger"),
        (value(challenger, "gini") - value(champion, "gini")).alias("gini_gain"))
