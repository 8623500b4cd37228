"""What review capacity costs and finds, in money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.operators.ranking import capacity_cuts, fit_layout
from riskloom.sources.policy import REVIEW_CAPACITY

# Cost assumptions of the published break-even tables.
REVIEW_COST = 50.0
LGD = 0.65
COSTS = (25.0, 50.0, 100.0)
LGDS = (0.55, 0.65, 0.80)
BREAK_EVEN_SHARES = (0.01, 0.05, 0.10, 0.20, 0.50)


def money_recall(df: DataFrame, share: float = REVIEW_CAPACITY, amount: str = "loan_amnt", score: str = "p",
                 label: str = "y", key: str = "app_id") -> DataFrame:
    """Mean amount of caught and missed defaults, recall by count and by amount."""
    layout = fit_layout(df, score, key)
    rev = layout.above(capacity_cuts(df, layout, [share])[()][0])
    bad = F.col(label) == 1
    amt = F.col(amount)
    return df.agg(
        F.avg(F.when(bad & rev, amt)).alias("mean_caught"),
        F.avg(F.when(bad & ~rev, amt)).alias("mean_missed"),
        safe_ratio(F.count_if(bad & rev), F.count_if(bad)).alias("recall_count"),
        F.try_divide(F.coalesce(F.sum(F.when(bad & rev, amt)), F.lit(0.0)), F.sum(F.when(bad, amt))).alias("recall_money"))


def break_even(df: DataFrame, shares: Sequence[float] = BREAK_EVEN_SHARES, cost: float = REVIEW_COST, lgd: float = LGD,
               chosen: float = REVIEW_CAPACITY, amount: str = "loan_amnt", score: str = "p", label: str = "y",
               key: str = "app_id") -> DataFrame:
    """Per review share: reviews, exposure caught, cost, loss found, share of it that must be prevented."""
    layout = fit_layout(df, score, key)
    cuts = capacity_cuts(df, layout, shares)
    flags = [layout.above_by(cuts, i) for i in range(len(shares))]
    bad = F.col(label) == 1
    sums = df.agg(
        *[F.count_if(f).alias(f"k{i}") for i, f in enumerate(flags)],
        *[F.coalesce(F.sum(F.when(bad & f, F.col(amount))), F.lit(0.0)).alias(f"e{i}") for i, f in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(float(s)).alias("capacity"), F.col(f"k{i}").alias("reviews"),
                              F.col(f"e{i}").alias("exposure"), F.lit(abs(s - chosen) < 1e-9).alias("chosen"))
                     for i, s in enumerate(shares)])
    return (sums.select(F.inline(rows))
            .withColumn("cost", F.col("reviews") * F.lit(cost))
            .withColumn("loss_found", F.col("exposure") * F.lit(lgd))
            .withColumn("break_even", F.try_divide("cost", "loss_found"))
            .select("capacity", "reviews", "exposure", "cost", "loss_found", "break_even", "chosen"))


def best_break_even(table: DataFrame) -> DataFrame:
    """The share with the lowest break-even; the smaller share wins a tie."""
    return (table.agg(F.min(F.when(F.col("break_even").isNotNull(), F.struct("break_even", "capacity"))).alias("best"))
            .select(F.col("best.capacity").alias("capacity"), F.col("best.break_even").alias("break_even")))


def sensitivity_grid(df: DataFrame, share: float = REVIEW_CAPACITY, costs: Sequence[float] = COSTS,
                     lgds: Sequence[float] = LGDS, amount: str = "loan_amnt", score: str = "p", label: str = "y",
                     key: str = "app_id") -> DataFrame:
    """Break-even at one share for every review cost x loss rate; the grid is laid over one aggregate row."""
    base = break_even(df, [share], amount=amount, score=score, label=label, key=key)
    cells = F.array(*[F.struct(F.lit(c).alias("review_cost"), F.lit(g).alias("lgd")) for c in costs for g in lgds])
    return (base.select("reviews", "exposure", F.inline(cells))
            .select("review_cost", "lgd", F.try_divide(F.col("reviews") * F.col("review_cost"),
                                                       F.col("exposure") * F.col("lgd")).alias("break_even")))
