"""Outcome label from a snapshot, and how far its assumptions move it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.dates import in_months, month_display, parse_month, whole_months
from riskloom.functions.scalars import safe_ratio
from riskloom.sources.policy import FAILED_STATUSES, LABEL_CUTOFF, SENSITIVITY_CUTOFFS, TARGET_COLUMN


def with_dates(raw: DataFrame, issue: str = "issue_d", last_payment: str = "last_pymnt_d") -> DataFrame:
    """Add ``issue_dt``, ``last_pymnt_dt`` and ``m``, the whole months between them."""
    return (raw.withColumns({"issue_dt": parse_month(issue), "last_pymnt_dt": parse_month(last_payment)})
            .withColumn("m", whole_months("issue_dt", "last_pymnt_dt")))


def failed(status: str = "loan_status", statuses: Sequence[str] = FAILED_STATUSES) -> Column:
    return F.col(status).isin(list(statuses))


def failed_within(cutoff: int | Column, status: str = "loan_status", months: str = "m",
                  statuses: Sequence[str] = FAILED_STATUSES) -> Column:
    """1 if the loan failed and the last payment came within ``cutoff`` months or never."""
    paid_until = F.coalesce(F.col(months) <= cutoff, F.lit(True))
    return F.coalesce(failed(status, statuses) & paid_until, F.lit(False)).cast("int")


def cohort_rows(dated: DataFrame, first: str, last: str) -> DataFrame:
    return dated.where(in_months("issue_dt", first, last))


def label(dated: DataFrame, first: str, last: str, cutoff: int = LABEL_CUTOFF,
          target: str = TARGET_COLUMN) -> DataFrame:
    """Cohort filter plus label column."""
    return cohort_rows(dated, first, last).withColumn(target, failed_within(cutoff))


def origination_years(dated: DataFrame, cohort_years: Sequence[int]) -> DataFrame:
    """Rows per origination year, marked if in the cohort."""
    return (dated.where(F.col("issue_dt").isNotNull())
            .groupBy(F.year("issue_dt").alias("issue_year")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("in_cohort", F.col("issue_year").isin(list(cohort_years)))
            .orderBy("issue_year"))


def snapshot_facts(raw: DataFrame, cohort_years: Sequence[int], issue: str = "issue_d",
                   pull: str = "last_credit_pull_d") -> DataFrame:
    """One row: total rows, first and last year, latest pull month, cohort size."""
    year = F.year(parse_month(issue))
    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.max(parse_month(pull)).alias("snapshot_dt"),
        F.count_if(year.isin(list(cohort_years))).alias("cohort_rows"),
    ).withColumn("snapshot", month_display("snapshot_dt"))


def status_counts(cohort: DataFrame, status: str = "loan_status") -> DataFrame:
    return (cohort.groupBy(F.col(status).alias("loan_status")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("counts_as_failed", failed("loan_status"))
            .orderBy(F.desc("n"), "loan_status"))


def label_summary(cohort: DataFrame, target: str = TARGET_COLUMN) -> DataFrame:
    """Counts behind the label and the class ratio, one row, one pass."""
    bad = failed()
    out = cohort.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_failed"),
        F.sum(target).cast("bigint").alias("n_target"),
        F.count_if(bad & F.col("m").isNull()).alias("n_never_paid_failed"))
    return (out.withColumn("n_failed_later", F.col("n_failed") - F.col("n_target"))
            .withColumn("failed_rate", safe_ratio(F.col("n_failed"), F.col("n")))
            .withColumn("target_rate", safe_ratio(F.col("n_target"), F.col("n")))
            .withColumn("class_ratio", (F.col("n") - F.col("n_target")).cast("double")
                        / F.greatest(F.col("n_target"), F.lit(1))))


def label_sensitivity(cohort: DataFrame, cutoffs: Sequence[int] = SENSITIVITY_CUTOFFS,
                      chosen: int = LABEL_CUTOFF, window_months: int = 12) -> DataFrame:
    """Defaults, rate and shift in percentage points per cutoff; all cutoffs in one aggregate."""
    sums = cohort.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(failed_within(chosen)).cast("bigint").alias("base"),
        *[F.sum(failed_within(c)).cast("bigint").alias(f"k{c}") for c in cutoffs])
    rows = F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(window_months - c).alias("implied_lag"),
                              F.col(f"k{c}").alias("defaults")) for c in cutoffs])
    return (sums.select("n", "base", F.inline(rows))
            .select("cutoff", "implied_lag", "defaults",
                    safe_ratio(F.col("defaults"), F.col("n")).alias("rate"),
                    (safe_ratio(F.col("defaults") - F.col("base"), F.col("n")) * 100).alias("delta_pp")))


def lag_ladder(df: DataFrame, gap: str | Column, statuses: Sequence[str], status: str = "loan_status") -> DataFrame:
    """Quartiles and mean of a month gap per status, statuses in the given order; those without rows stay.

    Month gaps take few distinct values, so the exact ``percentile`` keeps a
    value->count map of a few hundred entries however many rows there are.
    """
    g = F.col(gap) if isinstance(gap, str) else gap
    order = F.array_position(F.lit(list(statuses)), F.col("loan_status"))
    q = F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = (df.select(F.col(status).alias("loan_status"), g.alias("gap"))
             .where(F.col("loan_status").isin(list(statuses)))
             .groupBy("loan_status")
             .agg(F.count("gap").alias("n"), F.count(F.lit(1)).alias("n_rows"), q.alias("q"),
                  F.avg("gap").alias("mean")))
    wanted = df.sparkSession.createDataFrame([(s,) for s in statuses], "loan_status string")
    stats = (wanted.join(stats, "loan_status", "left")
             .withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n", "n_rows")}))
    return (stats.select("loan_status", order.cast("int").alias("position"), "n", "n_rows",
                    F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "mean")
            .orderBy("position"))


def months_since_payment(df: DataFrame, pull: str = "last_credit_pull_d") -> DataFrame:
    """Add months from the last payment to the global snapshot and to the row's own pull month.

    The snapshot is one scalar, read ahead and used as a literal.
    """
    snapshot = df.agg(F.max(parse_month(pull))).first()[0]
    return (df.withColumn("pull_dt", parse_month(pull))
            .withColumn("gap_global", whole_months(F.col("last_pymnt_dt"), F.lit(snapshot).cast("date")))
            .withColumn("gap_own", whole_months("last_pymnt_dt", "pull_dt")))


def examples_per_case(cohort: DataFrame, cases: Sequence[tuple[str, Column]], key: str = "app_id",
                      columns: Sequence[str] = ()) -> DataFrame:
    """The lowest-key row meeting each named condition.

    One conditional ``min_by`` per case: a single aggregate, no sort.
    """
    cols = [key, *columns]
    row = F.struct(*cols)
    picks = cohort.agg(*[F.min_by(row, F.when(cond, F.col(key))).alias(f"c{i}") for i, (_, cond) in enumerate(cases)])
    rows = F.array(*[F.struct(F.lit(name).alias("example"), F.col(f"c{i}").alias("r")) for i, (name, _) in enumerate(cases)])
    return picks.select(F.inline(rows)).where("r is not null").select("example", *[F.col("r")[c].alias(c) for c in cols])
