"""Application-shaped inputs built from the order tables.

``applications`` gives one row per order in the raw snapshot shape (text months,
snapshot status, amounts, partly missing values); ``cohort`` labels a two-year
slice; ``scored`` adds two fixed formula scores for the metric operators.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.dates import MONTH_TEXT, month_range
from riskloom.functions.scalars import band, regroup
from riskloom.operators.labeling import label, with_dates
from riskloom.sources.policy import DROP, KEEP, TARGET, ColumnGroup, ColumnPolicy

COHORT = ("1996-01", "1997-12")
CUTOFF = 8
LIMITS = {"annual_inc": {"min": 0}, "dti": {"max": 250}}
NUMERIC = ["loan_amnt", "annual_inc", "dti", "disc_r", "fico_range_low"]
FLAGGED = ["dti", "disc_r"]
CATEGORICAL = ["term", "purpose", "emp_length", "home_ownership"]
EMP_GROUPS = {"0-3 years": ["< 1 year", "1 year", "2 years", "3 years"], "10+ years": ["10+ years"]}
INCOME_BANDS = ([-1_000.0, 2_000.0, 4_500.0, 7_000.0, float("inf")], ["under 2k", "2-4.5k", "4.5-7k", "over 7k"])
SCORE_BANDS = ([0.0, 665.0, 725.0, 785.0, float("inf")], ["under 665", "665-725", "725-785", "over 785"])
DTI_BANDS = ([-1.0, 60.0, 110.0, 160.0, float("inf")], ["under 60", "60-110", "110-160", "over 160"])
SEGMENTS = ["home_ownership", "term", "employment", "income_band", "score_band", "dti_band", "purpose"]


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; the schema of a table is looked up once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def applications(spark: SparkSession, sf_dir: str, months: tuple[str, str] | None = None) -> DataFrame:
    """Raw snapshot rows; ``months`` bounds the order date inside the scan."""
    orders = read_table(spark, sf_dir, "orders")
    if months:
        lo, hi = month_range(*months)
        orders = orders.where(f"o_orderdate >= timestamp_ntz'{lo}' and o_orderdate < timestamp_ntz'{hi + timedelta(days=1)}'")
    lines = read_table(spark, sf_dir, "lineitem")
    if months:  # only lines of the orders in question are shuffled and summed
        lines = lines.join(orders.select("o_orderkey"), lines["l_orderkey"] == orders["o_orderkey"], "left_semi")
    lines = lines.groupBy("l_orderkey").agg(
        F.expr("max(l_shipdate)").alias("last_ship"), F.expr("sum(l_quantity)").alias("qty"),
        F.expr("count(1)").alias("n_lines"), F.expr("max(case when l_returnflag = 'R' then l_discount end)").alias("disc_r"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    joined = (orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
              .join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left"))
    return joined.selectExpr(
        "o_orderkey as app_id",
        f"date_format(o_orderdate, '{MONTH_TEXT}') as issue_d",
        f"date_format(last_ship, '{MONTH_TEXT}') as last_pymnt_d",
        f"date_format(add_months(cast(coalesce(last_ship, o_orderdate) as date), cast(o_orderkey % 5 as int)), '{MONTH_TEXT}') "
        "as last_credit_pull_d",
        "case o_orderstatus when 'F' then 'Charged Off' when 'P' then 'Late (31-120 days)' else 'Current' end as loan_status",
        "o_totalprice as loan_amnt",
        "c_acctbal as annual_inc",
        "qty as dti",
        "disc_r",
        "600D + (o_custkey * 37) % 250 as fico_range_low",
        "c_mktsegment as home_ownership",
        "o_orderpriority as purpose",
        "case when n_lines >= 4 then '60 months' else '36 months' end as term",
        "case when c_nationkey = 1 then '< 1 year' when c_nationkey = 2 then '1 year' "
        "when c_nationkey between 3 and 10 then concat(c_nationkey - 1, ' years') "
        "when c_nationkey > 10 then '10+ years' end as emp_length",
        "cast((o_orderkey * 7919) % 1000 as double) / 1000 as u")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled applications of the cohort months, with ``issue_dt``, ``m`` and ``y``."""
    return label(with_dates(applications(spark, sf_dir, COHORT)), *COHORT, cutoff=CUTOFF, target="y")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort with formula scores ``p`` and ``p2`` and the seven audit segments.

    The formula uses the label on purpose: it only has to exercise the metrics.
    """
    return cohort(spark, sf_dir).withColumns({
        "p": F.expr("round(0.5D * u + 0.5D * cast(home_ownership in ('BUILDING', 'MACHINERY') as int) * u + 0.2D * y * u, 6)"),
        "employment": regroup("emp_length", EMP_GROUPS, "4-9 years"),
        "income_band": band("annual_inc", *INCOME_BANDS),
        "score_band": band("fico_range_low", *SCORE_BANDS),
        "dti_band": band("dti", *DTI_BANDS),
    }).withColumn("p2", F.expr("round(0.7D * p + 0.3D * u, 6)"))


def application_policy() -> ColumnPolicy:
    """Policy over the ``applications`` header; ``u`` is left out on purpose."""
    return ColumnPolicy(
        groups={
            "LABEL_SOURCE": ColumnGroup(TARGET, "Builds the outcome.", ("issue_d", "loan_status", "last_pymnt_d")),
            "STATED": ColumnGroup(KEEP, "Stated on the form. Known at application.",
                                  ("loan_amnt", "term", "purpose", "emp_length", "home_ownership", "annual_inc", "dti")),
            "BUREAU": ColumnGroup(KEEP, "Bureau value. Known at application.", ("fico_range_low", "disc_r")),
            "LEAKAGE": ColumnGroup(DROP, "Recorded later. Not known at application.", ("last_credit_pull_d",)),
            "IDENTIFIER": ColumnGroup(DROP, "Row key.", ("app_id",)),
        },
        categorical=tuple(CATEGORICAL), flagged=("disc_r",), median_only=("dti",),
        unknown_text=("emp_length",), limits=LIMITS)


# Meanings for the stand-in columns that have one; the rest stay blank.
MEANINGS = {
    "app_id": "Key of the application",
    "issue_d": "Month of the decision",
    "loan_amnt": "Amount asked for",
    "annual_inc": "Stated yearly income",
    "dti": "Debt measure",
    "home_ownership": "Housing status",
    "purpose": "What the money is for",
}
