"""Which raw column may be used for what, and why.

A column may be a feature only if its value was known on the day of the
application.  The lists are data: a caller with another table builds a
``ColumnPolicy`` of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, TARGET, DROP = "KEEP", "USED FOR TARGET", "DROP"
STATUS_ORDER = {KEEP: 0, TARGET: 1, DROP: 2}


@dataclass(frozen=True)
class ColumnGroup:
    status: str
    reason: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ColumnPolicy:
    """Column groups plus the missing-data treatment of the kept columns."""

    groups: Mapping[str, ColumnGroup]
    categorical: tuple[str, ...] = ()
    flagged: tuple[str, ...] = ()
    median_only: tuple[str, ...] = ()
    unknown_text: tuple[str, ...] = ()
    derive_from_date: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()
    limits: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def columns(self, status: str) -> list[str]:
        return [c for g in self.groups.values() if g.status == status for c in g.columns]

    def features(self) -> list[str]:
        """Columns handed to the model."""
        kept = [c for c in self.columns(KEEP) if c not in self.derive_from_date]
        return kept + list(self.derived)

    def numeric(self) -> list[str]:
        return [c for c in self.features() if c not in self.categorical]

    def flags(self) -> list[str]:
        return [f"{c}_missing" for c in self.flagged]

    def table(self, spark: SparkSession) -> DataFrame:
        """Dimension table ``(column, group, status, reason)``."""
        rows = [(c, name, g.status, g.reason) for name, g in self.groups.items() for c in g.columns]
        return spark.createDataFrame(
            rows, "column string, `group` string, status string, reason string")

    def treatment_table(self, spark: SparkSession) -> DataFrame:
        """Per-column attributes the treatment rule looks at."""
        cols = sorted({c for g in self.groups.values() for c in g.columns})
        return spark.createDataFrame(
            [(c, c in self.derive_from_date, c in self.unknown_text, c in self.categorical,
              c in self.flagged, c in self.median_only) for c in cols],
            "column string, is_date boolean, is_unknown_text boolean, is_text boolean, "
            "is_flagged boolean, is_median_only boolean")

    def raw_schema(self, header: Sequence[str]) -> T.StructType:
        """Declared CSV schema: numeric features DOUBLE, everything else text."""
        numeric = set(self.numeric())
        return T.StructType([
            T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in header])


def glossary_table(spark: SparkSession, meanings: Mapping[str, str]) -> DataFrame:
    """Dimension table ``(column, meaning)``."""
    return spark.createDataFrame(list(meanings.items()), "column string, meaning string")


def policy_gaps(header: DataFrame, policy: DataFrame) -> DataFrame:
    """Violations of "every column classified exactly once": ``(column, problem)``.

    ``header`` has one row per raw column, ``policy`` is a policy table.
    """
    unclassified = header.join(policy, "column", "left_anti").select("column", F.lit("unclassified").alias("problem"))
    absent = policy.join(header, "column", "left_anti").select("column", F.lit("not in header").alias("problem")).distinct()
    twice = (policy.groupBy("column").count().where("count > 1")
             .select("column", F.lit("classified more than once").alias("problem")))
    return unclassified.unionByName(absent).unionByName(twice)


# The column policy for consumer-loan snapshot files (151 columns).
_LABEL_SOURCE = "issue_d loan_status last_pymnt_d"
_APPLICATION_STATED = "loan_amnt term purpose application_type emp_length home_ownership annual_inc dti"
_BUREAU_CORE = """
fico_range_low fico_range_high delinq_2yrs inq_last_6mths open_acc pub_rec revol_bal revol_util total_acc
collections_12_mths_ex_med mths_since_last_delinq mths_since_last_record mths_since_last_major_derog
acc_now_delinq delinq_amnt pub_rec_bankruptcies tax_liens chargeoff_within_12_mths
"""
_BUREAU_EXTENDED = """
tot_coll_amt tot_cur_bal total_rev_hi_lim acc_open_past_24mths avg_cur_bal bc_open_to_buy bc_util
mo_sin_rcnt_rev_tl_op mo_sin_rcnt_tl mort_acc mths_since_recent_bc mths_since_recent_bc_dlq
mths_since_recent_inq mths_since_recent_revol_delinq num_accts_ever_120_pd num_actv_bc_tl
num_actv_rev_tl num_bc_sats num_bc_tl num_il_tl num_op_rev_tl num_rev_accts num_rev_tl_bal_gt_0
num_sats num_tl_120dpd_2m num_tl_30dpd num_tl_90g_dpd_24m num_tl_op_past_12m pct_tl_nvr_dlq
percent_bc_gt_75 tot_hi_cred_lim total_bal_ex_mort total_bc_limit total_il_high_credit_limit
"""
_LEAKAGE = """
out_prncp out_prncp_inv total_pymnt total_pymnt_inv total_rec_prncp total_rec_int total_rec_late_fee
recoveries collection_recovery_fee last_pymnt_amnt next_pymnt_d last_credit_pull_d last_fico_range_high
last_fico_range_low pymnt_plan disbursement_method initial_list_status hardship_flag hardship_type
hardship_reason hardship_status deferral_term hardship_amount hardship_start_date hardship_end_date
payment_plan_start_date hardship_length hardship_dpd hardship_loan_status
orig_projected_additional_accrued_interest hardship_payoff_balance_amount hardship_last_payment_amount
debt_settlement_flag debt_settlement_flag_date settlement_status settlement_date settlement_amount
settlement_percentage settlement_term
"""
_LENDER_JUDGEMENT = "int_rate grade sub_grade installment"
_TIME_VARYING = """
all_util inq_last_12m total_cu_tl open_acc_6m open_il_24m open_act_il open_il_12m max_bal_bc open_rv_12m
open_rv_24m inq_fi total_bal_il il_util mths_since_rcnt_il
"""
_AGE_PROXY = "earliest_cr_line mo_sin_old_rev_tl_op mo_sin_old_il_acct"
_LENDER_PROCESS = "verification_status"
_FAIRNESS_PROXY = "zip_code addr_state"
_JOINT_SPARSE = """
annual_inc_joint dti_joint verification_status_joint revol_bal_joint sec_app_fico_range_low
sec_app_fico_range_high sec_app_earliest_cr_line sec_app_inq_last_6mths sec_app_mort_acc sec_app_open_acc
sec_app_revol_util sec_app_open_act_il sec_app_num_rev_accts sec_app_chargeoff_within_12_mths
sec_app_collections_12_mths_ex_med sec_app_mths_since_last_major_derog
"""
_NON_PREDICTIVE = "id member_id url policy_code desc emp_title title funded_amnt funded_amnt_inv"
_MISSING_FLAGS = """
mths_since_last_record mths_since_recent_bc_dlq mths_since_last_major_derog mths_since_recent_revol_delinq
mths_since_last_delinq mths_since_recent_inq num_tl_120dpd_2m bc_util percent_bc_gt_75 bc_open_to_buy
mths_since_recent_bc
"""
_MEDIAN_FILL_ONLY = "dti revol_util inq_last_6mths num_rev_accts"
_CATEGORICAL = "term purpose application_type emp_length home_ownership"
_LIMITS = {
    "annual_inc": {"min": 5_000},
    "dti": {"min": 0, "max": 100},
    "revol_util": {"max": 150},
    "total_rev_hi_lim": {"max": 9_999_998},
    "pub_rec": {"max": 20},
    "tax_liens": {"max": 20},
}
COHORT_MONTHS = ("2015-01", "2016-12")
FAILED_STATUSES = ("Charged Off", "Default")
LABEL_CUTOFF = 8
SENSITIVITY_CUTOFFS = (8, 9, 12)
REVIEW_CAPACITY = 0.10
TARGET_COLUMN = "default_within_12_months"


def _group(status: str, reason: str, names: str) -> ColumnGroup:
    return ColumnGroup(status, reason, tuple(names.split()))


def loan_policy() -> ColumnPolicy:
    """The 60-feature policy: 60 kept, 3 for the target, 88 dropped."""
    return ColumnPolicy(
        groups={
            "LABEL_SOURCE": _group(TARGET, "Needed to work out the outcome; the model never sees it.", _LABEL_SOURCE),
            "APPLICATION_STATED": _group(KEEP, "Given on the application form.", _APPLICATION_STATED),
            "BUREAU_CORE": _group(KEEP, "Bureau value at application time.", _BUREAU_CORE),
            "BUREAU_EXTENDED": _group(KEEP, "Bureau value at application time.", _BUREAU_EXTENDED),
            "DROP_LEAKAGE": _group(DROP, "Written after the decision. A new applicant has no such value.", _LEAKAGE),
            "DROP_LENDER_JUDGEMENT": _group(DROP, "The lender's own risk opinion or derived from it.", _LENDER_JUDGEMENT),
            "DROP_TIME_VARYING_AVAILABILITY": _group(DROP, "Collected only from a certain month. It dates the loan.", _TIME_VARYING),
            "DROP_AGE_PROXY": _group(DROP, "Stands in for the applicant's age.", _AGE_PROXY),
            "DROP_LENDER_PROCESS": _group(DROP, "Records the lender's triage, not the applicant.", _LENDER_PROCESS),
            "DROP_FAIRNESS_PROXY": _group(DROP, "Place of residence, a proxy for protected traits.", _FAIRNESS_PROXY),
            "DROP_JOINT_SPARSE": _group(DROP, "Filled only for joint applications, almost always empty.", _JOINT_SPARSE),
            "DROP_NON_PREDICTIVE": _group(DROP, "Identifier, free text, constant or duplicate.", _NON_PREDICTIVE),
        },
        categorical=tuple(_CATEGORICAL.split()),
        flagged=tuple(_MISSING_FLAGS.split()),
        median_only=tuple(_MEDIAN_FILL_ONLY.split()),
        unknown_text=("emp_length",),
        limits=_LIMITS,
    )
