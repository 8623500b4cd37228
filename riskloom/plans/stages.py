"""The whole job on a raw loan snapshot, one function per stage.

Every stage reads what the one before it wrote, so each can run on its own:
cohort -> piles -> scorecard and challenger -> evaluation, audit, money,
robustness.  Results come back as DataFrames; the caller shows or writes them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import band, regroup
from riskloom.operators import (audit, cleaning, comparison, economics, evaluation, explain, labeling, models, profiling,
                                resampling, splitting, stability)
from riskloom.operators.trees import Forest
from riskloom.sources import files
from riskloom.sources.policy import (COHORT_MONTHS, LABEL_CUTOFF, REVIEW_CAPACITY, SENSITIVITY_CUTOFFS, TARGET_COLUMN,
                                     ColumnPolicy, glossary_table, loan_policy)
from riskloom.staging import stage

# Groups of the segment audit.
EMP_GROUPS = {"0-3 years": ["< 1 year", "1 year", "2 years", "3 years"], "10+ years": ["10+ years"]}
INCOME = ([0.0, 45_000.0, 65_000.0, 95_000.0, float("inf")], ["under 45k", "45-65k", "65-95k", "over 95k"])
SCORE = ([0.0, 665.0, 695.0, 725.0, float("inf")], ["under 665", "665-695", "695-725", "over 725"])
DEBT = ([-1.0, 12.0, 19.0, 26.0, float("inf")], ["under 12", "12-19", "19-26", "over 26"])
LATE_STATUSES = ["Current", "In Grace Period", "Late (16-30 days)", "Late (31-120 days)"]


@dataclass(frozen=True)
class Job:
    """Where the data is and which policy applies; ``key`` is the unique id column of the raw file."""

    spark: SparkSession
    raw: str
    out: str
    key: str = "id"
    policy: ColumnPolicy = field(default_factory=loan_policy)
    months: tuple[str, str] = COHORT_MONTHS
    capacity: float = REVIEW_CAPACITY

    @property
    def spec(self) -> models.ColumnSpec:
        return models.ColumnSpec(tuple(self.policy.numeric()), self.policy.flagged, self.policy.categorical)

    # -- data -------------------------------------------------------------

    def raw_rows(self, columns: Sequence[str] | None = None) -> DataFrame:
        header = files.csv_header(self.spark, self.raw)
        return files.read_csv(self.spark, self.raw, self.policy.raw_schema(header), columns)

    def dated(self, extra: Sequence[str] = ()) -> DataFrame:
        """Cohort rows with parsed dates, the key as ``app_id`` and the policy's columns."""
        columns = list(dict.fromkeys([self.key, "issue_d", "loan_status", "last_pymnt_d", *self.policy.features(), *extra]))
        rows = labeling.with_dates(self.raw_rows(columns)).withColumn("app_id", F.expr(f"try_cast(`{self.key}` as bigint)"))
        return labeling.cohort_rows(rows, *self.months)

    def inspect(self) -> DataFrame:
        """Rows per origination year."""
        years = range(int(self.months[0][:4]), int(self.months[1][:4]) + 1)
        return labeling.origination_years(labeling.with_dates(self.raw_rows(["issue_d", "last_pymnt_d"])), list(years))

    def build_cohort(self) -> None:
        """Label, clean, and save key, month, features and target; label sources stay out."""
        labelled = self.dated().withColumn(TARGET_COLUMN, labeling.failed_within(LABEL_CUTOFF))
        clean = cleaning.clear_impossible(labelled, self.policy.limits)
        files.write_parquet(clean.select("app_id", "issue_dt", *self.policy.features(), TARGET_COLUMN), f"{self.out}/cohort")

    def cleared(self) -> DataFrame:
        return cleaning.cleared_counts(self.dated(), self.policy.limits)

    def label_reports(self) -> dict[str, DataFrame]:
        rows = self.dated().withColumn(TARGET_COLUMN, labeling.failed_within(LABEL_CUTOFF))
        return {"status": labeling.status_counts(rows), "summary": labeling.label_summary(rows),
                "sensitivity": labeling.label_sensitivity(rows, SENSITIVITY_CUTOFFS)}

    def lag(self) -> dict[str, DataFrame]:
        gaps = labeling.months_since_payment(self.dated(["last_credit_pull_d"]))
        return {g: labeling.lag_ladder(gaps, f"gap_{g}", LATE_STATUSES) for g in ("global", "own")}

    def inventory(self, meanings: dict[str, str] | None = None) -> DataFrame:
        """Every raw column with status, reason, blanks in the cohort and treatment."""
        rows = labeling.cohort_rows(labeling.with_dates(self.raw_rows()), *self.months)
        header = files.csv_header(self.spark, self.raw)
        return profiling.column_inventory(rows.select(*header), self.policy, glossary_table(self.spark, meanings or {"": ""}))

    def missingness(self, cluster: Sequence[str] = ()) -> dict[str, DataFrame]:
        train = self.pile("train")
        rates = profiling.null_rates(train, self.policy.features())
        out = {"rates": rates, "bands": profiling.missing_bands(rates),
               "signal": profiling.missing_signal(train, self.policy.features(), TARGET_COLUMN)}
        if cluster:
            rows = self.dated(cluster)
            out |= {"joint": profiling.joint_missing(rows, cluster), "months": profiling.missing_by_month(rows, cluster[:1])}
        return out

    def month_sample(self, columns: Sequence[str], per_month: int = 50) -> DataFrame:
        """Rows per origination month, for reading by eye."""
        rows = self.dated(columns).withColumn("issue_month", F.date_format("issue_dt", "yyyy-MM"))
        return splitting.sample_per_group(rows, "issue_month", per_month, "app_id").select("issue_month", *columns)

    # -- piles and models ---------------------------------------------------

    def split(self) -> None:
        rows = self.spark.read.parquet(f"{self.out}/cohort")
        files.write_parquet(splitting.stratified_split(rows, TARGET_COLUMN), f"{self.out}/piles", ["pile"])

    def pile(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/piles").where(F.col("pile") == name)

    def split_report(self) -> DataFrame:
        return splitting.split_summary(self.spark.read.parquet(f"{self.out}/piles"), TARGET_COLUMN)

    def fit_baseline(self, balanced: bool = False) -> None:
        models.fit_scorecard(self.pile("train"), self.spec, TARGET_COLUMN, balanced).save(self.spark, f"{self.out}/scorecard")

    def scorecard(self) -> models.Scorecard:
        return models.Scorecard.load(self.spark, f"{self.out}/scorecard")

    def fit_challenger(self, **settings) -> models.BoostedPrefix:
        """Boosted trees on the scorecard's own preparation, saved next to it."""
        vectors = stage(self.scorecard().vectors(self.pile("train"), ["app_id", TARGET_COLUMN]), "challenger")
        boosted = models.fit_boosted_prefix(vectors, TARGET_COLUMN, **settings)
        boosted.save(self.spark, f"{self.out}/challenger")
        return boosted

    def challenger(self) -> Forest:
        """The saved challenger."""
        return models.BoostedPrefix.load(self.spark, f"{self.out}/challenger").forest

    def class_weighting(self) -> DataFrame:
        return models.refit_comparison(self.pile("train"), self.pile("val"), self.spec, "balanced", self.capacity, TARGET_COLUMN)

    def smote(self) -> DataFrame:
        return models.refit_comparison(self.pile("train"), self.pile("val"), self.spec, "oversampled", self.capacity, TARGET_COLUMN)

    def scores(self, pile: str, challenger: Forest | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Champion score ``p``, and ``p2`` of the challenger, with ``y`` and kept columns."""
        card, rows = self.scorecard(), self.pile(pile)
        cols = ["app_id", TARGET_COLUMN, *keep]
        out = card.score(rows, cols)
        if challenger:
            out = comparison.align_scores(out, challenger.score(card.vectors(rows, ["app_id"]), ["app_id"]))
        return stage(out.withColumnRenamed(TARGET_COLUMN, "y"), "scores")

    def ablate(self, drop: Sequence[str]) -> DataFrame:
        return models.ablation(self.pile("train"), self.pile("val"), self.spec, drop, self.capacity, TARGET_COLUMN)

    def bench_models(self, **settings) -> DataFrame:
        return models.model_bench(self.pile("train"), self.pile("val"), self.spec, self.capacity, TARGET_COLUMN, **settings)

    # -- reports --------------------------------------------------------------

    def evaluate(self, pile: str = "val") -> dict[str, DataFrame]:
        rows = self.scores(pile)
        return {"metrics": evaluation.metric_block(rows, self.capacity), "curve": evaluation.capacity_curve(rows, chosen=self.capacity),
                "calibration": evaluation.calibration(rows), "histogram": evaluation.score_histogram(rows)}

    def final_test(self, challenger: Forest | None = None) -> dict[str, DataFrame]:
        """Validation against test for each model, and what the challenger adds on test."""
        names = ["p", *(["p2"] if challenger else [])]
        parts = [self.scores(pile, challenger).withColumn("pile", F.lit(pile)) for pile in ("val", "test")]
        long = stage(parts[0].unionByName(parts[1]).unpivot(["app_id", "y", "pile"], names, "model", "score"), "final")
        metrics = stage(evaluation.metric_block(long, self.capacity, "score", by=["model", "pile"]), "final-metrics")
        out = {"metrics": metrics, "gap": evaluation.pile_gap(metrics, "pile", "val", "test", ["model"])}
        if challenger:
            out["delta"] = evaluation.model_delta(metrics.where("pile = 'test'"), "model", "p", "p2")
        return out

    def segments(self, pile: str = "val", min_defaults: int = audit.MIN_DEFAULTS) -> dict[str, DataFrame]:
        cols = ["home_ownership", "term", "emp_length", "annual_inc", "fico_range_low", "dti", "purpose"]
        rows = (self.scores(pile, keep=cols).withColumn("employment", regroup("emp_length", EMP_GROUPS, "4-9 years"))
                .withColumn("income_band", band("annual_inc", *INCOME)).withColumn("score_band", band("fico_range_low", *SCORE))
                .withColumn("debt_band", band("dti", *DEBT)))
        groups = stage(audit.segment_audit(rows, ["home_ownership", "term", "employment", "income_band", "score_band",
                                                  "debt_band", "purpose"], self.capacity, min_defaults), "segments")
        return {"groups": groups, "spread": audit.recall_spread(groups), "amplification": audit.amplification(groups)}

    def money(self, pile: str = "test") -> dict[str, DataFrame]:
        rows = self.scores(pile, keep=["loan_amnt"])
        table = economics.break_even(rows)
        return {"recall": economics.money_recall(rows, self.capacity), "break_even": table,
                "best": economics.best_break_even(table), "grid": economics.sensitivity_grid(rows, self.capacity)}

    def robustness(self, challenger: Forest | None = None, replicates: int = resampling.REPLICATES) -> dict[str, DataFrame]:
        train, test = self.pile("train"), self.pile("test")
        text, numbers = list(self.policy.categorical), self.policy.numeric()
        both = stage(stability.two_sides(train, test, [*numbers, *text]), "sides")
        psi = stability.psi_numeric(both, numbers).unionByName(stability.psi_categorical(both, text))
        out = {"unseen": stability.unseen_categories(train, test, text), "psi": psi, "psi_top": stability.psi_report(psi)}
        if challenger:
            out["intervals"] = resampling.bootstrap_ci(self.scores("test", challenger), replicates=replicates)
        return out

    def explain(self, challenger: Forest | None = None, pile: str = "val", top: int = explain.ROW_TOP) -> DataFrame:
        """Top contributions for the riskiest defaulter, the riskiest other row and the safest row."""
        from riskloom.operators.ranking import first_in_rank
        card, rows = self.scorecard(), self.pile(pile)
        scored = card.score(rows, ["app_id", TARGET_COLUMN])
        if challenger:
            scored = challenger.score(card.vectors(rows, ["app_id", TARGET_COLUMN]), ["app_id", TARGET_COLUMN])
        y = F.col(TARGET_COLUMN)
        picks = first_in_rank(scored, [("riskiest failed", y == 1), ("riskiest fine", y == 0)], last=[("safest", F.lit(True))])
        chosen = rows.join(F.broadcast(picks.select("pick", "app_id")), "app_id")
        if challenger:
            raw = {c: F.col(c) for c in card.prep.numeric}
            vectors = card.vectors(chosen, ["app_id", "pick", *card.prep.numeric])
            return explain.tree_attribution(challenger, vectors, card.prep.names, top, ["app_id", "pick", *card.prep.numeric], raw) \
                .drop(*card.prep.numeric)
        return explain.scorecard_attribution(card, self.pile("train"), chosen, top, ["app_id", "pick"])
