"""Named queries over the order tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import dates as fd
from riskloom.functions import scalars as fs
from riskloom.functions import verdicts as fv
from riskloom.operators import audit, cleaning, comparison, economics, evaluation, explain, features, labeling, models
from riskloom.operators import profiling, ranking, resampling, splitting, stability
from riskloom.operators.variants import group_fpr_change, variant_audit
from riskloom.sources import files, policy
from riskloom.sources import stand_ins as si
from riskloom.staging import shared_dir, stage

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

YEARS = (1996, 1997)
LADDER = ["Current", "Late (31-120 days)", "In Grace Period"]
PROFILED = ["loan_amnt", "annual_inc", "dti", "disc_r", "fico_range_low", "emp_length", "last_pymnt_d"]
SPEC = models.ColumnSpec(tuple(si.NUMERIC), tuple(si.FLAGGED), tuple(si.CATEGORICAL))
MIN_DEFAULTS = 20
REPLICATES = 1000
COEFFICIENTS = {"loan_amnt": 0.000002, "dti": -0.01, "disc_r": 3.5, "fico_range_low": -0.004,
                "purpose_2-HIGH": 0.4, "purpose_5-LOW": -0.3}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def r6(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def scored(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Narrow staged copy of the scored cohort: the metric operators read it several times."""
    return stage(si.scored(spark, d).select("app_id", "y", "p", *cols), "scored")


def with_piles(spark: SparkSession, d: str, df: DataFrame | None = None) -> DataFrame:
    base = stage(si.cohort(spark, d), "cohort") if df is None else df
    return splitting.stratified_split(base)


# -- dates and cohort -------------------------------------------------------


@register
def cohort_filter(spark, d):
    return si.cohort(spark, d).select("app_id", "issue_dt", "last_pymnt_dt")


@register
def orig_year_counts(spark, d):
    return labeling.origination_years(labeling.with_dates(si.applications(spark, d)), YEARS)


@register
def snapshot_date(spark, d):
    return labeling.snapshot_facts(si.applications(spark, d), YEARS)


@register
def month_periods(spark, d):
    """Strict month parsing, month and year periods, display text."""
    dt = fd.parse_month("issue_d", strict=True)
    return si.applications(spark, d).select(
        "app_id", fd.month_floor(dt).alias("issue_month"), F.year(dt).alias("issue_year"),
        fd.month_label(dt).alias("period"), fd.month_display(dt).alias("display"))


@register
def month_gap(spark, d):
    return labeling.with_dates(si.applications(spark, d)).select("app_id", "m")


@register
def month_gap_two_anchors(spark, d):
    return labeling.months_since_payment(si.cohort(spark, d)).select("app_id", "gap_global", "gap_own")


# -- label ------------------------------------------------------------------


@register
def label_rule(spark, d):
    return si.cohort(spark, d).select("app_id", "y")


@register
def label_status_counts(spark, d):
    return labeling.status_counts(si.cohort(spark, d))


@register
def label_summary(spark, d):
    return r6(labeling.label_summary(si.cohort(spark, d), "y"), "failed_rate", "target_rate", "class_ratio")


@register
def label_sensitivity(spark, d):
    return r6(labeling.label_sensitivity(si.cohort(spark, d)), "rate", "delta_pp")


@register
def lag_ladder(spark, d):
    df = stage(labeling.months_since_payment(si.cohort(spark, d)).select("loan_status", "m", "gap_global", "gap_own"), "gaps")
    parts = [labeling.lag_ladder(df, gap, LADDER).withColumn("anchor", F.lit(name))
             for name, gap in (("snapshot", "gap_global"), ("own pull", "gap_own"), ("issue", "m"))]
    return r6(files.append(parts), "p25", "median", "p75", "mean")


@register
def example_per_case(spark, d):
    died, m = labeling.failed(), F.col("m")
    return labeling.examples_per_case(si.cohort(spark, d), [
        ("failed early", died & (m <= 8)), ("failed late", died & (m > 15)),
        ("still paying", F.col("loan_status") == "Current"), ("never paid", died & m.isNull()),
    ], columns=["issue_d", "last_pymnt_d", "loan_status", "m", "y"])


# -- cleaning and scalars -----------------------------------------------------


@register
def dq_clear(spark, d):
    return cleaning.clear_impossible(si.cohort(spark, d), si.LIMITS).select("app_id", "annual_inc", "dti")


@register
def dq_clear_counts(spark, d):
    return cleaning.cleared_counts(si.cohort(spark, d), si.LIMITS)


@register
def missing_flags(spark, d):
    return cleaning.add_missing_flags(si.cohort(spark, d), si.FLAGGED).select("app_id", "dti_missing", "disc_r_missing")


@register
def flag_eligibility(spark, d):
    rates = profiling.null_rates(si.cohort(spark, d), si.NUMERIC)
    return r6(cleaning.flag_eligibility(rates).select("column", "null_rate", "eligible"), "null_rate")


@register
def regroup_case(spark, d):
    return si.applications(spark, d).select(
        "app_id", fs.regroup("emp_length", si.EMP_GROUPS, "4-9 years").alias("employment"))


@register
def right_closed_bands(spark, d):
    return si.applications(spark, d).select(
        "app_id", fs.band("annual_inc", *si.INCOME_BANDS).alias("income_band"),
        fs.band("dti", *si.DTI_BANDS).alias("dti_band"), fs.band("fico_range_low", *si.SCORE_BANDS).alias("score_band"))


@register
def unknown_fill(spark, d):
    return si.applications(spark, d).select("app_id", fs.fill_text("emp_length").alias("emp_length"))


@register
def text_scalars(spark, d):
    """Encoded names made readable, split, cut and cast."""
    name = F.concat(F.lit("text__purpose_"), F.lower("purpose"))
    return si.applications(spark, d).select(
        "app_id", fs.readable_name(name, ["purpose"]).alias("pretty"),
        fs.first_sentence(F.concat("home_ownership", F.lit(". "), F.col("purpose"))).alias("sentence"),
        fs.clip_text("loan_status", 6).alias("clipped"), F.col("fico_range_low").cast("int").alias("fico_int"))


@register
def math_scalars(spark, d):
    inc = F.col("annual_inc")
    out = si.applications(spark, d).select(
        "app_id", F.abs(inc).alias("abs_inc"), F.sqrt(F.abs(inc)).alias("root"), F.ln(F.greatest(inc, F.lit(1e-6))).alias("log_floor"),
        fs.sigmoid(inc / 10000).alias("sigmoid"), fs.half_even(F.col("loan_amnt") / 1000).alias("thousands"),
        fs.safe_ratio(F.col("loan_amnt"), F.col("dti") - 100).alias("ratio"))
    return r6(r6(out, "root", "log_floor", "sigmoid"), "ratio", digits=9)


# -- policy and profiling -------------------------------------------------------


@register
def policy_projection(spark, d):
    return si.cohort(spark, d).select(*si.application_policy().features(), "y")


@register
def policy_gaps(spark, d):
    """Columns without exactly one place in the policy, and how many values they hold."""
    rates = stage(profiling.null_rates(si.applications(spark, d)), "rates")
    gaps = policy.policy_gaps(rates.select("column"), si.application_policy().table(spark))
    return gaps.join(rates, "column", "left").select("column", "problem", (F.col("n") - F.col("n_null")).alias("n_filled"))


@register
def column_roles(spark, d):
    """Roles derived from the policy for the columns that the raw table really has."""
    pol = si.application_policy()
    have = set(si.applications(spark, d).columns)
    roles = features.column_roles([c for c in pol.features() if c in have], pol.categorical, pol.flagged)
    table = spark.createDataFrame([(c, r) for r, cs in roles.items() for c in cs], "column string, role string")
    rates = profiling.null_rates(cleaning.add_missing_flags(si.cohort(spark, d), pol.flagged))
    return rates.join(F.broadcast(table), "column").select("column", "role", "n_null")


@register
def null_rates(spark, d):
    return r6(profiling.null_rates(si.cohort(spark, d), PROFILED), "null_rate")


@register
def complete_columns(spark, d):
    return profiling.complete_columns(profiling.null_rates(si.cohort(spark, d), PROFILED))


@register
def missing_bands(spark, d):
    return r6(profiling.missing_bands(profiling.null_rates(si.cohort(spark, d), PROFILED)), "null_rate")


@register
def missing_signal(spark, d):
    out = profiling.missing_signal(si.cohort(spark, d), PROFILED, low=0.005)
    return r6(out, "rate_missing", "rate_present", "gap")


@register
def joint_missing(spark, d):
    return profiling.joint_missing(si.cohort(spark, d), ["dti", "last_pymnt_d", "disc_r"])


@register
def missing_by_month(spark, d):
    return r6(profiling.missing_by_month(si.cohort(spark, d), ["disc_r", "dti"]), "disc_r_missing_rate", "dti_missing_rate")


def _inventory(spark, d):
    raw = labeling.cohort_rows(labeling.with_dates(si.applications(spark, d, si.COHORT)), *si.COHORT)
    header = si.applications(spark, d).columns
    known = [c for c in header if c != "u"]
    return profiling.column_inventory(raw.select(*known), si.application_policy(),
                                      policy.glossary_table(spark, si.MEANINGS))


@register
def column_inventory(spark, d):
    return _inventory(spark, d)


@register
def treatment(spark, d):
    return _inventory(spark, d).select("column", "what_we_do")


@register
def inventory_rollup(spark, d):
    return profiling.inventory_rollup(_inventory(spark, d))


@register
def kept_with_blanks(spark, d):
    return profiling.kept_with_blanks(_inventory(spark, d))


@register
def quantile_scan(spark, d):
    df = stage(si.scored(spark, d).select("p", "dti", "loan_amnt"), "values")
    return r6(profiling.quantile_scan(df, ["p", "dti", "loan_amnt"], [0.5, 0.9, 0.99, 0.999, 1.0]), "value")


@register
def placeholder_counts(spark, d):
    return profiling.placeholder_counts(si.cohort(spark, d), {
        "dti at least 100": F.col("dti") >= 100, "dti equals 150": F.col("dti") == 150})


@register
def extreme_z(spark, d):
    return r6(profiling.extreme_z(si.cohort(spark, d), si.NUMERIC, top=4), "max_abs_z")


@register
def dose_response(spark, d):
    return r6(profiling.dose_response(si.cohort(spark, d), fs.band("dti", *si.DTI_BANDS)), "rate")


@register
def pearson(spark, d):
    return r6(profiling.correlations(si.cohort(spark, d), [
        ("loan_amnt", "dti"), ("annual_inc", "fico_range_low"), ("dti", "disc_r")]), "pearson")


# -- splitting and sampling -------------------------------------------------------


@register
def split_assign(spark, d):
    return with_piles(spark, d).select("app_id", "y", "pile")


@register
def split_summary(spark, d):
    return r6(splitting.split_summary(with_piles(spark, d)), "share", "rate")


@register
def split_rate_spread(spark, d):
    return r6(splitting.rate_spread(splitting.split_summary(with_piles(spark, d))), "spread_pp")


@register
def split_integrity(spark, d):
    return splitting.split_integrity(with_piles(spark, d))


@register
def holdout_assign(spark, d):
    """Early-stopping carve-out of the train pile."""
    train = stage(with_piles(spark, d).where("pile = 'train'"), "train")
    return splitting.stratified_holdout(train).select("app_id", "held_out")


@register
def sample_per_group(spark, d):
    events = si.read_table(spark, d, "events")
    return splitting.sample_per_group(events, "event_type", 50, "event_id").select("event_id", "event_type")


@register
def sample_per_day(spark, d):
    events = si.read_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return splitting.sample_per_group(events, "day", 50, "event_id").select("event_id", "day")


@register
def fixed_sample(spark, d):
    return splitting.fixed_sample(si.read_table(spark, d, "events").select("event_id", "event_type"), 5000, "event_id")


@register
def class_weights(spark, d):
    return r6(splitting.class_weights(stage(si.cohort(spark, d).select("app_id", "y"), "labels")), "weight")


# -- ranking ----------------------------------------------------------------------


@register
def global_rank(spark, d):
    return ranking.global_rank(scored(spark, d)).select("app_id", "rank")


@register
def topk_flag(spark, d):
    return ranking.topk_flag(scored(spark, d), 0.10).select("app_id", "reviewed")


@register
def cum_shares(spark, d):
    return r6(ranking.cumulative_shares(scored(spark, d)).select("app_id", "rank", "share_pos", "share_neg"),
              "share_pos", "share_neg")


@register
def deciles(spark, d):
    return ranking.with_decile(scored(spark, d)).select("app_id", "decile")


@register
def average_tie_rank(spark, d):
    return ranking.average_rank(scored(spark, d), "p").select("app_id", "avg_rank")


@register
def first_in_rank(spark, d):
    return ranking.first_in_rank(
        si.scored(spark, d), [("riskiest failed", F.col("y") == 1), ("riskiest fine", F.col("y") == 0)],
        last=[("safest", F.lit(True))], columns=["y", "loan_amnt"])


@register
def top_by_value(spark, d):
    """First rows by an expression."""
    return ranking.top_n(si.scored(spark, d).select("app_id", "annual_inc"), [F.desc(F.abs("annual_inc")), F.asc("app_id")], 25)


# -- metrics --------------------------------------------------------------------------


@register
def score_summary(spark, d):
    return r6(evaluation.score_summary(si.scored(spark, d)), "mean_p", "max_p")


@register
def score_histogram(spark, d):
    return r6(evaluation.score_histogram(scored(spark, d)), "density")


@register
def confusion(spark, d):
    return r6(evaluation.add_rates(evaluation.confusion(scored(spark, d))), "recall", "precision", "lift")


@register
def auc_gini(spark, d):
    return r6(evaluation.auc_gini(scored(spark, d)), "auc", "gini")


@register
def ks(spark, d):
    return r6(evaluation.ks(scored(spark, d)), "ks", "ks_depth")


METRIC_RATES = ("recall", "precision", "lift", "auc", "gini", "ks")


@register
def metric_block(spark, d):
    return r6(evaluation.metric_block(scored(spark, d)), *METRIC_RATES)


@register
def capacity_curve(spark, d):
    return r6(evaluation.capacity_curve(scored(spark, d)), "recall", "precision", "lift")


@register
def roc_points(spark, d):
    return r6(evaluation.roc_points(scored(spark, d)), "fpr", "tpr")


@register
def gains_points(spark, d):
    return r6(evaluation.gains_points(scored(spark, d)), "depth", "share_pos", "share_neg")


@register
def calibration(spark, d):
    return r6(evaluation.calibration(scored(spark, d)), "predicted", "observed", "ratio", digits=9)


def _pile_metrics(spark, d):
    df = with_piles(spark, d, scored(spark, d, "p2"))
    long = df.unpivot(["app_id", "y", "pile"], ["p", "p2"], "model", "score")
    return evaluation.metric_block(stage(long, "piles"), score="score", by=["model", "pile"])


@register
def pile_metrics(spark, d):
    """Metric block of two scores on three piles, six groups in one go."""
    return r6(_pile_metrics(spark, d), *METRIC_RATES)


@register
def pile_gap(spark, d):
    return r6(evaluation.pile_gap(_pile_metrics(spark, d), "pile", "val", "test", ["model"]), "val", "test", "gap")


@register
def model_delta(spark, d):
    metrics = _pile_metrics(spark, d).where("pile = 'test'")
    return r6(evaluation.model_delta(metrics, "model", "p", "p2"), "gini_champion", "gini_challenger", "gini_gain")


@register
def score_join(spark, d):
    """Two score tables put on the same rows."""
    base = si.scored(spark, d)
    return comparison.align_scores(base.select("app_id", "y", "p"), base.select("app_id", F.col("p2").alias("p")))


@register
def spearman(spark, d):
    return r6(comparison.spearman(scored(spark, d, "p2")), "spearman")


@register
def review_overlap(spark, d):
    return r6(comparison.review_overlap(scored(spark, d, "p2")), "share")


@register
def noise_verdict(spark, d):
    return r6(comparison.caught_change(scored(spark, d, "p2")), "relative_pct", "noise")


@register
def band_verdict(spark, d):
    """Bands fixed ahead, applied to one measured gain."""
    change = comparison.caught_change(scored(spark, d, "p2"))
    return change.select("diff", fv.challenger_band("diff").alias("model_band"), fv.keep_band("diff").alias("resample_band"),
                         fv.noise_band("diff").alias("ablation_band"), fv.removal_band("diff", fv.REMOVAL_KEEP).alias("removal_band"),
                         fv.removal_band("diff", fv.REMOVAL_KEEP_SENSITIVE).alias("sensitive_band"))


# -- audit and money ------------------------------------------------------------------


def _audit(spark, d):
    return audit.segment_audit(scored(spark, d, *si.SEGMENTS), si.SEGMENTS, min_defaults=MIN_DEFAULTS)


@register
def segment_audit(spark, d):
    return r6(_audit(spark, d), "base_rate", "recall", "flag_rate", "fpr")


@register
def recall_spread(spark, d):
    return r6(audit.recall_spread(_audit(spark, d)), "spread_pp")


@register
def amplification(spark, d):
    return r6(audit.amplification(_audit(spark, d)), "risk_ratio", "flag_ratio", "fpr_gap_pp", "amplification")


@register
def tpr_gap(spark, d):
    return r6(audit.tpr_gap(_audit(spark, d)), "tpr_gap")


@register
def money_recall(spark, d):
    return r6(economics.money_recall(scored(spark, d, "loan_amnt")), "mean_caught", "mean_missed", "recall_count",
              "recall_money", digits=4)


@register
def break_even(spark, d):
    return r6(r6(economics.break_even(scored(spark, d, "loan_amnt")), "exposure", "loss_found", digits=2), "break_even")


@register
def break_even_best(spark, d):
    return r6(economics.best_break_even(economics.break_even(scored(spark, d, "loan_amnt"))), "break_even")


@register
def sensitivity_grid(spark, d):
    return r6(economics.sensitivity_grid(scored(spark, d, "loan_amnt")), "break_even")


# -- stability ------------------------------------------------------------------------


def _sides(spark, d, *cols):
    """Even keys as expected, odd keys as actual; every row is on one side."""
    return stage(si.cohort(spark, d).select(*cols, (F.col("app_id") % 2 == 0).alias("even")), "sides")


@register
def psi_numeric(spark, d):
    return r6(stability.psi_numeric(_sides(spark, d, *si.NUMERIC), si.NUMERIC, side="even"), "psi")


@register
def psi_categorical(spark, d):
    return r6(stability.psi_categorical(_sides(spark, d, *si.CATEGORICAL), si.CATEGORICAL, "even"), "psi")


def _psi(spark, d):
    sides = _sides(spark, d, *si.NUMERIC, *si.CATEGORICAL)
    return stability.psi_numeric(sides, si.NUMERIC, side="even").unionByName(
        stability.psi_categorical(sides, si.CATEGORICAL, "even"))


@register
def psi_report(spark, d):
    return r6(stability.psi_report(_psi(spark, d)), "psi")


@register
def psi_summary(spark, d):
    return stability.psi_summary(_psi(spark, d))


def _documents(spark, d):
    docs = si.read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labelled = si.read_table(spark, d, "labels").select("doc_id").distinct()
    return docs.join(labelled, "doc_id", "left_semi"), docs.join(labelled, "doc_id", "left_anti")


@register
def psi_documents(spark, d):
    known, rest = _documents(spark, d)
    both = stage(stability.two_sides(known, rest, ["lang", "source", "n_chars"]), "docs")
    out = stability.psi_categorical(both, ["lang", "source"]).unionByName(stability.psi_numeric(both, ["n_chars"]))
    return r6(out, "psi")


@register
def unseen_categories(spark, d):
    """Combinations of language, source and length class that labelled documents never had."""
    def shaped(df):
        return df.select("lang", "source", F.concat_ws("/", "lang", "source").alias("pair"),
                         F.concat_ws("/", "lang", (F.col("n_chars") / 1000).cast("int").cast("string")).alias("size"))
    known, rest = _documents(spark, d)
    return stability.unseen_categories(shaped(known), shaped(rest), ["lang", "source", "pair", "size", "absent"])


@register
def category_union(spark, d):
    known, rest = _documents(spark, d)
    return stability.category_union(known, rest, "source")


# -- preparation and models ---------------------------------------------------------------


def _train(spark, d):
    return _piles(spark, d)[0]


@register
def fit_constants(spark, d):
    prep = SPEC.fit(_train(spark, d))
    table = prep.table(spark)
    return r6(table.select("column", "kind", "median", "mean", "scale", F.concat_ws("|", "categories").alias("categories")),
              "median", "mean", "scale", digits=4)


@register
def prepared_matrix(spark, d):
    """Encoded values of every cohort row, long."""
    df = stage(with_piles(spark, d), "piles")
    prep = SPEC.fit(df.where("pile = 'train'"))
    wide = prep.matrix(SPEC.with_flags(df), ["app_id"])
    return r6(wide.unpivot(["app_id"], prep.names, "feature", "value"), "value")


@register
def linear_attribution_topn(spark, d):
    df = stage(si.cohort(spark, d).select("app_id", "loan_amnt", "dti", "disc_r", "fico_range_low", "purpose"), "rows")
    encoded = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("loan_amnt", "dti", "disc_r", "fico_range_low")}
    encoded |= {f"purpose_{v}": (F.col("purpose") == v).cast("double") for v in ("2-HIGH", "5-LOW")}
    matrix = df.select(*[e.alias(n) for n, e in encoded.items()])
    means = explain.encoded_means(matrix, list(encoded))
    out = explain.linear_attribution(df, COEFFICIENTS, encoded, means, 3)
    return r6(out.select("app_id", "place", "feature", "phi", "direction"), "phi")


@register
def knn_pairs(spark, d):
    return resampling.nearest_neighbours(si.read_table(spark, d, "embeddings"))


@register
def knn_hashed(spark, d):
    """Neighbours from hash tables."""
    return resampling.hashed_neighbours(si.read_table(spark, d, "embeddings"))


@register
def knn_recall(spark, d):
    """True neighbours, and whether the hash tables find nine tenths of them."""
    rows = si.read_table(spark, d, "embeddings")
    found = resampling.neighbour_recall(resampling.hashed_neighbours(rows), resampling.nearest_neighbours(rows))
    return found.select("n_exact", (F.col("recall") >= 0.9).alias("nine_tenths"))


def _piles(spark, d):
    df = stage(with_piles(spark, d), "piles", ["pile"])
    return df.where("pile = 'train'"), df.where("pile = 'val'")


@register
def lr_coefficients(spark, d):
    return models.fit_scorecard(_train(spark, d), SPEC).coefficients(spark)


@register
def lr_certificate(spark, d):
    """Whether the plain and the balanced fit are at the optimum of their objectives, by coefficient."""
    train = _train(spark, d)
    parts = []
    for name, balanced in (("plain", False), ("balanced", True)):
        card = models.fit_scorecard(train, SPEC, balanced=balanced)
        rows = splitting.with_class_weight(train) if balanced else train
        vectors = card.vectors(rows, ["y", *(["weight"] if balanced else [])])
        parts.append(models.optimality(card.model, vectors, card.prep.names, weight="weight" if balanced else None).withColumn("model", F.lit(name)))
    return files.append(parts).select("model", "feature", (F.abs("gradient") < 0.01).alias("optimal"))


@register
def lr_scores(spark, d):
    train, val = _piles(spark, d)
    return models.fit_scorecard(train, SPEC).score(val)


@register
def weighted_comparison(spark, d):
    return models.weighted_comparison(*_piles(spark, d), SPEC)


@register
def weighted_order(spark, d):
    return models.refit_comparison(*_piles(spark, d), SPEC, "balanced")


@register
def smote_experiment(spark, d):
    return models.refit_comparison(*_piles(spark, d), SPEC, "oversampled")


@register
def challenger_roundtrip(spark, d):
    """Difference between the scores of a boosted challenger and of its saved copy, for every validation row."""
    _, boosted, val = _boosted(spark, d)
    path = _fresh(spark, "challenger")
    boosted.save(spark, path)
    again = models.BoostedPrefix.load(spark, path)
    both = comparison.align_scores(boosted.forest.score(val, ["app_id"]), again.forest.score(val, ["app_id"]))
    return both.select("app_id", (F.col("p") - F.col("p2")).alias("difference"))


@register
def scorecard_roundtrip(spark, d):
    """Difference between the scores of a scorecard and of its saved copy, for every validation row."""
    train, val = _piles(spark, d)
    path = _fresh(spark, "card")
    card = models.fit_scorecard(train, SPEC)
    card.save(spark, path)
    both = comparison.align_scores(card.score(val, ["app_id"]), models.Scorecard.load(spark, path).score(val, ["app_id"]))
    return both.select("app_id", (F.col("p") - F.col("p2")).alias("difference"))


@register
def unknown_scores(spark, d):
    """Rank, review flag and decile when every seventh score is NaN and every eleventh missing."""
    p = F.when(F.col("app_id") % 7 == 0, F.lit(float("nan"))).when(F.col("app_id") % 11 != 0, F.col("p"))
    df = stage(scored(spark, d).withColumn("p", p), "unknown-scores")
    flagged = ranking.topk_flag(df, 0.1).select("app_id", "reviewed")
    most = ranking.topk_flag(df, 0.9).select("app_id", F.col("reviewed").alias("reviewed_most"))
    deciles = ranking.with_decile(df).select("app_id", "decile")
    ranks = ranking.global_rank(df).select("app_id", "rank")
    return ranks.join(flagged, "app_id").join(most, "app_id").join(deciles, "app_id")


@register
def model_roundtrip(spark, d):
    """Scores of a scorecard that was saved and loaded again."""
    train, val = _piles(spark, d)
    path = _fresh(spark, "card")
    models.fit_scorecard(train, SPEC).save(spark, path)
    return models.Scorecard.load(spark, path).score(val)


@register
def ablation(spark, d):
    return models.ablation(*_piles(spark, d), SPEC, ["dti", "purpose"])


@register
def model_bench(spark, d):
    return models.model_bench(*_piles(spark, d), SPEC)


_CHALLENGERS: dict[tuple[str, str], tuple] = {}


def _boosted(spark, d):
    """Preparation, boosted challenger and validation vectors; fitted once per session and folder, as the queries on it share it."""
    place = (spark.sparkContext.applicationId, d)
    if place not in _CHALLENGERS:
        train, val = _piles(spark, d)
        prep = SPEC.fit(train)
        tv = stage(prep.vectors(SPEC.with_flags(train), ["app_id", "y"]), "train-vectors")
        vv = stage(prep.vectors(SPEC.with_flags(val), ["app_id", "y"]), "val-vectors")
        _CHALLENGERS[place] = prep, models.fit_boosted_prefix(tv), vv
    return _CHALLENGERS[place]


@register
def tree_attribution(spark, d):
    prep, boosted, val = _boosted(spark, d)
    return explain.tree_attribution(boosted.forest, val, prep.names)


@register
def attribution_additivity(spark, d):
    """Contributions plus base against the margin of every validation row."""
    _, boosted, val = _boosted(spark, d)
    return r6(explain.additivity(boosted.forest, val).select("app_id", "error"), "error")


@register
def scorecard_attribution(spark, d):
    """Contributions of a fitted scorecard plus its base against the log-odds of every validation row."""
    train, val = _piles(spark, d)
    card = models.fit_scorecard(train, SPEC)
    return r6(explain.scorecard_additivity(card, train, val), "error")


@register
def global_attribution(spark, d):
    prep, boosted, val = _boosted(spark, d)
    return explain.global_attribution(boosted.forest, val, prep.names)


@register
def base_risk(spark, d):
    _, boosted, _ = _boosted(spark, d)
    return explain.base_risk(boosted.forest, spark)


@register
def smote_rows(spark, d):
    train = _train(spark, d)
    prep = SPEC.fit(train)
    rows = prep.vectors(SPEC.with_flags(train), ["app_id", "y"]).select("app_id", "y", vector_to_array("features").alias("x"))
    return resampling.oversample(stage(rows, "train-arrays"))


@register
def bootstrap_ci(spark, d):
    return r6(resampling.bootstrap_ci(scored(spark, d, "p2"), replicates=REPLICATES), "gini", "low", "high", "half_width")


@register
def variant_audit_table(spark, d):
    df = scored(spark, d, "p2", "home_ownership", "term", "purpose")
    out = variant_audit(df, {"current": "p", "blended": "p2"}, "current", ["home_ownership", "term", "purpose"],
                        min_defaults=MIN_DEFAULTS)
    return r6(out, "gini", "amplification", "fpr_gap_pp")


@register
def variant_fpr_change(spark, d):
    df = scored(spark, d, "p2", "home_ownership", "term", "purpose")
    long = stage(df.unpivot(["app_id", "y", "home_ownership", "term", "purpose"], ["p", "p2"], "variant", "score"), "variants")
    groups = audit.segment_audit(long, ["home_ownership", "term", "purpose"], min_defaults=MIN_DEFAULTS, score="score", by=["variant"])
    return r6(group_fpr_change(groups, "p", "p2"), "fpr_before", "fpr_after", "change")


# -- files ------------------------------------------------------------------------------


def _fresh(spark, name):
    return f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"


@register
def csv_roundtrip(spark, d):
    path = _fresh(spark, "csv")
    cols = ["app_id", "issue_d", "last_pymnt_d", "loan_status", "loan_amnt", "disc_r"]
    files.write_csv(si.applications(spark, d).select(*cols), path)
    header = files.csv_header(spark, path)
    number = {"app_id": T.LongType(), "loan_amnt": T.DoubleType(), "disc_r": T.DoubleType()}
    schema = T.StructType([T.StructField(c, number.get(c, T.StringType())) for c in header])
    return files.read_csv(spark, path, schema, cols)


@register
def csv_report_roundtrip(spark, d):
    """A small result table written as one CSV file and read back."""
    path = _fresh(spark, "report")
    files.write_csv(labeling.status_counts(si.cohort(spark, d)), path, single_file=True)
    return files.read_csv(spark, path, T.StructType.fromDDL("loan_status string, n bigint, counts_as_failed boolean"))


@register
def parquet_roundtrip(spark, d):
    path = _fresh(spark, "piles")
    files.write_parquet(with_piles(spark, d).select("app_id", "y", "loan_amnt", "pile"), path, ["pile"])
    return files.read_parquet(spark, path, ["app_id", "y", "loan_amnt", "pile"])


@register
def append_scan(spark, d):
    """Two written parts, of current and of all other or unknown statuses, read as one table."""
    base = stage(si.applications(spark, d).select("app_id", "loan_status"), "statuses")
    current = F.col("loan_status").eqNullSafe("Current")
    paths = [_fresh(spark, "part"), _fresh(spark, "part")]
    for path, rows in zip(paths, (base.where(current), base.where(~current))):
        files.write_parquet(rows, path)
    return files.append([files.read_parquet(spark, path) for path in paths])


@register
def demo_extract(spark, d):
    cols = ["issue_d", "loan_status", "last_pymnt_d", "last_credit_pull_d", "disc_r", "dti", "annual_inc"]
    return files.demo_extract(si.applications(spark, d), cols, *si.COHORT)


@register
def bronze_years(spark, d):
    """Raw rows rewritten by year, read back with partition pruning."""
    path = _fresh(spark, "bronze")
    files.write_month_bronze(si.applications(spark, d).select("app_id", "issue_d", "loan_amnt"), path)
    return files.read_parquet(spark, path).where(F.col("issue_year").isin(list(YEARS))).select("app_id", "issue_dt", "loan_amnt")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """How many fail within the window, and what would reviewing the riskiest tenth catch?"""
    return evaluation.metric_block(scored(spark, d))
