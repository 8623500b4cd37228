"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text gets statistics; a rule rejects a text whose statistic lies beyond a cutoff.
Cutoffs come from labelled documents of good quality, per stratum.  For every rule a
fixed list of candidate cutoffs is tested against "it rejects more than the rule's
share of good documents": with k of n rejected the p-value is the binomial probability
of at most k at that share, computed exactly.  A rule's candidates are tested from mild to
strict until one fails (a fixed sequence needs no correction of its own), at a level of
``delta`` over the number of rules and strata (Bonferroni); the last that passed is used.
So with probability ``1 - delta`` every stratum rejects at most ``alpha`` of its good
documents: the shares of the rules add up to that.  A stratum without enough labels
certifies nothing and rejects by the base rules only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.staging import stage

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rules: name, statistic, and its candidate cutoffs from mild to strict; a text is rejected when the statistic is larger.
RULES = (
    ("symbols", "n_symbols / n_words", (2.0, 1.5, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    ("dup_lines", "n_dup_lines / n_lines", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("capitals", "n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("exclaimed", "n_marks / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("same_words", "1 - n_distinct / n_words", (0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6)),
)


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, run: int = 5) -> Column:
    """Words inside runs of ``run`` words that the text holds twice or more; runs are told apart by 64-bit hashes."""
    def count(w: Column) -> Column:
        n = F.size(w)
        at = F.sequence(F.lit(1), n - run + 1)
        name = lambda i: F.xxhash64(F.slice(w, i, run))

        def covered(hashes: Column) -> Column:
            placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def starts(p: Column) -> Column:
                twice = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
                return F.array_sort(F.transform(twice, lambda x: x["i"]))

            total = F.aggregate(
                _let(placed, starts), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
                lambda a, i: F.struct((i + run).alias("end"), (a["sum"] + run - F.greatest(F.lit(0), a["end"] - i)).alias("sum")),
                lambda a: a["sum"])
            return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)

        return F.when(n <= run, 0).otherwise(_let(F.transform(at, name), covered))

    return _let(words, count)


def statistics(docs: DataFrame, carry: list[Column]) -> DataFrame:
    """Columns ``carry`` and the counts of every whole text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*carry, text.alias("t"), F.translate(text, " \t\n\x0b\f\r", "").alias("s"))
    text, solid = F.col("t"), F.col("s")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    words = F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")
    less = lambda chars: (F.char_length(solid) - F.char_length(F.translate(solid, chars, ""))).cast("long")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                                            _repeat_words(w).cast("long").alias("n_repeat_words")))
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    names = [c for c in base.columns if c not in ("t", "s")]
    return base.select(*names, F.char_length(solid).cast("long").alias("word_chars"), less("#*$%&|<>").alias("n_symbols"),
                       less("!?").alias("n_marks"), less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), counts.alias("w"), dup.alias("l")
                       ).select(*names, "w.*", "word_chars", "n_symbols", "n_marks", "n_upper", "l.*")


def _log_factorial(n: Column) -> Column:
    """ln n!, from the product up to 20 and by Stirling's series, exact to a double, beyond."""
    x = n.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """Probability of at most ``k`` successes in ``n`` draws at ``share``.

    Terms fall from k down, below the mean faster than a bell curve; those more than 60
    standard deviations below k are beneath a double's precision and are not summed.
    Above the mean, where no test can succeed, it is 1.
    """
    top = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(share)) + (n - k) * F.log(F.lit(1 - share)))
    width = F.ceil(F.sqrt(n * (share * (1 - share))) * 60 + 60)
    odds = (1 - share) / share
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, width)), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) / (n - k + i + 1) * F.lit(odds)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"])
    return F.when(n == 0, 1.0).when(k > n * F.lit(share), 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def certify(rows: DataFrame, stratum: str = "stratum", alpha: float = 0.02, delta: float = 0.1) -> DataFrame:
    """Cutoffs per ``stratum`` and ``rule`` from good documents' statistics: ``cutoff``, ``k``, ``n``, ``p_value``."""
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.expr(s) > c).alias("hit"))
             for r, s, cuts in RULES for i, c in enumerate(cuts)]
    counted = (rows.select(stratum, F.explode(F.array(*tests)).alias("x")).select(stratum, "x.*")
               .groupBy(stratum, "rule", "step", "cutoff").agg(F.count_if("hit").alias("k"), F.count("*").alias("n")))
    strata = rows.agg(F.countDistinct(stratum)).first()[0]
    tested = counted.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)))
    passed = F.col("p_value") * (strata * len(RULES)) <= delta
    stop = Window.partitionBy(stratum, "rule")
    taken = (tested.withColumn("stop", F.min(F.when(~passed, F.col("step"))).over(stop))
             .where(passed & (F.col("stop").isNull() | (F.col("step") < F.col("stop")))))
    best = taken.groupBy(stratum, "rule").agg(F.max(F.struct("step", "cutoff", "k", "n", "p_value")).alias("b"))
    return best.select(stratum, "rule", "b.cutoff", "b.k", "b.n", "b.p_value")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.1) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``rejected_by`` (rules, sorted) and ``kept`` of every row.

    Cutoffs are fitted on all documents labelled good that pass the base rules.  A missing
    stratum is a stratum of its own.  Null texts have no words and fail the base rules, as
    do texts with fewer than 10 words or with over a fifth of their words in repeated runs
    of five.  Repeated rows are judged each; labels other than 0 and 1 are ignored, of
    contradicting ones the mean decides.  Other columns are ignored.
    """
    made = statistics(docs, [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")])
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    made = stage(made.withColumn("base_failed", failed), "rule-counts")
    good = (labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.avg("quality").alias("q")).where("q >= 0.5").select("doc_id"))
    cuts = certify(made.where("not base_failed").join(good, "doc_id", "left_semi"), alpha=alpha, delta=delta)
    table = stage(cuts.groupBy("stratum").pivot("rule", [r for r, _, _ in RULES]).agg(F.first("cutoff")), "rule-cutoffs")
    hits = F.filter(F.array(*[F.when(F.expr(s) > F.col(f"`{r}`"), F.lit(r)) for r, s, _ in RULES]), lambda x: x.isNotNull())
    judged = made.join(table, "stratum", "left").withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_sort(hits)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "stratum", F.array_join("rejected_by", ",").alias("rejected_by"))
