"""Classifiers, rules and surrogates."""

import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality_ftrl, quality_rules, surrogates, toxicity_nbsvm
from riskloom.llm.labelled import training_rows


def auc(rows):
    a, b = (np.array([r.score for r in rows if r.y == y]) for y in (1, 0))
    return (a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()


@pytest.mark.parametrize("module,target,least", [(quality_ftrl, "quality", 0.97), (toxicity_nbsvm, "toxic", 0.93)])
def test_classifier_on_held_out_documents(spark, tiny, module, target, least):
    path = tiny.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = module.classify(docs, labels, max_train=2500)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", F.col(target).alias("y")).collect()
    assert auc(rows) > least


@pytest.mark.parametrize("module", [quality_ftrl, toxicity_nbsvm])
def test_classifier_on_odd_rows(module, odd, none, marks):
    got = module.classify(odd, marks).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    assert module.classify(none, marks).count() == 0
    assert {r.score for r in module.classify(odd, marks.where("1 = 0")).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_ftrl.classify(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_sample_is_bounded(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    assert training_rows(docs, labels, "quality", 20, 2).count() <= 40


def test_keep_good_returns_the_columns(odd, marks):
    got = quality_ftrl.keep_good(odd, marks, threshold=0.0)
    assert got.columns == odd.columns and got.count() == odd.count()


def test_ftrl_separates():
    model = quality_ftrl.Ftrl(8)
    for _ in range(50):
        model.step(np.array([1, 3]), np.array([1.0, 1.0]), 1)
        model.step(np.array([2, 3]), np.array([1.0, 1.0]), 0)
    w = model.final()
    assert w[1] > 0.5 and w[2] < -0.5 and w[5] == 0


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often, inside = Counter(runs), set()
    for i, r in enumerate(runs):
        if often[r] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def check_rules(docs, labels):
    texts = Counter((r.doc_id, *counts(r.text)) for r in docs.select("doc_id", "text").collect())
    got = quality_rules.apply_rules(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    return got


def test_rule_counts(spark, small):
    check_rules(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))


def test_rules_on_odd_rows(odd, none, marks):
    check_rules(odd, marks)
    assert quality_rules.apply_rules(none, marks).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (0, 1, 7, 30, 400) for p in (0.01, 0.25) for k in {0, 1, n // 20, n // 5} if k <= n and k <= n * p]
    for p in (0.01, 0.25):
        own = [(k, n) for k, n, q in cases if q == p]
        rows = spark.createDataFrame(own, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for r in rows:
            want = sum(comb(r.n, i) * p ** i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.t == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs_hold_the_risk(spark):
    """Strict cutoffs that would hit too many good documents are not taken, in a stratum with few labels none is."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 19_900, "big").otherwise("few").alias("stratum"), F.lit(100).alias("n_words"), F.lit(500).alias("word_chars"),
        F.when(F.col("id") % 50 == 0, 20).otherwise(1).alias("n_symbols"), F.lit(0).alias("n_marks"), F.lit(5).alias("n_upper"),
        F.lit(0).alias("n_dup_lines"), F.lit(9).alias("n_lines"), F.lit(90).alias("n_distinct"), F.lit(0).alias("n_repeat_words"))
    got = {(r.stratum, r.rule): r for r in quality_rules.certify(rows).collect()}
    assert got["big", "symbols"].cutoff == 0.2 and got["big", "symbols"].k == 0
    assert got["big", "exclaimed"].cutoff == 0.1
    assert not [k for k in got if k[0] == "few"]


TEXTS = {
    1: "Write to Jane.Doe@mail.example.com or call +1 (702) 555-0742, card 4539 1488 0343 6467.",
    2: "JANE.DOE@MAIL.EXAMPLE.COM paid with 4539148803436467 from 64.147.79.24; Mrs. Anna Miller signed, Mr Anna Miller did not.",
    3: 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" Herr Иван Петров', 4: "version 2.0 of 2024, clause 4.0.", 5: None, 6: "",
}


def test_surrogates(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.replace(docs, "k").collect()}
    assert got[4] == TEXTS[4] and got[5] is None and got[6] == ""
    for d in (1, 2, 3):
        for s, e, _ in surrogates.find(TEXTS[d]):
            assert TEXTS[d][s:e] not in got[d]
        assert [k for *_, k in surrogates.find(got[d])] == [k for *_, k in surrogates.find(TEXTS[d])]
    kinds = {d: {k: got[d][s:e] for s, e, k in surrogates.find(got[d])} for d in (1, 2, 3)}
    assert kinds[1]["email"].lower() == kinds[2]["email"].lower() and kinds[2]["email"].isupper() and kinds[1]["email"][0].isupper()
    assert kinds[1]["card"].replace(" ", "") == kinds[2]["card"] and surrogates._check_digit(kinds[2]["card"][:-1]) == kinds[2]["card"][-1]
    her, him = re.search(r"Mrs\. (\w+a) (\w+) signed", got[2]), re.search(r"Mr (\w+[^aeiou\W]) (\w+) did", got[2])
    assert her[2] == him[2] and her[1] != him[1]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", kinds[1]["phone"])
    assert all("а" <= c <= "я" for c in kinds[3]["name"].split()[1].lower())
    assert got == {r.doc_id: r.text for r in surrogates.replace(docs, "k").collect()}
    assert got != {r.doc_id: r.text for r in surrogates.replace(docs, "other").collect()}


@pytest.mark.parametrize("text,name", [("Вчера г-н Иванов пришёл", "Иванов"), ("г-жа Петрова", "Петрова"), ("Г-н Иванов", "Иванов"), ("Г-ЖА Петрова", "Петрова"),
                                       ("ayer SEÑOR Gómez", "Gómez"), ("Hier Mme. Dubois", "Dubois")])
def test_surrogates_of_names_without_digits_in_the_text(spark, text, name):
    got = surrogates.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert got.n_entities == 1 and name not in got.text and got.text.startswith(text[:text.index(name)])


def test_surrogates_of_later_mentions_without_a_title(spark):
    texts = ["Smith wrote. Mr. John Smith signed. Later Smith and John Smith left; SMITH's and Smith-led, not Smithson or smith.",
             "Mrs. Kim Lee's car, Mr. Kim Park and Mr. Lee Kim. Then Kim Lee, Kim Park, Lee Kim, Lee and Kim.",
             "Г-н Иван Иванов пришёл. Иванов ушёл, a@Иванов.", "No title here: Smith and John Smith left."]
    got = [r for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    m = re.fullmatch(r"(\w+) wrote\. Mr\. (\w+) (\w+) signed\. Later (\w+) and (\w+) (\w+) left; (\w+)'s and (\w+)-led, not Smithson or smith\.", got[0].text)
    assert m[1] == m[3] == m[4] == m[6] == m[7].capitalize() == m[8] != "Smith" and m[2] == m[5] != "John" and m[7].isupper() and got[0].n_entities == 8
    m = re.fullmatch(r"Mrs\. (\w+) (\w+)'s car, Mr\. (\w+) (\w+) and Mr\. (\w+) (\w+)\. Then (\w+) (\w+), (\w+) (\w+), (\w+) (\w+), (\w+) and (\w+)\.", got[1].text)
    assert m.groups()[6:12] == m.groups()[:6] and m[13] == m[2] and m[14] == m[6] and m[1] != m[3]
    assert "Иванов" not in got[2].text and got[2].n_entities == 4
    assert got[3].text == texts[3] and got[3].n_entities == 0


def test_surrogates_stay_apart(spark):
    """More entities of one small format than chance keeps apart: none shares a surrogate, none is one that occurs."""
    rows = [(i, f"mail q{i}@x.org now") for i in range(60)] + [(100, "q1@x.org and Q1@x.org")]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    made = [got[i].text.split()[1] for i in range(60)]
    assert len(set(made)) == 60 and not set(made) & {f"q{i}@x.org" for i in range(60)}
    assert got[100].n_entities == 2 and got[100].text.split()[0] == made[1] == got[100].text.split()[2].lower()


def test_surrogates_on_odd_rows(odd, none):
    got = surrogates.replace(odd, "k")
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    assert {tuple(r) for r in got.select("doc_id", "text").collect()} == {tuple(r) for r in odd.select("doc_id", "text").collect()}
    assert surrogates.replace(none, "k").count() == 0
