"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A word gives two views: itself in lower case, and its shape (letters by case, digits and
other characters by kind, runs collapsed, with a mark when the word repeats the one
before).  Runs of one and two words of the first view and of one to three of the second
are hashed to ``2 ** bits`` weights.  A feature's value is its share of the document's
features times ``SCALE``, so a score is one sparse dot product with the counts and no
document is too long.

Training takes a bounded sample (``max_train`` rows).  Every shard of it learns with
per-coordinate FTRL-proximal steps, the shards' weights are averaged.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.labelled import held_out, training_rows
from riskloom.llm.words import Words, gram_hashes, mix, slices

SCALE = 30.0
MAX_TRAIN = 12_000
SHARDS = 6
#: Bytes of text whose features are held at a time.
SLICE = 2 << 20

_RUNS = [(re.compile(p), s) for p, s in (
    ("[^\\W\\d_]+", lambda m: "X" if m[0].isupper() else "x" if m[0].islower() else "Xx"), ("[0-9]+", "9"))]


def shape(word: str) -> str:
    """Outline of a word: case of its letter runs, 9 for digits, other characters as they are, at most eight of them."""
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return word[:8]


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, one after another, and where each text's start (one more at the end)."""
    w = Words(texts)
    if not len(w.codes):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    words = w.distinct.to_pylist()
    lower = pd.util.hash_array(np.array([x.lower() for x in words], object), categorize=False)[w.codes]
    outline = pd.util.hash_array(np.array([shape(x) for x in words], object), categorize=False)[w.codes]
    same = np.concatenate([[False], lower[1:] == lower[:-1]])
    same[w.starts[:-1][w.starts[:-1] < len(same)]] = False
    outline = mix(outline + np.uint64(77) + same.astype(np.uint64))
    row = np.repeat(np.arange(len(texts)), np.diff(w.starts))
    rows, idx = [], []
    for view, upto in ((lower, 2), (outline, 3)):
        for n in range(1, upto + 1):
            g = gram_hashes(view, n)
            ok = row[:len(g)] == row[n - 1:]
            rows.append(row[:len(g)][ok])
            idx.append((mix(g[ok] + np.uint64(upto)) >> np.uint64(64 - bits)).astype(np.int64))
    rows, idx = np.concatenate(rows), np.concatenate(idx)
    order = np.argsort(rows, kind="stable")
    return idx[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))])


class Ftrl:
    """Per-coordinate FTRL-proximal learner; the last coordinate is the intercept and is not regularised."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, root = self.z[at], np.sqrt(self.n[at])
        w = -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + root) / self.alpha + self.l2)
        return w

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        w[-1] = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more

    def final(self) -> np.ndarray:
        w = self.weights(slice(None))
        w[-1] = -self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha)
        return w


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", bits: int = 18, max_train: int = MAX_TRAIN,
        epochs: int = 4, shards: int = SHARDS) -> np.ndarray:
    """Weights (``2 ** bits`` and the intercept), averaged over the shards; all zero without labelled rows."""
    rows = training_rows(docs, labels, target, max_train, shards)

    def learn(batches):
        learners, kept = {}, {}
        for batch in batches:
            for part in slices(batch, size=SLICE):
                idx, starts = features(part.column("text"), bits)
                for i, (y, s) in enumerate(zip(part.column("label").to_pylist(), part.column("shard").to_pylist())):
                    at, count = np.unique(idx[starts[i]:starts[i + 1]], return_counts=True)
                    kept.setdefault(s, []).append((at.astype(np.int32), (SCALE * count / max(1, count.sum())).astype(np.float32), y))
        for s, docs_ in kept.items():
            learners[s] = Ftrl(1 << bits)
            docs_.sort(key=lambda d: (int(d[0].sum()), len(d[0]), d[2]))
            for e in range(epochs):
                for i in np.random.default_rng(e).permutation(len(docs_)):
                    learners[s].step(*docs_[i])
        for s, learner in learners.items():
            w = learner.final()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), s))], names=["at", "w", "shard"])

    out = rows.repartition(shards, "shard").mapInArrow(learn, "at long, w double, shard long")
    table = (out.groupBy("at").agg(F.sum("w").alias("w"), F.collect_set("shard").alias("s"))).toPandas()
    w = np.zeros((1 << bits) + 1)
    if len(table):
        w[table["at"].to_numpy()] = table["w"].to_numpy() / len(set().union(*table["s"]))
    return w


def probabilities(texts: pa.Array, w: np.ndarray, bits: int) -> np.ndarray:
    """Scores of some texts: a sparse dot product each."""
    idx, starts = features(texts, bits)
    sums = np.concatenate([[0.0], np.cumsum(w[idx])])
    m = w[-1] + SCALE * (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(np.diff(starts), 1)
    return 1 / (1 + np.exp(-np.clip(m, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` of every row; a text without words gets the intercept's score."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(probabilities(part.column("text"), sent.value, bits))],
                                                 names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Score of every document and ``predicted`` (1 when it reaches ``threshold``).

    Null texts count as empty.  Repeated rows are scored each.  Columns of ``docs`` other
    than doc_id and text, and all of ``labels`` but doc_id and the target, are ignored.
    """
    return score(docs, fit(docs, labels, **options)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, unchanged, with all their columns.

    Null and empty texts get the intercept's score; repeated rows are judged each; an empty
    table gives an empty one.  A text goes to the worker once, whatever its length, and about
    ``SLICE`` bytes of them are scored at a time.
    """
    weights = fit(docs, labels, **options)
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def choose(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                yield part.filter(pa.array(probabilities(part.column("text"), sent.value, bits) >= threshold))

    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(choose, docs.schema)
