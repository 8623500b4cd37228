"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are runs of three to five characters of lower-case words with a blank at both
ends, hashed to ``2 ** bits``; a feature's value is the number of the document's
different words that hold it.  First every feature gets its naive Bayes ratio, the log
of its share among toxic documents over that among others, from counts that Spark sums
over the training rows.  Features times ratios are then the input of a logistic
classifier, trained on shards of a bounded sample (``max_train`` rows) whose weights
are averaged.  Ratio times weight is one number per n-gram, so a word's part in a score
is summed once per batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.labelled import held_out, training_rows
from riskloom.llm.words import Words, gram_hashes, mix, slices

MAX_TRAIN = 9_000
SHARDS = 6
SIZES = (3, 4, 5)
#: Smallest log-count ratio that a feature is used with.
LEAST_RATIO = 1.5


def word_grams(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of distinct words: the word's number and the feature, for all n-grams of all words."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer((" " + " ".join(pc.utf8_lower(words).to_pylist()) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    blank = chars == 32
    word = np.cumsum(blank) - 1
    owner, feature = [], []
    for n in SIZES:
        g = gram_hashes(chars, n)
        inside = np.zeros(len(g), bool)
        for i in range(1, n - 1):
            inside |= blank[i:i + len(g)]
        ok = ~inside
        owner.append(word[:len(g)][ok])
        feature.append((mix(g[ok]) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(feature)


def doc_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distinct words of a batch: one pair for every different word of a row, by row."""
    rows = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
    size = max(1, len(w.distinct))
    pairs = np.unique(rows * size + w.codes)
    return pairs // size, pairs % size


def ratios(rows: DataFrame, bits: int, smooth: float = 20.0) -> np.ndarray:
    """Naive Bayes log-count ratios of all features from ``text``, ``label``.

    Each feature gets ``smooth`` counts more, shared by the classes' totals, so what is rare stays near a ratio of 0.
    Ratios below ``LEAST_RATIO`` either way are set to 0: those features say nothing.
    """
    def count(batches):
        total = np.zeros((2, 1 << bits))
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                doc, word = doc_words(w)
                owner, feature = word_grams(w.distinct, bits)
                label = part.column("label").to_numpy()
                for y in (0, 1):
                    held = np.bincount(word[label[doc] == y], minlength=len(w.distinct))
                    total[y] += np.bincount(feature, weights=held[owner], minlength=1 << bits)
        at = np.flatnonzero(total.sum(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], names=["at", "p", "q"])

    table = rows.mapInArrow(count, "at long, p double, q double").groupBy("at").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toPandas()
    p, q = np.zeros(1 << bits), np.zeros(1 << bits)
    p[table["at"].to_numpy(int)] = table["p"].to_numpy(float)
    q[table["at"].to_numpy(int)] = table["q"].to_numpy(float)
    share = (p.sum() + 1) / (p.sum() + q.sum() + 2)
    p, q = p + smooth * share, q + smooth * (1 - share)
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    return np.where(np.abs(r) < LEAST_RATIO, 0, r)


def _logistic(at, x, starts, y, size: int, rounds: int = 120, l2: float = 1.0) -> np.ndarray:
    """Weights and intercept of a regularised logistic fit, by full-batch steps with per-weight rates (Adam)."""
    w, b = np.zeros(size), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    for t in range(1, rounds + 1):
        s = np.concatenate([[0.0], np.cumsum(w[at] * x)])
        p = 1 / (1 + np.exp(-np.clip(s[starts[1:]] - s[starts[:-1]] + b, -35, 35)))
        e = (p - y) / len(y)
        g = np.bincount(at, weights=e[row] * x, minlength=size) + l2 * w / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.03 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        mb, vb = 0.9 * mb + 0.1 * e.sum(), 0.99 * vb + 0.01 * e.sum() ** 2
        b -= 0.03 * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-6)
    return np.append(w, b)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", bits: int = 20, max_train: int = MAX_TRAIN, shards: int = SHARDS) -> np.ndarray:
    """One number per feature (ratio times weight) and the intercept; all zero without labelled rows."""
    rows = training_rows(docs, labels, target, max_train, shards)
    sent = docs.sparkSession.sparkContext.broadcast(ratios(rows, bits))

    def learn(batches):
        kept = {}
        for batch in batches:
            r = sent.value
            for part in slices(batch):
                w = Words(part.column("text"))
                owner, feature = word_grams(w.distinct, bits)
                order = np.argsort(owner, kind="stable")
                owner, feature = owner[order], feature[order]
                begin = np.searchsorted(owner, np.arange(len(w.distinct) + 1))
                doc, word = doc_words(w)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                for i, (y, s) in enumerate(zip(part.column("label").to_pylist(), part.column("shard").to_pylist())):
                    own = word[cuts[i]:cuts[i + 1]]
                    size = begin[own + 1] - begin[own]
                    at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(own) else own, size) + np.arange(size.sum())
                    f, c = np.unique(feature[at][r[feature[at]] != 0], return_counts=True)
                    kept.setdefault(s, []).append((f.astype(np.int32), (c * r[f]).astype(np.float32), y))
        for s, members in kept.items():
            starts = np.concatenate([[0], np.cumsum([len(d[0]) for d in members])])
            used, own = np.unique(np.concatenate([d[0] for d in members]), return_inverse=True)
            model = _logistic(own, np.concatenate([d[1] for d in members]), starts, np.array([d[2] for d in members]), len(used))
            at = np.append(used.astype(np.int64), 1 << bits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model), pa.array(np.full(len(at), s))], names=["at", "w", "shard"])

    table = (rows.repartition(shards, "shard").mapInArrow(learn, "at long, w double, shard long")
             .groupBy("at").agg(F.sum("w").alias("w"), F.collect_set("shard").alias("s")).toPandas())
    w = np.zeros((1 << bits) + 1)
    if len(table):
        w[table["at"].to_numpy()] = table["w"].to_numpy() / len(set().union(*table["s"]))
        w[:-1] *= sent.value
    return w


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` of every row; a text without words gets the intercept's score."""
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches):
        for batch in batches:
            v = sent.value
            for part in slices(batch):
                w = Words(part.column("text"))
                owner, feature = word_grams(w.distinct, bits)
                each = np.bincount(owner, weights=v[feature], minlength=len(w.distinct))
                doc, word = doc_words(w)
                m = v[-1] + np.bincount(doc, weights=each[word], minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(m, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Score of every document and ``predicted`` (1 when it reaches ``threshold``).

    Null texts count as empty.  Repeated rows are scored each.  Columns of ``docs`` other
    than doc_id and text, and all of ``labels`` but doc_id and the target, are ignored.
    """
    return score(docs, fit(docs, labels, **options)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
