"""Fitted tree ensembles as plain node arrays, applied and explained in batches.

The node table comes from the saved model.  It holds one row per node, so its
size depends on the model, never on the data, and it travels to the tasks as a
broadcast.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import sigmoid
from riskloom.staging import shared_dir, stage

#: Rows of one range of margins when the AUC of rounds is tallied.
ROWS_PER_RANGE = 200_000
#: Rounds after which the margins of rows that are followed are written.
ROUNDS_PER_WALK = 256


@dataclass(frozen=True)
class Tree:
    """Parallel node arrays; a leaf has ``feature`` -1 and both children -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        leaf, own = self.feature < 0, np.arange(len(self.feature))
        feature, left, right = np.where(leaf, 0, self.feature), np.where(leaf, own, self.left), np.where(leaf, own, self.right)
        flat, start, node = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), dtype=np.int64)
        while not leaf[node].all():
            node = np.where(flat[start + feature[node]] <= self.threshold[node], left[node], right[node])
        return self.value[node]

    def leaves(self) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
        """Leaf value and, per feature on its path, the interval (low, high] and the share of cover kept."""
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                yield float(self.value[node]), path
                continue
            lo, hi, share = path.get(f, (-math.inf, math.inf, 1.0))
            t = float(self.threshold[node])
            for child, bounds in ((self.left[node], (lo, min(hi, t))), (self.right[node], (max(lo, t), hi))):
                kept = share * float(self.cover[child]) / float(self.cover[node])
                stack.append((int(child), {**path, f: (*bounds, kept)}))


def sent(spark: SparkSession, value: object) -> Callable[[], object]:
    """``value`` as a broadcast that carries the code of its classes, to be called for in a task."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(shared.value)


@dataclass(frozen=True)
class Forest:
    """Trees whose weighted values add up to the log-odds of class 1."""

    trees: tuple[Tree, ...]

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def table(self, spark: SparkSession) -> DataFrame:
        """Nodes as rows, the form in which a forest is saved."""
        rows = [(t, i, *(int(a[i]) for a in (tree.feature, tree.left, tree.right)), *(float(a[i]) for a in (tree.threshold, tree.value, tree.cover)))
                for t, tree in enumerate(self.trees) for i in range(len(tree.feature))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, `left` int, `right` int, threshold double, value double, cover double")

    @classmethod
    def load(cls, nodes: DataFrame) -> Forest:
        """The forest of a node table; its size is that of the model."""
        pdf = nodes.toPandas().sort_values(["tree", "node"])
        return cls(tuple(Tree(*(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "cover")))
                         for _, t in pdf.groupby("tree")))

    def prefix(self, n: int) -> Forest:
        return replace(self, trees=self.trees[:n])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.predict(x)
        return out

    def base(self) -> float:
        """Expected log-odds: leaf values weighted by cover."""
        return float(sum(v * np.prod([share for _, _, share in path.values()])
                         for t in self.trees for v, path in t.leaves()))

    def score(self, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Probability of class 1 next to the kept columns."""
        shared = sent(vectors.sparkSession, self)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared()
            for pdf in batches:
                if len(pdf):
                    margin = own.margins(np.stack(pdf["x"]))
                    yield pdf[list(keep)].assign(margin=margin)
        out = _arrays(vectors, keep).mapInPandas(run, _schema(vectors, keep, "margin double"))
        return out.select(*keep, sigmoid("margin").alias("p"))


def _arrays(vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
    return vectors.select(*keep, vector_to_array("features").alias("x"))


def _schema(df: DataFrame, keep: Sequence[str], extra: str) -> str:
    return ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], extra])


def forest_of(model: GBTClassificationModel) -> Forest:
    """Node arrays of a boosted model; its margin counts half a log-odd, hence the factor two."""
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/riskloom/model-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas()
    trees = []
    for tree_id, weight in enumerate(model.treeWeights):
        t = nodes[nodes["treeID"] == tree_id].sort_values("id")
        leaf = (t["leftChild"] < 0).to_numpy()
        trees.append(Tree(
            feature=np.where(leaf, -1, t["feature"].fillna(-1)).astype(np.int64),
            threshold=np.where(leaf, np.inf, t["threshold"].astype(float)),
            left=t["leftChild"].to_numpy(np.int64), right=t["rightChild"].to_numpy(np.int64),
            value=t["prediction"].to_numpy(float) * weight * 2.0, cover=t["rawCount"].to_numpy(float)))
    return Forest(tuple(trees))


@dataclass
class Walk:
    """Rows on which the rounds of a forest are followed, with the margins after its first ``at`` trees.

    Margins are written every ``every`` rounds, so that later rounds add up only the trees since
    then: all rounds together take time in proportion to their number.
    """

    vectors: DataFrame
    label: str = "y"
    every: int = ROUNDS_PER_WALK
    at: int = 0
    rows: DataFrame | None = None
    total: int = 0

    def reach(self, forest: Forest, first: int) -> None:
        """Go on towards round ``first``; the trees of ``forest`` up to there are those of earlier calls."""
        if self.rows is None:
            self.rows = self.vectors.select(F.col(self.label).cast("int").alias("y"), vector_to_array("features").alias("x"), F.lit(0.0).alias("margin"))
            self.total = self.rows.count()
        if first - self.at < self.every:
            return
        shared = sent(self.vectors.sparkSession, replace(forest, trees=forest.trees[self.at:first]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = shared()
            for pdf in batches:
                if len(pdf):
                    x, now = np.stack(pdf["x"]), pdf["margin"].to_numpy().copy()
                    for tree in own.trees:
                        now += tree.predict(x)
                    yield pdf.assign(margin=now)
        self.rows, self.at = stage(self.rows.mapInPandas(run, self.rows.schema), "walk"), first


def auc_by_round(forest: Forest, vectors: DataFrame, first: int, last: int, label: str = "y",
                 rows_per_range: int = ROWS_PER_RANGE, sample: int = 20_000, walk: Walk | None = None) -> list[float]:
    """AUC after each of the rounds ``first`` .. ``last - 1``, in one pass over the rows.

    A task adds up the trees once and has the margins of all rounds side by side.  Of each
    round it sends what it holds per range of margins: distinct values with their positive
    and negative rows.  Ranges are tallied apart and put together as in ``bootstrap_gini``;
    their edges come from a bounded sample and move balance only.  A ``walk`` over the rows
    spares the trees before those that it has added up.
    """
    spark = vectors.sparkSession
    walk = walk or Walk(vectors, label, every=last + 1)
    walk.reach(forest, first)
    rows, total, skip = walk.rows, walk.total, walk.at
    ahead = replace(forest, trees=forest.trees[skip:last])
    shared = sent(spark, ahead)

    def margins(own: Forest, pdf: pd.DataFrame) -> np.ndarray:
        x, now = np.stack(pdf["x"]), pdf["margin"].to_numpy()
        out = np.empty((last - first, len(x)))
        for r, tree in enumerate(own.trees, skip):
            now = now + tree.predict(x)
            if r >= first:
                out[r - first] = now
        return out

    def pack(y: np.ndarray, m: np.ndarray) -> list[bytes]:
        value, at = np.unique(m, return_inverse=True)
        return [value.tobytes(), *(np.bincount(at, weights=w, minlength=len(value)).tobytes() for w in (y, 1 - y))]

    edges = np.zeros((last - first, 0))
    parts = math.ceil(total / rows_per_range)
    if parts > 1:
        some = rows.sample(min(1.0, sample / total), 7).limit(2 * sample).toPandas()
        if len(some):
            edges = np.quantile(margins(ahead, some), np.arange(1, parts) / parts, axis=1).T
    cuts = spark.sparkContext.broadcast(edges)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared()
        for pdf in batches:
            if not len(pdf):
                continue
            y, out = pdf["y"].to_numpy(float), []
            for r, m in enumerate(margins(own, pdf)):
                place = np.searchsorted(cuts.value[r], m, side="right")
                out += [(first + r, int(i), *pack(y[place == i], m[place == i])) for i in np.unique(place)]
            yield pd.DataFrame(out, columns=["round", "range", "value", "pos", "neg"])

    def merge(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        value, pos, neg = (np.concatenate([np.frombuffer(v) for v in pdf[c]]) for c in ("value", "pos", "neg"))
        _, at = np.unique(value, return_inverse=True)
        pos, neg = np.bincount(at, weights=pos), np.bincount(at, weights=neg)
        below = np.cumsum(neg) - neg
        return pd.DataFrame([(*group, pos.sum(), neg.sum(), float((pos * (below + neg / 2)).sum()))], columns=["round", "range", "pos", "neg", "conc"])

    found = (rows.mapInPandas(tally, "`round` int, `range` int, value binary, pos binary, neg binary").groupBy("round", "range")
             .applyInPandas(merge, "`round` int, `range` int, pos double, neg double, conc double").toPandas().sort_values(["round", "range"]))
    out = []
    for _, t in found.groupby("round"):
        pos, neg = t["pos"].to_numpy(), t["neg"].to_numpy()
        if not pos.sum() or not neg.sum():
            raise ValueError("AUC needs rows of both classes")
        out.append(float((t["conc"].to_numpy() + pos * (np.cumsum(neg) - neg)).sum() / (pos.sum() * neg.sum())))
    return out


#: Paths with up to so many features have the shares of all their patterns laid down once.
TABLE_DEPTH = 10
#: Tests whose outcomes go into one number beside the number of a kind of rows.
TESTS_PER_CODE = 30


def pattern_shares(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley shares of a leaf of value 1 for each pattern (row) of features whose test the row passes.

    The leaf is reached with the product over its path features of "known and passed" (0 or
    1) or "unknown" (``share`` of cover).  The polynomial prod(share_i + inside_i t) is
    extended by one factor at a time; for each feature its own factor is unwound again, and
    the coefficients of what is left collect the coalitions by size.
    """
    n, d = inside.shape
    poly = np.zeros((n, d + 1))
    poly[:, 0] = 1.0
    for i in range(d):
        poly[:, 1:i + 2] = poly[:, 1:i + 2] * share[i] + poly[:, :i + 1] * inside[:, [i]]
        poly[:, 0] *= share[i]
    weight = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
    out = np.empty((n, d))
    for j in range(d):
        passed = np.zeros((n, d))
        passed[:, d - 1] = poly[:, d]
        for s in range(d - 1, 0, -1):
            passed[:, s - 1] = poly[:, s] - share[j] * passed[:, s]
        rest = np.where(inside[:, [j]] > 0, passed, poly[:, :d] / share[j])
        out[:, j] = (inside[:, j] - share[j]) * (rest @ weight)
    return out


@dataclass(frozen=True)
class Explainer:
    """Trees with their tests and their leaves' Shapley shares of all patterns; made once, applied to many batches."""

    trees: tuple

    @classmethod
    def of(cls, forest: Forest) -> Explainer:
        out = []
        for tree in forest.trees:
            leaves = []
            for value, path in tree.leaves():
                if not path or not value:
                    continue
                feats = np.array(list(path))
                low, high, share = (np.array([path[f][i] for f in path]) for i in range(3))
                d, table = len(feats), None
                if d <= TABLE_DEPTH:
                    every = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
                    table = value * pattern_shares(every, share)
                leaves.append((value, feats, low, high, share, table))
            inner = np.flatnonzero(tree.feature >= 0)
            tests = sorted({(int(tree.feature[i]), float(tree.threshold[i])) for i in inner})
            out.append((tests, sorted({f for f, _ in tests}), tuple(leaves)))
        return cls(tuple(out))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values (log-odds) of a batch, one column per feature.

        Rows that pass the same tests of a tree have the same shares of it, which are worked out once.
        NaN passes no test, as in ``Tree.predict``.
        """
        columns = np.nan_to_num(np.ascontiguousarray(x.T, dtype=float), nan=np.inf, posinf=np.inf)
        out = np.zeros_like(columns)
        for tests, used, leaves in self.trees:
            kind = np.zeros(len(x), np.int64)
            for i, (f, t) in enumerate(tests):
                if i and i % TESTS_PER_CODE == 0:  # few kinds again: their numbers leave room for more tests
                    kind = pd.factorize(kind)[0].astype(np.int64)
                kind = kind << 1 | (columns[f] <= t)
            kind, names = pd.factorize(kind)
            one = np.zeros(len(names), np.int64)
            one[kind] = np.arange(len(x))
            got = _shares(leaves, columns[:, one])
            for f in used:
                out[f] += got[f][kind]
        return out.T.copy()


def _shares(leaves: tuple, columns: np.ndarray) -> np.ndarray:
    """Shapley values of one tree, a row per feature as in ``columns``."""
    out = np.zeros_like(columns)
    for value, feats, low, high, share, table in leaves:
        passed = (columns[feats] > low[:, None]) & (columns[feats] <= high[:, None])
        if table is not None:
            got = table[(1 << np.arange(len(feats))) @ passed]
        else:
            kinds, which = np.unique(passed.T, axis=0, return_inverse=True)
            got = value * pattern_shares(kinds.astype(float), share)[which.ravel()]
        out[feats] += got.T
    return out


def shapley(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values (log-odds) of a batch, one column per feature."""
    return Explainer.of(forest).shapley(x)


def attributions(forest: Forest, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Shapley values per row as an array next to the kept columns."""
    shared = sent(vectors.sparkSession, (forest, Explainer.of(forest)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, explainer = shared()
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                yield pdf[list(keep)].assign(phi=list(explainer.shapley(x)), margin=own.margins(x))
    return _arrays(vectors, keep).mapInPandas(run, _schema(vectors, keep, "phi array<double>, margin double"))
