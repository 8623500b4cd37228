"""Importance resampling towards a target distribution, with an exact distributed cutoff.

Word runs are hashed to buckets.  Bucket counts of the documents and of the target texts
give every bucket a gain, the scaled and floored log ratio of its smoothed shares; the
gains are one array, and a document's weight is the sum over its features' places in it.
Weights are perturbed by hashed Gumbel noise, so that the highest scores are a sample
without replacement in proportion to the weights.

The cutoff is the k-th of all keys in order.  Every partition reports the median of what
is left of its keys above and below the pivot.  The next pivot is the median of those
medians, each weighted by the keys it stands for: at least a quarter of the keys left lie
on either side of it, so every round discards that share for certain.  The last few keys
are looked at one by one.  Winners are sorted by range and numbered by the sizes of the
ranges before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.words import Words, as_texts, slices, text_bytes
from riskloom.staging import stage

BUCKETS = 10_000
#: When so few keys are left, the driver orders them.
FINISH = 4_096
#: The table of keys is written anew when fewer than this share of its rows are left.
SHRINK = 0.25
SLICE = 2 << 20

_TO = np.arange(256, dtype=np.uint8)
_TO[65:91] += 32
_TO[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def feature_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the text number of each, and the words per text.

    A word is a run of lower-cased letters, digits and characters beyond ASCII; features are
    the runs of 1 to ``longest`` neighbouring words, joined by one space.
    """
    data, starts = text_bytes(texts)
    w = Words(as_texts(_TO[data], starts))
    n = np.diff(w.starts)
    row = np.repeat(np.arange(len(texts)), n)
    words = [x.encode() for x in w.distinct.to_pylist()]
    single = np.array([zlib.crc32(x) % buckets for x in words], np.int64) if words else np.zeros(0, np.int64)
    found, rows = [single[w.codes]], [row]
    for size in range(2, longest + 1):
        at = np.flatnonzero(row[size - 1:] == row[:max(0, len(row) - size + 1)])
        runs = np.stack([w.codes[at + i] for i in range(size)], axis=1) if len(at) else np.zeros((0, size), np.int64)
        kinds, which = np.unique(runs, axis=0, return_inverse=True)
        hashed = np.array([zlib.crc32(b" ".join(words[i] for i in k)) % buckets for k in kinds.tolist()], np.int64)
        found.append(hashed[which.ravel()] if len(at) else np.zeros(0, np.int64))
        rows.append(row[at])
    return np.concatenate(found), np.concatenate(rows), n


def bucket_counts(table: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts of a table; a task sends one row per bucket it has."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                total += np.bincount(feature_buckets(part.column("text"), longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = (table.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict())
    out = np.zeros(buckets, np.int64)
    out[np.array(rows["bucket"], np.int64)] = rows["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Gain of each bucket: floor of a thousand times the log ratio of the target's smoothed share and the documents'."""
    size, s, t = len(have), int(have.sum()), int(want.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in zip(have.tolist(), want.tolist())], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: str) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight``, ``score`` of every row."""
    sent, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=SLICE):
                at, row, n = feature_buckets(part.column("text"), longest, buckets)
                features = np.bincount(row, minlength=len(n))
                order = np.argsort(row, kind="stable") if longest > 1 else slice(None)
                sums = np.concatenate([[0], np.cumsum(sent.value[at[order]])])
                ends = np.cumsum(features)
                weight = sums[ends] - sums[ends - features]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (features, n, weight))],
                                                 names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return (rows.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long")
            .withColumn("score", F.col("weight") + noise))


#: Order of the keys: higher score, smaller doc_id (a missing one last), smaller row number.
KEY = ("neg", "id", "row")


def _before(key: tuple[int, int, int], inclusive: bool):
    """Rows whose key comes before ``key``, or is it; the first part alone can be pushed to the scan."""
    a, b, c = (F.lit(v) for v in key)
    last = F.col("row") <= c if inclusive else F.col("row") < c
    return (F.col("neg") <= a) & ((F.col("neg") < a) | (F.col("id") < b) | ((F.col("id") == b) & last))


def _after(key: tuple[int, int, int]):
    a, b, c = (F.lit(v) for v in key)
    return (F.col("neg") >= a) & ((F.col("neg") > a) | (F.col("id") > b) | ((F.col("id") == b) & (F.col("row") > c)))


def kth_key(keys: DataFrame, k: int, finish: int = FINISH) -> tuple[int, int, int] | None:
    """The ``k``-th key of ``keys`` (long columns ``neg``, ``id``, ``row``, no two rows equal); None for k = 0.

    A round is one pass that sends a row per partition and side of the pivot to the driver.
    """
    def medians(pivot):
        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*[[b.column(n).to_numpy() for n in KEY] for b in batches])] or [np.zeros(0, np.int64)] * 3
            neg, num, row = cols
            low = np.ones(len(neg), bool)
            if pivot:
                low = (neg < pivot[0]) | ((neg == pivot[0]) & ((num < pivot[1]) | ((num == pivot[1]) & (row <= pivot[2]))))
            for side, at in ((0, np.flatnonzero(low)), (1, np.flatnonzero(~low))):
                if len(at):
                    mid = at[np.lexsort((row[at], num[at], neg[at]))[(len(at) - 1) // 2]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (side, len(at), neg[mid], num[mid], row[mid])],
                                                     names=["side", "n", *KEY])
        return report

    if k <= 0:
        return None
    left, rows, pivot, low, high = keys, None, None, None, None
    while True:
        found = left.mapInArrow(medians(pivot), "side long, n long, neg long, id long, row long").collect()
        sizes = [sum(r["n"] for r in found if r["side"] == s) for s in (0, 1)]
        side = 0 if k <= sizes[0] else 1
        if side:
            k, low = k - sizes[0], pivot
        else:
            high = pivot
        held, total = sorted((tuple(r[c] for c in KEY), r["n"]) for r in found if r["side"] == side), sizes[side]
        bounds = ([_after(low)] if low else []) + ([_before(high, True)] if high else [])
        left = keys
        for b in bounds:
            left = left.where(b)
        if total <= finish:
            return sorted(tuple(r) for r in left.select(*KEY).collect())[k - 1]
        rows = rows or sum(sizes)
        if total < SHRINK * rows:
            keys, rows, low, high = stage(left.select(*KEY), "keys-left"), total, None, None
            left = keys
        seen = 0
        for pivot, n in held:
            seen += n
            if 2 * seen >= total:
                break


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` by key: sorted by range, numbered inside a range and by the sizes of those before."""
    number = F.monotonically_increasing_id()
    placed = stage(winners.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumns(
        {"part": F.shiftright(number, 33), "at": number.bitwiseAND((1 << 33) - 1)}), "winners")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    table = placed.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part long, first long")
    return placed.join(F.broadcast(table), "part").withColumn("rank", F.col("first") + F.col("at") + 1).drop("part", "at", "first")


def select(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = BUCKETS,
           seed: str = "2024", finish: int = FINISH) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of every row; ``rank`` is null for rows not drawn.

    Of the rows with ``min_words`` words, the ``percent`` percent (rounded down) with the
    highest scores are drawn.  Ties go to the smaller doc_id; a missing doc_id hashes as the
    empty text and comes after all others of its score.  Rows that repeat are each scored and
    can each be drawn; which of equal rows has which rank is left open.  Null and empty texts
    have no features and weight 0.  Texts go whole, whatever their length.  An empty table
    gives an empty one; an empty target counts nothing.  Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = scored(docs, gain, longest, seed).withColumns({
        "neg": -F.col("score"), "id": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row": F.monotonically_increasing_id()})
    rows = stage(rows, "importance-scores")
    able = rows.where(F.col("n_words") >= min_words)
    cutoff = kth_key(able.select(*KEY), able.count() * percent // 100, finish)
    cols = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return rows.select(*cols, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & _before(cutoff, True)
    return ranked(rows.where(drawn)).select(*cols, "rank").unionByName(rows.where(~drawn).select(*cols, F.lit(None).cast("long").alias("rank")))
