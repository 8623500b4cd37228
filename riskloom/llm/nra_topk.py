"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Rows are dealt into blocks, queries into chunks; every pair of a chunk and a block is one
row of work, so nothing is held whole by one task.  A block has a list of its rows for
every dimension, sorted by value.  For a query the list gives contributions in falling
order when read from the top (positive query value) or from the bottom (negative).
Lists are read from their heads in growing batches; every entry read adds to the known
part of its row.  Unread dimensions add at most what stands at the depth reached and at
least what the list ends with.  Rows whose upper bound is below the k-th largest lower
bound cannot qualify and are given up, seen or not.  Reading goes on until every row that
is left has been met in all lists, so its score is the sum of what was read; no row is
ever looked up out of its lists' order.  The best of all blocks are
merged per query.

The queries of a chunk read a block's lists together, to the same depths: what a batch adds
to the known parts, and what the unread rest can add, are then products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, queries of a chunk.
BLOCK, CHUNK = 8192, 256
#: The first batches grow by this factor; past the middle of the lists each reads half of what is left.
GROWTH = 4
#: With so few rows left a query reads its lists to the end, passing over all other rows.
LAST = 256


class Lists:
    """A block's rows (``x``: rows by dimensions, whole numbers) as sorted lists, one per dimension."""

    def __init__(self, x: np.ndarray):
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(np.ascontiguousarray(x.T), self.order, axis=1)

    def read(self, lists: np.ndarray, falling: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Entries ``start`` to ``stop`` of every list, from its end where ``falling``."""
        n = lists.shape[1]
        return np.where(falling, lists[:, n - stop:n - start][:, ::-1], lists[:, start:stop])

    def top(self, q: np.ndarray, k: int, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that may be among a query's k best (all of those that are), their scores, and the depth read.

        ``barred`` rows are left out.  Rows that tie with the k-th stay.
        """
        (dims, n), falling, weight = self.order.shape, (q > 0)[:, None], q[:, None]
        known = np.zeros(n, q.dtype)
        unread = np.ones((n, dims), q.dtype)
        unread[:, q == 0] = 0
        left = np.flatnonzero(~barred)
        least = self.read(self.values, falling, n - 1, n)[:, 0] * q if n else None
        depth, step = 0, k
        while unread[left].any():
            stop = min(n, depth + step)
            rows, part = self.read(self.order, falling, depth, stop), self.read(self.values, falling, depth, stop) * weight
            if part.dtype == object:
                np.add.at(known, rows.ravel(), part.ravel())
            else:
                known += np.bincount(rows.ravel(), part.ravel(), n)
            unread[rows, np.arange(dims)[:, None]] = 0
            depth, step = stop, min(stop * (GROWTH - 1), max(k, (n - stop) // 2))
            if len(left) > k:
                rest = unread[left]
                lower, upper = known[left] + rest @ least, known[left] + rest @ part[:, -1]
                left = left[upper >= np.sort(lower)[-k]]
        return left, known[left], depth


    def top_many(self, q: np.ndarray, k: int, barred: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``top`` for all rows of ``q``, which read to the same depths: rows and scores of each, in order.

        ``barred`` has the queries as rows and the block's rows as columns.
        """
        dims, n = self.order.shape
        place = np.empty((n, dims), np.int32)
        np.put_along_axis(place, self.order.T, np.arange(n, dtype=np.int32)[:, None], axis=0)
        x = np.empty((n, dims), q.dtype)
        np.put_along_axis(x, self.order.T, self.values.T, axis=0)
        # Every dimension has two lists: one read from its end by positive values, one from its head by negative ones.
        sides = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        least = sides * np.concatenate([self.values[:, :1], self.values[:, -1:]])[:, 0] if n else sides
        met = np.concatenate([n - 1 - place, place], axis=1)  # the depth at which a list comes to a row
        both, barred = np.concatenate([x, x], axis=1), barred.copy()
        known, out = np.zeros((len(q), n), q.dtype), [None] * len(q)
        live, depth = np.arange(len(q)), 0

        def close(i, left):
            rest = np.where(met[left] >= depth, both[left], 0) @ sides[i]
            out[i] = left, known[np.searchsorted(live, i)][left] + rest

        while len(live) and depth < n:
            stop = min(n, max(k, n // 64) if not depth else min(depth * GROWTH, depth + max(k, (n - depth) // 2)))
            known += sides[live] @ np.where((met >= depth) & (met < stop), both, 0).T
            depth = stop
            rest = (met >= depth).astype(q.dtype)
            head = sides[live] * np.concatenate([self.values[:, n - depth], self.values[:, depth - 1]])
            lower, upper = known + least[live] @ rest.T, known + head @ rest.T
            if n > k:
                lower[barred] = upper[barred] = -np.inf
                barred |= upper < np.partition(lower, n - k, axis=1)[:, n - k, None]
            few = (~barred).sum(axis=1) <= LAST
            for at in np.flatnonzero(few):
                close(live[at], np.flatnonzero(~barred[at]))
            live, known, barred = live[~few], known[~few], barred[~few]
        for at, i in enumerate(live):
            close(i, np.flatnonzero(~barred[at]))
        yield from out


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """(query, row ids, scores) of each query's k best rows of a block, ties to smaller ids."""
    dims = max(x.shape[1], q.shape[1])
    x, q = (np.pad(a, ((0, 0), (0, dims - a.shape[1]))) for a in (x, q))
    largest = [max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0)))) for a in (x, q)]
    # Sums that floats or doubles hold exactly are kept in them, larger ones in Python's whole numbers.
    bound = largest[0] * largest[1] * dims
    held = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object
    lists, q = Lists(x.astype(held)), q.astype(held)
    barred = ids == query_ids[:, None]
    if held is object:
        found = (lists.top(vector, k, no)[:2] for vector, no in zip(q, barred))
    else:
        found = lists.top_many(q, k, barred)
    for i, (rows, score) in zip(query_ids, found):
        best = sorted(range(len(rows)), key=lambda j: (-score[j], ids[rows[j]]))[:k] if held is object else np.lexsort((ids[rows], -score))[:k]
        yield i, ids[rows][best], score[best]


def whole_numbers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id`` and ``x``: every component times ``scale``, rounded down; null vectors and those with null or non-finite components are left out.

    Values beyond the range of a long are held at its ends.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    edge = float(1 << 62)
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda v: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(v.cast("double") * scale).cast("double"))).cast("long")).alias("x"))


def _packed(rows: DataFrame, into: str, parts: int) -> DataFrame:
    """Rows of ``vec_id``, ``x`` gathered by a hash of the id into parts: ``into``, ``ids``, ``dims``, ``values``."""
    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy()
        dims = max(map(len, pdf["x"]))
        x = np.zeros((len(ids), dims), np.int64)
        for r, v in enumerate(pdf["x"]):
            x[r, :len(v)] = v
        order = np.argsort(ids, kind="stable")
        small = np.abs(x).max(initial=0) < 1 << 15
        return pd.DataFrame({into: [int(pdf[into].iloc[0])], "ids": [ids[order].astype("<i8").tobytes()], "dims": [dims],
                             "width": [2 if small else 8], "values": [x[order].astype("<i2" if small else "<i8").tobytes()]})

    dealt = rows.withColumn(into, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    return dealt.groupBy(into).applyInPandas(gather, f"{into} int, ids binary, dims int, width int, values binary")


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best rows.

    Queries are the rows whose vec_id ``every`` divides; a query's own id is no candidate.
    Missing components of shorter vectors count as 0.  Rows that repeat a vec_id are
    candidates each (equal ones are ranked in any order); a repeated query id is one query,
    by the row with the smallest components.  Scores are exact; beyond a long they are held
    at its ends.  Other columns of ``vectors`` are ignored.
    """
    rows = whole_numbers(vectors, scale)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    total = rows.count()
    blocks, chunks = max(1, -(-total // BLOCK)), max(1, -(-total // (every * CHUNK)))
    left = _packed(rows, "block", blocks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = _packed(queries, "chunk", chunks).withColumnsRenamed({c: f"q_{c}" for c in ("ids", "dims", "width", "values")})
    work = left.join(right, "chunk").repartition(max(1, blocks * chunks), "chunk", "block")

    def read(ids, dims, width, values):
        ids = np.frombuffer(ids, "<i8")
        return ids, np.frombuffer(values, f"<i{width}").reshape(len(ids), dims)

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = read(r["ids"], r["dims"], r["width"], r["values"])
                query_ids, q = read(r["q_ids"], r["q_dims"], r["q_width"], r["q_values"])
                out = list(block_top(ids, x, query_ids, q, k))
                edge = (1 << 63) - 1
                held = [int(min(edge, max(-edge, v))) for _, _, s in out for v in s.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([i for i, _, _ in out], [len(a) for _, a, _ in out]), pa.int64()),
                    pa.array(np.concatenate([a for _, a, _ in out]) if out else [], pa.int64()),
                    pa.array(held, pa.int64())], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
