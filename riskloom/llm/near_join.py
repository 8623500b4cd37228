"""N-gram Jaccard join with PartEnum signatures.

Sets of word shingles are put in size bands.  Within a band a Jaccard similarity
becomes a bound k on the number of differing shingles.  The domain of shingles is cut
into n1 partitions of n2 parts each, and a set gets one signature for every choice of
n2 - k2 parts of a partition: with n1 * (k2 + 1) > k some partition has at most k2
differing shingles, so two sets that are similar enough share a signature.  Some
partitions more than that are made, so that a set can leave out signatures of parts in
which it has nothing: while its partitions with an empty choice are fewer than the
partitions sure to agree, one that agrees has none.

Where parts would hold few shingles (below a similarity of about 0.85) a band takes
prefixes instead: all sets put their shingles in one order, and of two similar sets the
first shingle in common is among the first n - ceil(t n) + 1 of both.  Each of these is a
signature.  The order puts shingles that many sets hold last; which these are is counted
on a share of the texts, which moves work, never a result.

From the signatures to components:

1. Tasks sort what they have of each signature and send on one row of it (its first
   set); the others stay with that set.  So a signature that a third of all rows carry
   arrives as one row per task.
2. In a bucket (the sets of one signature) every set is compared with the first one:
   counts of shingles per hash cell bound the difference from below and drop most of
   those that are not similar; the others are compared exactly, on the whole sets.
3. Buckets whose sets ended in different components are compared in blocks: the sets
   outside the bucket's main component against all that are in another one.  First only
   the closest candidate of a set in a block is looked at, which connects most of what
   can be connected; then, in buckets where a set had more candidates, all that are still
   apart are.  No link between components is lost.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.words import Words, gram_hashes, mix, slices
from riskloom.staging import stage as write_stage

#: Signature rows that a map task sorts at a time, and hands on at a time.
BUFFER, PIECE = 1_000_000, 1 << 16
#: A band takes the fewest signatures that cover so many shingles each, among plans with at most so many signatures;
#: bands of larger sets take one part per choice.
LEAST_FEATURES, MOST_SIGNATURES = 6, 64
#: Orders of shingles look at one text of so many for shingles that come twice in those texts, and keep them in so many bits.
SHARE, COMMON = 32, 1 << 23
#: Cells of the count sketch that comparisons look at first.
CELLS = 256
#: Cells of the sketch that is compared before two whole sets meet, for sets of so many shingles.
FINE, LARGE = 4096, 2048
#: Bits of the bitmap that names documents whose texts are read again.
SLOTS = 1 << 21
#: Sets in a block of the exact comparison inside a bucket.
BLOCK = 2048
#: Rows of blocks that get their cells in one pass, and passes at most: a row with its cells takes several times the room of one without.
PASS_ROWS, MOST_PASSES = 1_000_000, 8
#: Rows of a small table that are worth a task of their own.
TASK_ROWS = 1 << 14
#: Bytes of text whose sets are signed at a time, pairs that are looked at together in a block, and pairs so few that no bits are made.
SLICE, PAIRS, FEW = 2 << 20, 1 << 15, 1 << 11


class Scheme:
    """Bands and partitions for one similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]

    def bands(self, size: int) -> list[int]:
        """Bands whose signatures a set of this size gets: its own, and higher ones that hold similar sizes."""
        while self.lows[-1] <= size * self.den // self.num + 1:
            low = self.lows[-1]
            self.lows.append(max(low + 1, ceil(low * Fraction(self.den, self.num) ** 3)))
        own = int(np.searchsorted(self.lows, size, side="right")) - 1
        out, t = [own], own + 1
        while t < len(self.lows) and self.lows[t] * self.num <= size * self.den:
            out.append(t)
            t += 1
        return out

    def plan(self, band: int) -> tuple[int, float, int, int, int]:
        """Signatures of a set of a band, shingles that each covers, partitions needed, n2 and k2."""
        while len(self.lows) < band + 2:
            self.lows.append(max(self.lows[-1] + 1, ceil(self.lows[-1] * Fraction(self.den, self.num) ** 3)))
        low, high = self.lows[band], self.lows[band + 1] - 1
        k = 2 * high * (self.den - self.num) // (self.den + self.num)
        mid, plans = sqrt(low * high), []
        for k2, n2 in ((0, 1), (1, 3), (2, 4), (3, 6)):
            need = k // (k2 + 1) + 1
            plans.append((need * comb(n2, k2), mid / need * (n2 - k2) / n2, need, n2, k2))
        few = [p for p in plans if p[0] <= MOST_SIGNATURES]
        sharp = [p for p in few if p[1] >= LEAST_FEATURES]
        return min(sharp) if sharp else max(few, key=lambda p: p[1]) if few else plans[0]

    def parts(self, band: int) -> tuple[int, int, int, int]:
        """n1, n2, k2 and the number of partitions sure to agree, for a band."""
        _, cover, need, n2, k2 = self.plan(band)
        empty = need * comb(n2, k2) * exp(-cover)
        spare = ceil(empty + 2 * sqrt(empty)) if need > 1 else 0
        return need + spare, n2, k2, spare + 1

    def prefix(self, size: int) -> int:
        """How many of the first shingles of a set hold one that is also among the first of any similar set."""
        return size + 1 + -size * self.num // self.den

    def prefixed(self, band: int) -> bool:
        """Whether sets meet in a band by their first shingles: where parts cover little and these are fewer."""
        made, cover, *_ = self.plan(band)
        return cover < LEAST_FEATURES and self.prefix(self.lows[band + 1] - 1) < made


def signatures_of(grams: np.ndarray, row: np.ndarray, rows: int, band: int, parts: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures in a band of some sets (distinct shingle hashes and the number of the set each is of), and whose each is."""
    n1, n2, k2, sure = parts
    at = (mix(grams + np.uint64(0x51ED270B)) % np.uint64(n1 * n2)).astype(np.int64) + row * (n1 * n2)
    sums = np.zeros(rows * n1 * n2, np.uint64)
    np.add.at(sums, at, mix(grams + np.uint64(0x2545F491)))
    part = mix(sums.reshape(rows, -1) + np.arange(n1 * n2, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(rows, n1, n2)
    has = np.bincount(at, minlength=len(sums)).reshape(rows, n1, n2) > 0
    choices = [list(c) for c in combinations(range(n2), n2 - k2)]
    sigs = np.stack([mix(part[:, :, c].sum(axis=2, dtype=np.uint64) + np.uint64(1 + i)) for i, c in enumerate(choices)], axis=1)
    full = np.stack([has[:, :, c].any(axis=2) for c in choices], axis=1)
    take = full | ((~full).any(axis=1).sum(axis=1) >= sure)[:, None, None]
    return mix(sigs[take] + mix(np.array([band]))), np.broadcast_to(np.arange(rows)[:, None, None], take.shape)[take]


def signatures(grams: np.ndarray, band: int, parts: tuple[int, int, int, int]) -> np.ndarray:
    """Signatures of one set in a band."""
    return signatures_of(grams, np.zeros(len(grams), np.int64), 1, band, parts)[0]


def places(grams: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Place of each shingle in the order of all: by hash, those marked in the bitmap ``common`` after all others."""
    slot = grams % np.uint64(8 * len(common))
    late = (common[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
    return mix(grams + np.uint64(0x3C6EF372)) >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)


def first_places(at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` first of the places of a set, and any that equal the last of them."""
    return at[at <= np.partition(at, size - 1)[size - 1]]


def shingles(words: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingles of a document from its word hashes and the hashes of its runs of ``n``."""
    if len(words) >= n:
        return np.unique(grams)
    return gram_hashes(words, len(words))[:1] if len(words) else np.zeros(0, np.uint64)


def set_rows(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and set of each row of a batch."""
    base = 0
    for part in slices(batch):
        w = Words(part.column("text"), lower=True)
        h = w.hashes()[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
        g = gram_hashes(h, n)
        for i, (a, b) in enumerate(zip(w.starts[:-1].tolist(), w.starts[1:].tolist())):
            yield base + i, shingles(h[a:b], g[a:max(a, b - n + 1)], n)
        base += part.num_rows


def node_of(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(mix(mix(grams + np.uint64(0x632BE5AB)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(grams))).view(np.int64)[0])


def cell_counts(grams: np.ndarray, cells: int = CELLS) -> bytes:
    """Shingles per hash cell, up to 255: sets differ by at least the sum of the differences."""
    count = np.bincount((grams >> np.uint64(40)).astype(np.int64) % cells, minlength=cells)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


def cell_bits(held: np.ndarray, mean: float) -> np.ndarray:
    """A bit per cell and count, of the counts around ``mean``: whether the cell has as many, in words of 64 bits.

    Sets differ by at least the number of bits in which they differ.  Where cells hold little, one count is enough.
    """
    levels = [1 if mean < 1.1 else 2] if mean < 1.5 else range(max(1, round(mean) - 1), max(1, round(mean) - 1) + (2 if mean < 2 else 4))
    return np.concatenate([np.packbits(held >= level, axis=1) for level in levels], axis=1).view(np.uint64)


def possible_pairs(group: dict[str, np.ndarray], asks: np.ndarray, meets: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of a block that their sizes allow, without most of those that their cells rule out.

    In a large block both sides go in order of size, so that sets meet only those of sizes that
    similar sets may have, and all of these are told apart by bits first.
    """
    n, held = group["n"], group["cells"]
    if len(asks) * len(meets) <= FEW:
        x, y = np.nonzero(np.abs(n[asks, None] - n[meets]) * (num + den) <= (n[asks, None] + n[meets]) * (den - num))
        yield asks[x], meets[y]
        return
    asks, meets = asks[np.argsort(n[asks], kind="stable")], meets[np.argsort(n[meets], kind="stable")]
    bits = cell_bits(held, float(n.mean()) / held.shape[1])
    words, sizes = np.ascontiguousarray(bits[meets].T), n[meets]
    step = max(1, PAIRS // len(meets))
    for at in range(0, len(asks), step):
        i = asks[at:at + step]
        lo, hi = np.searchsorted(sizes, -(-n[i[0]] * num // den), "left"), np.searchsorted(sizes, n[i[-1]] * den // num, "right")
        if lo >= hi:
            continue
        apart = np.zeros((len(i), hi - lo), np.uint16)
        for w in range(len(words)):
            apart += np.bitwise_count(bits[i, w, None] ^ words[w, lo:hi])
        x, y = np.nonzero(apart <= ((n[i] + sizes[hi - 1]) * (den - num) // (num + den))[:, None])
        x, y = i[x], meets[lo + y]
        may = np.abs(n[x] - n[y]) * (num + den) <= (n[x] + n[y]) * (den - num)
        yield x[may], y[may]


def close_in_block(group: dict[str, np.ndarray], best: bool, num: int, den: int) -> tuple[np.ndarray, bool]:
    """Close pairs across components in a block, and whether some were left out; side 0 meets side 1, side 2 meets all."""
    node, label, n, held = (group[c] for c in ("node", "label", "n", "cells"))
    out, more = [], False
    for x, y in possible_pairs(group, np.flatnonzero(group["side"] != 1), np.flatnonzero(group["side"] > 0), num, den):
        apart, found = label[x] != label[y], []
        x, y = x[apart], y[apart]
        for at in range(0, len(x), PAIRS):
            u, v = x[at:at + PAIRS], y[at:at + PAIRS]
            least = np.abs(held[u].astype(np.int16) - held[v]).sum(axis=1, dtype=np.int64)
            near = least * (num + den) <= (n[u] + n[v]) * (den - num)
            found.append((u[near], v[near], least[near]))
        if not found:
            continue
        x, y, least = (np.concatenate(c) for c in zip(*found))
        if best and len(x):
            order = np.lexsort((y, least / (n[x] + n[y]), x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            more |= not first.all()
            x, y = x[first], y[first]
        out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), more


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


ROW = "kind byte, key long, sig long, node long, n int, pivot long, pn int, doc_id long, r long, cells binary"
FIELDS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int32()),
                    ("pivot", pa.int64()), ("pn", pa.int32()), ("doc_id", pa.int64()), ("r", pa.int64()), ("cells", pa.binary())])


def _batch(kind, key, sig, node, n, pivot=None, pn=None, doc_id=None, r=None, cells=None) -> pa.RecordBatch:
    size = len(key)
    cols = [np.full(size, kind, np.int8), key, sig, node, n, pivot, pn, doc_id, r, cells]
    return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, FIELDS)],
                                      schema=FIELDS)


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """A staged table, after which shuffle files that no live plan needs are given up.

    Spark deletes them when the driver collects its garbage, which a driver that only waits for jobs
    seldom does; the signatures' files are larger than anything that follows.
    """
    out = write_stage(df, name, partition_by)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than about so many rows are worth, one for each core at least."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / TASK_ROWS)))


def join_components(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links``.

    Words are lower-cased (A to Z), a set holds the distinct runs of ``shingle`` words; a
    text with fewer words is one shingle, one without words is an empty set that links with
    nothing and is its own component.  Two documents link when intersection / union is
    ``num / den`` at least.  ``component_id`` is the smallest doc_id reachable by links.
    ``n_links`` counts the different sets with which a verified comparison linked the
    document's own (comparisons that connectivity makes needless are not made).
    Rows without a doc_id come back with their set size, take no part in links and have no
    component.  Rows that repeat a doc_id each count by their own text.  Other columns of
    ``docs`` are ignored.  An empty table gives an empty one; texts go whole, whatever their
    length.  Sets are told apart by 64-bit hashes.
    """
    return _found(docs, shingle, num, den).drop("r")


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """Bitmap of the shingles that come more than once in the texts of one hash value of ``SHARE``."""
    def counted(batches):
        for part in (part for batch in batches for part in slices(batch, size=SLICE)):
            sets = [grams for _, grams in set_rows(part, shingle)]
            if sets:
                gram, m = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(gram)), pa.array(m)], names=["gram", "m"])

    some = rows.where(F.pmod("r", F.lit(SHARE)) == 0).select("text").mapInArrow(counted, "gram long, m long")
    often = some.groupBy("gram").agg(F.sum("m").alias("m")).where("m > 1")
    # The remainder by a power of two is the same for signed numbers.
    slot = F.col("gram").bitwiseAND(F.lit(COMMON - 1))
    words = (often.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    out = np.zeros(COMMON // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _found(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``join_components`` with ``r``, the hash of a row's text."""
    scheme_args = (num, den)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("r", F.xxhash64("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(rows, shingle) if any(map(Scheme(num, den).prefixed, range(20))) else None)

    def sign(batches):
        scheme, cache, ways, seen, late = Scheme(*scheme_args), {}, {}, set(), common.value
        sigs, nodes, ns, held = [], [], [], 0

        def flush():
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            n = np.concatenate(ns)
            order = np.argsort(sig, kind="stable")
            sig, node, n = sig[order], node[order], n[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            one, rest = np.flatnonzero(first), np.flatnonzero(~first)
            for i in (one[at:at + PIECE] for at in range(0, len(one), PIECE)):
                yield _batch(1, _signed(sig[i]), _signed(sig[i]), node[i], n[i])
            for i in (rest[at:at + PIECE] for at in range(0, len(rest), PIECE)):
                yield _batch(2, _signed(mix(sig[i] + node[i].view(np.uint64))), _signed(sig[i]), node[i], n[i], node[head[i]], n[head[i]])

        for batch in batches:
            for part in slices(batch, size=SLICE):
                sets = [grams for _, grams in set_rows(part, shingle)]
                if not sets:
                    continue
                node, n = np.array([node_of(x) for x in sets], np.int64), np.array([len(x) for x in sets], np.int32)
                bands, firsts = {}, []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    if not n[i] or doc_id is None or node[i] in seen:
                        continue
                    if len(seen) > BUFFER:
                        seen.clear()
                    seen.add(node[i])
                    own = scheme.bands(int(n[i]))
                    for band in own:
                        if band not in ways:
                            ways[band] = late is not None and scheme.prefixed(band)
                        if not ways[band]:
                            bands.setdefault(band, []).append(i)
                    if any(ways[band] for band in own):
                        firsts.append(i)
                if firsts:
                    at = np.split(places(np.concatenate([sets[i] for i in firsts]), late), np.cumsum(n[firsts])[:-1])
                    s = [first_places(x, scheme.prefix(len(x))) for x in at]
                    of = np.repeat(firsts, [len(x) for x in s])
                    sigs.append(mix(np.concatenate(s)))
                    nodes.append(node[of])
                    ns.append(n[of])
                    held += len(of)
                for band, own in bands.items():
                    if band not in cache:
                        cache[band] = scheme.parts(band)
                    s, of = signatures_of(np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), n[own]), len(own), band, cache[band])
                    sigs.append(s)
                    nodes.append(node[own][of])
                    ns.append(n[own][of])
                    held += len(s)
                if held >= BUFFER:
                    yield from flush()
                    sigs, nodes, ns, held = [], [], [], 0
                key = _signed(mix(node.view(np.uint64) + np.arange(len(node), dtype=np.uint64)))
                yield _batch(0, key, None, node, n, doc_id=part.column("doc_id"), r=part.column("r"), cells=[cell_counts(x) for x in sets])
        if held:
            yield from flush()

    def bucket(batches):
        """Rows sorted by kind, sig, node: documents and sets that stay with another pass; others meet their bucket's first set."""
        last, pivot, pn, told = None, 0, 0, False
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (other := kind != 1).any():
                yield batch.filter(pa.array(other))
            if other.all():
                continue
            b = batch.filter(pa.array(~other))
            sig, node, n = (b.column(c).to_numpy() for c in ("sig", "node", "n"))
            first = np.concatenate([[last is None or sig[0] != last], sig[1:] != sig[:-1]])
            head = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            old = np.where(head < 0, pivot, node[np.maximum(head, 0)])
            oldn = np.where(head < 0, pn, n[np.maximum(head, 0)])
            last, pivot, pn = sig[-1], old[-1], oldn[-1]
            rest = ~first & (node != old)
            if rest.any():
                yield _batch(2, _signed(sig[rest]), sig[rest], node[rest], n[rest], old[rest], oldn[rest])

    table = stage(rows.mapInArrow(sign, ROW).repartition("key").sortWithinPartitions("kind", "sig", "node")
                  .mapInArrow(bucket, ROW).drop("key"), "near-rows", partition_by=["kind"])
    doc_nodes = table.where("kind = 0").select("doc_id", "r", "node", "n")
    members = table.where("kind = 2").select("sig", "node", "n", "pivot", "pn")
    size = members.count()
    alike = F.least("n", "pn") * F.lit(den) >= F.greatest("n", "pn") * F.lit(num)
    pairs = members.where(alike).select(F.col("pivot").alias("a"), F.col("node").alias("b"), (F.col("n") + F.col("pn")).alias("both")).distinct()

    # One row per set that shares a bucket: a document that holds it, and its counts.
    wanted = members.select("node").union(members.select(F.col("pivot").alias("node"))).distinct()
    sketches = stage(few(table.where("kind = 0 and doc_id is not null").join(wanted, "node", "left_semi")
                         .groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("cells").alias("cells")), size), "near-sketches")

    def sets_of(batches):
        for part in (part for batch in batches for part in slices(batch, size=SLICE)):
            node, got, fine = [], [], []
            for _, grams in set_rows(part, shingle):
                node.append(node_of(grams))
                got.append(_signed(grams))
                fine.append(cell_counts(grams, FINE) if len(grams) >= LARGE else None)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(got, pa.list_(pa.int64())), pa.array(fine, pa.binary())],
                                             names=["node", "grams", "fine"])

    def verified(candidates: DataFrame) -> DataFrame:
        """Candidates whose whole sets are similar; the sets are made again from the texts of one document each.

        A bitmap of ``SLOTS`` bits names the documents to read, so texts of others are not moved.
        Of pairs of large sets only those that finer cell counts leave are brought together
        whole: ``CELLS`` cells tell large sets apart no better than chance.
        """
        candidates = stage(candidates, "near-candidates")
        # Whole sets are larger than other rows.
        rows_here, sets_here = 2 * (found := candidates.count()), 16 * found
        if not found:
            return candidates
        ends = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct()
        readers = stage(few(sketches.join(ends, "node", "left_semi").select("node", "doc_id"), rows_here), "near-readers")
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
        bits = (readers.select(F.floor(slot / 32).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {SLOTS}) % 32 as int))").alias("bit"))
                .groupBy("word").agg(F.bit_or("bit").alias("bits")))
        texts = (rows.drop("r").withColumn("word", F.floor(slot / 32)).join(F.broadcast(bits), "word")
                 .where(f"(shiftright(bits, cast(pmod(xxhash64(doc_id), {SLOTS}) % 32 as int)) & 1L) = 1").select("text"))
        made = texts.mapInArrow(sets_of, "node long, grams array<long>, fine binary").join(readers, "node", "left_semi").dropDuplicates(["node"])
        made = stage(few(made.select("node", "grams", "fine"), sets_here), "near-sets")
        large = made.where("fine is not null").select("node", F.size("grams").alias("n"), "fine")
        if not large.isEmpty():
            large_a, large_b = (large.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"c{x}")) for x in "ab")
            near = (candidates.join(large_b, "b").join(large_a, "a").select("a", "b", (F.col("na") + F.col("nb")).alias("both"), "ca", "cb")
                    .mapInArrow(lambda batches: close(batches, FINE), "a long, b long"))
            nodes = large.select("node", F.lit(True).alias("large"))
            small = (candidates.join(nodes.withColumnsRenamed({"node": "a", "large": "la"}), "a", "left").join(nodes.withColumnsRenamed({"node": "b", "large": "lb"}), "b", "left")
                     .where("la is null or lb is null").select("a", "b"))
            candidates = stage(few(small.unionByName(near), sets_here), "near-candidates")
        a, b = (made.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        common = F.size(F.array_intersect("ga", "gb"))
        union = F.size("ga") + F.size("gb") - common
        return few(candidates.join(b, "b").join(a, "a").where(common * F.lit(den) >= union * F.lit(num)).select("a", "b"), sets_here)

    def counts(batch, column, size=CELLS):
        return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(-1, size)

    def close(batches, size=CELLS):
        """Pairs whose cell counts differ no more than similar sets of these sizes may."""
        step = (1 << 22) // size
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                apart = np.abs(counts(part, "ca", size).astype(np.int16) - counts(part, "cb", size)).sum(axis=1, dtype=np.int64)
                may = apart * (num + den) <= part.column("both").to_numpy() * (den - num)
                yield part.select(["a", "b"]).filter(pa.array(may))

    cells = sketches.select("node", "cells")
    pairs = few(pairs.join(cells.withColumnsRenamed({"node": "b", "cells": "cb"}), "b")
                .join(cells.withColumnsRenamed({"node": "a", "cells": "ca"}), "a")
                .select("a", "b", "both", "ca", "cb"), size).mapInArrow(close, "a long, b long")
    links = stage(verified(pairs), "near-links")

    def blocks(batches, best):
        """Rows sorted by sig, i, j: a block at a time, cut from the columns where the key changes.

        Rows with ``sig`` name buckets of which only the closest candidates were given.
        """
        names, held = ("sig", "i", "j", "side", "node", "label", "n", "cells"), None

        def done(rows, cuts):
            for a, b in zip(cuts, cuts[1:]):
                found, more = close_in_block({c: rows[c][a:b] for c in names[3:]}, best, num, den)
                if len(found):
                    first = [int(rows["sig"][a]) if more else None] + [None] * (len(found) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(first, pa.int64())], names=["a", "b", "sig"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[:-1]}
            rows["n"] = rows["n"].astype(np.int64)
            rows["cells"] = counts(batch, "cells")
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            new = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names[:3]])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            yield from done(rows, cuts)
            held = {c: rows[c][cuts[-1]:] for c in names}
        if held is not None:
            yield from done(held, [0, len(held["sig"])])

    def across(inside: DataFrame, labels: DataFrame, best: bool) -> DataFrame | None:
        """Candidates between components (``a``, ``b``): the closest of each set in a block, or all; None where no bucket is apart.

        Of buckets of more than two sets (a pair has been compared) that are still apart,
        one of those with the same sets.  Small ones are one block, larger ones go as blocks
        of the sets outside the main component against blocks of all.  Buckets are dealt to
        passes, so that only a part of the rows is on disk with its cells at a time.
        """
        inside = inside.join(labels, "node", "left").select("sig", "node", "n", F.coalesce("label", "node").alias("label"))
        main = (inside.groupBy("sig", "label").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("same"))
                .groupBy("sig").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("m"), F.sum("m").alias("size"),
                                    F.bit_xor("same").alias("same")))
        main = main.where("m < size and size > 2")
        main = main.groupBy("size", "same").agg(F.min_by(F.struct("sig", "main", "m"), "sig").alias("one")).select("size", "one.*")
        inside = inside.join(main, "sig").withColumns({
            "wide": F.ceil(F.col("size") / BLOCK).cast("int"), "tall": F.ceil((F.col("size") - F.col("m")) / BLOCK).cast("int")})
        kept = ["sig", "node", "label", "n"]
        small = inside.where("wide = 1").select(*kept, F.when(F.col("label") == F.col("main"), 1).otherwise(2).alias("side"),
                                                F.lit(0).alias("i"), F.lit(0).alias("j"))
        large = inside.where("wide > 1")
        against = large.select(*kept, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"),
                               F.pmod(F.xxhash64("node"), F.col("wide").cast("long")).cast("int").alias("j"))
        outsiders = large.where("label <> main").select(
            *kept, F.lit(0).alias("side"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("tall").cast("long")).cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
        placed = stage(few(small.unionByName(against, allowMissingColumns=False).unionByName(outsiders), 2 * size), "near-placed")
        if not (count := placed.count()):
            return None
        passes = min(MOST_PASSES, ceil(count / PASS_ROWS))
        met = []
        for p in range(passes):
            part = placed.where(F.pmod(F.xxhash64("sig"), F.lit(passes)) == p)
            part = part.join(cells, "node").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            # A row of a block meets many others.
            met.append(stage(few(part, 8 * count // passes).mapInArrow(lambda batches: blocks(batches, best), "a long, b long, sig long"), "near-met"))
        return reduce(DataFrame.union, met)

    labels = stage(few(components(links, "near-labels"), size), "near-labels")
    inside = stage(few(members.select("sig", "node", "n").union(members.select("sig", "pivot", "pn")).distinct(), 2 * size), "near-inside")
    for best in (True, False):
        met = across(inside, labels, best)
        if met is None:
            break
        more = stage(verified(few(met.select("a", "b").distinct(), 2 * size)), "near-links")
        if not more.isEmpty():
            links = links.union(more)
            known = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
            labels = stage(few(components(known.union(more), "near-labels"), size), "near-labels")
        # Buckets all of whose candidates have been given are done; the others come again for all that are still apart.
        open_ = met.where("sig is not null").select("sig").distinct()
        if not best or open_.isEmpty():
            break
        inside = inside.join(open_, "sig", "left_semi")
    links = links.distinct()

    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    first = doc_nodes.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = first.join(labels, "node", "left").join(degree, "node", "left").select(
        "node", "least", "n_links", F.coalesce("label", "node").alias("label"))
    joined = stage(few(joined, size), "near-nodes")
    root = joined.groupBy("label").agg(F.min("least").alias("root"))
    roots = joined.join(root, "label").select("node", "root", "n_links")
    return doc_nodes.join(roots, "node", "left").select(
        "doc_id", "r", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of ``docs`` without near duplicates: one row of each component stays, with all its columns.

    It is a row with the smallest doc_id; of several texts under that id the one with the
    smallest hash, of equal rows any one.  Rows are told apart by doc_id and text, so a text
    that is like no other stays whatever else stands under its id.  Rows without a doc_id
    and texts without words link with nothing and all stay, repeated or not.  An empty table
    gives an empty one.
    """
    found = stage(_found(docs, shingle, num, den).where("component_id is not null and n_shingles > 0"), "near-found")
    one = (found.groupBy("component_id").agg(F.min(F.struct("doc_id", "r")).alias("one"), F.count("*").alias("m"))
           .where("m > 1").select("component_id", "one"))
    joined = found.join(one, "component_id").select(F.col("doc_id").alias("__d"), F.col("r").alias("__r"), (F.struct("doc_id", "r") == F.col("one")).alias("__first"))
    ends = stage(joined.groupBy("__d", "__r").agg(F.first("__first").alias("__first"), F.count("*").alias("__m")).where("not __first or __m > 1"), "near-ends")
    named = docs.withColumns({"__d": F.col("doc_id").cast("long"), "__r": F.xxhash64(F.col("text").cast("string"))})
    kept = named.join(ends.where("not __first"), ["__d", "__r"], "left_anti")
    again = ends.where("__first").select("__d", "__r")
    if not again.isEmpty():
        kept = kept.join(again, ["__d", "__r"], "left_anti").unionByName(kept.join(again, ["__d", "__r"], "left_semi").dropDuplicates(["__d", "__r"]))
    return kept.select(*docs.columns)
