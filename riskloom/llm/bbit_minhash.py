"""Near duplicates by b-bit MinHash.

A document's set is its distinct word shingles.  ``BANDS`` x ``ROWS`` minima of hash
functions and a few more are taken of every different set.  Band keys are made of the full
minima; of each minimum only the low ``BITS`` bits are kept, packed into 64-bit words.

1. Sets that share a band key are a bucket.  Each is first compared with one set of its
   bucket, the pivot.  Two signatures are compared by exclusive or and bit counts; as
   unequal minima agree in their low bits with probability ``2 ** -BITS``, that share is
   taken out of the agreement, and pairs whose corrected similarity lies ``SURE``
   deviations below the wanted one are dropped.  What is left is confirmed on full sets.
2. Confirmed links join sets to components.  In buckets that hold several components, the
   sets outside the largest one meet all that are in another one, in blocks of bounded
   size.  What the estimate leaves there is held against counts of shingles per hash cell,
   which bound the difference of two sets from below, so pairs that are certainly apart
   never leave their task.  First only the closest candidate of a set is confirmed, which
   joins most of what can be joined, then all that are still apart.  No partner is capped.

A pair at the wanted similarity is missed when no band agrees: (1 - 0.85 ** 5) ** 25, less
than one in two million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.near_join import CELLS, cell_counts, node_of, set_rows
from riskloom.llm.words import mix, slices
from riskloom.staging import stage

BANDS, ROWS, MINIMA, BITS = 25, 5, 128, 2
#: Standard deviations below the wanted similarity at which an estimate drops a pair.
SURE = 6.0
SLICE = 2 << 20
#: Shingles hashed at a time, unless one set has more.
GRAMS = 1 << 16
#: Sets in a block of a bucket; pairs of a set that are confirmed in one task.
BLOCK, SPREAD = 512, 1_000
#: Bits of the bitmap that names the documents whose texts are read again.
SLOTS = 1 << 21

_SEEDS = mix(np.arange(2 * MINIMA, dtype=np.uint64) + np.uint64(0xB5297A4D)).astype(np.uint32)
_TURN, _ODD = _SEEDS[:MINIMA], _SEEDS[MINIMA:] | np.uint32(1)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """``MINIMA`` minima of each of some non-empty sets."""
    out = np.empty((len(sets), MINIMA), np.uint32)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (held == 0 or held + len(sets[end]) <= GRAMS):
            held += len(sets[end])
            end += 1
        grams = (np.concatenate(sets[at:end]) >> np.uint64(16)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:end]])])[:-1]
        for i in range(MINIMA):
            out[at:end, i] = np.minimum.reduceat((grams ^ _TURN[i]) * _ODD[i], starts)
        at = end
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key per band from its full minima."""
    part = least[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), part.shape[:2])
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """Low ``BITS`` bits of each minimum (spread first, so that they depend on all of it), packed into words."""
    low = mix(least.astype(np.uint64) + (np.arange(MINIMA, dtype=np.uint64) << np.uint64(32))) & np.uint64((1 << BITS) - 1)
    each = 64 // BITS
    low = low.reshape(len(least), MINIMA // each, each) << (np.arange(each, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low, axis=2)


_ONES = sum(1 << i for i in range(0, 64, BITS))


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many packed values differ, over the last axis."""
    x = a ^ b
    shift = BITS // 2
    while shift:
        x = x | (x >> np.uint64(shift))
        shift //= 2
    return np.bitwise_count(x & np.uint64(_ONES)).sum(axis=-1, dtype=np.int64)


def _unequal(a: str, b: str) -> Column:
    """The same on two columns of packed words."""
    def word(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        shift = BITS // 2
        while shift:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift //= 2
        return F.bit_count(x.bitwiseAND(F.lit(_ONES - (1 << 64) if _ONES >> 63 else _ONES)))
    return sum((word(i) for i in range(1, MINIMA * BITS // 64)), word(0))


def most_unequal(similarity: float) -> int:
    """Largest number of unequal values at which the corrected similarity is within ``SURE`` deviations of the wanted one."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * similarity
    least = agree - SURE * math.sqrt(agree * (1 - agree) / MINIMA)
    return math.floor(MINIMA * (1 - max(least, 0.0)))


def _pairs_of(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare(group: dict[str, np.ndarray], most: int, num: int, den: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs across components of one block; ``side`` 0 meets 1, 2 meets all."""
    asks, meets = np.flatnonzero(group["side"] != 1), np.flatnonzero(group["side"] != 0)
    bits, label, n, node, cells = (group[c] for c in ("bits", "label", "n", "node", "cells"))
    found = [], []
    step = max(1, (1 << 18) // max(1, len(meets)))
    for at in range(0, len(asks), step):
        i = asks[at:at + step]
        off = unequal(bits[i][:, None, :], bits[meets][None, :, :])
        small, large = np.minimum(n[i][:, None], n[meets]), np.maximum(n[i][:, None], n[meets])
        hit = (off <= most) & (label[i][:, None] != label[meets]) & (small * den >= large * num)
        x, y = np.nonzero(hit)
        near = np.empty(len(x), bool)
        for p in range(0, len(x), 1 << 15):
            u, v = i[x[p:p + (1 << 15)]], meets[y[p:p + (1 << 15)]]
            apart = np.abs(cells[u] - cells[v]).sum(axis=1, dtype=np.int64)
            near[p:p + (1 << 15)] = apart * (num + den) <= (n[u] + n[v]) * (den - num)
        x, y = x[near], y[near]
        if best and len(x):
            order = np.lexsort((off[x, y], x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[first], y[first]
        found[0].append(node[i[x]])
        found[1].append(node[meets[y]])
    a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
    return np.minimum(a, b), np.maximum(a, b)


def _blocks(batches: Iterator[pa.RecordBatch], most: int, num: int, den: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j), a block at a time; of a block only its own rows are held."""
    cols = ("key", "i", "j", "side", "node", "label", "n", "bits", "cells")
    held: dict[str, np.ndarray] | None = None

    def closed(rows, cuts):
        for a, b in zip(cuts, cuts[1:]):
            x, y = _compare({c: rows[c][a:b] for c in cols[3:]}, most, num, den, best)
            if len(x):
                pairs = np.unique(np.stack([x, y], axis=1), axis=0)
                yield _pairs_of(pairs[:, 0], pairs[:, 1])

    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in cols[:-2]}
        rows["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        rows["cells"] = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, CELLS).astype(np.int16)
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in cols}
        new = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])) + 1
        cuts = [0, *new.tolist()]
        yield from closed(rows, cuts)
        held = {c: rows[c][cuts[-1]:] for c in cols}
    if held is not None and len(held["key"]):
        yield from closed(held, [0, len(held["key"])])


class _Sets:
    """The different sets of a corpus and what is known of them."""

    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int):
        self.shingle, self.num, self.den, self.most = shingle, num, den, most_unequal(num / den)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, size=SLICE):
                    sets = [s for _, s in set_rows(part, shingle)]
                    full = [i for i, s in enumerate(sets) if len(s)]
                    least = minima([sets[i] for i in full])
                    keys, bits = [None] * len(sets), [None] * len(sets)
                    for i, k, w in zip(full, band_keys(least).view(np.int64), pack(least).view(np.int64)):
                        keys[i], bits[i] = k, w
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                         pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                         pa.array([cell_counts(s) for s in sets], pa.binary())], names=["doc_id", "node", "n", "keys", "bits", "cells"])

        self.docs = stage(self.texts.mapInArrow(sign, "doc_id long, node long, n int, keys array<long>, bits array<long>, cells binary"), "bbit-docs")
        self.sets = stage(self.docs.where("doc_id is not null and n > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"),
            F.first("cells").alias("cells")), "bbit-sets")
        rows = self.sets.select("node", F.explode("keys").alias("key"))
        shared = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("m")).where("m > 1").select("key", "pivot")
        self.members = stage(rows.join(shared, "key"), "bbit-members")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimated similarity does not rule them out."""
        def side(x: str) -> DataFrame:
            return self.sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
        both = spread_join(pairs.join(side("b"), "b"), side("a"))
        sizes = F.least("na", "nb") * F.lit(self.den) >= F.greatest("na", "nb") * F.lit(self.num)
        return both.where(sizes & (_unequal("bitsa", "bitsb") <= self.most)).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar.  The sets are made again from the text of one document each."""
        pairs = stage(pairs, "bbit-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        readers = stage(self.sets.join(ends, "node", "left_semi").select("node", "doc_id"), "bbit-readers")
        # A bitmap of fixed size keeps the texts of most other documents where they are.
        slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
        word, bit = F.shiftright(slot, 5), F.expr("shiftleft(1L, cast(slot & 31 as int))")
        marks = readers.select(slot.alias("slot")).select(F.shiftright("slot", 5).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
        texts = (self.texts.withColumn("slot", slot).withColumn("word", word).join(F.broadcast(marks), "word")
                 .where(F.col("marks").bitwiseAND(bit) != 0).select("text"))
        shingle = self.shingle

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, size=SLICE):
                    sets = [s for _, s in set_rows(part, shingle)]
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                                     names=["node", "grams"])

        made = texts.mapInArrow(again, "node long, grams array<long>").join(readers.select("node"), "node", "left_semi").dropDuplicates(["node"])
        made = stage(made, "bbit-full")
        a, b = (made.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
        common = F.size(F.array_intersect("ga", "gb"))
        union = F.size("ga") + F.size("gb") - common
        return spread_join(pairs.join(b, "b"), a).where(common * F.lit(self.den) >= union * F.lit(self.num)).select("a", "b")

    def across(self, labels: DataFrame, best: bool) -> DataFrame:
        """Candidates between components, from buckets of three sets and more; of buckets with equal members one is taken.

        A bucket of up to ``BLOCK`` sets is one block; of larger ones blocks of the sets
        outside the largest component meet blocks of all.
        """
        inside = self.members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        parts = inside.groupBy("key", "label").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("same"))
        apart = (parts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("size"),
                                          F.bit_xor("same").alias("same")).where("most < size and size > 2")
                 .groupBy("size", "same").agg(F.min_by(F.struct("key", "main", "most"), "key").alias("one")).select("size", "one.*"))
        rows = inside.join(apart, "key").withColumns({"wide": F.ceil(F.col("size") / BLOCK).cast("int"),
                                                      "tall": F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int"), "outside": F.col("label") != F.col("main")})
        kept = ["key", "node", "label"]
        small = rows.where("wide = 1").select(*kept, F.when(F.col("outside"), 2).otherwise(1).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"))
        large = rows.where("wide > 1")
        spot = lambda salt, parts: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts).cast("long")).cast("int")
        meets = large.select(*kept, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"), spot(0, "wide").alias("j"))
        asks = large.where("outside").select(*kept, F.lit(0).alias("side"), spot(1, "tall").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
        placed = small.unionByName(meets).unionByName(asks).join(self.sets.select("node", "n", "bits", "cells"), "node")
        most, num, den = self.most, self.num, self.den
        return (placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                .mapInArrow(lambda batches: _blocks(batches, most, num, den, best), "a long, b long").distinct())


def spread_join(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Join on ``a``; a set that stands in many pairs is dealt to a task for every ``SPREAD`` of them."""
    pairs = stage(pairs, "bbit-half")
    busy = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts")).where("parts > 1")
    left = pairs.join(busy, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")
    right = side.join(busy, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, ["a", "part"])


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``n_links``.

    Words are lower-cased (A to Z); a set holds the distinct runs of ``shingle`` words, a
    text with fewer words is one shingle.  A null, empty or blank text has an empty set,
    links with nothing and is its own component.  Two documents link when intersection /
    union is ``num / den`` at least.  ``component_id`` is the smallest doc_id reachable by
    links, ``kept`` says that it is the row's own.  ``n_links`` counts the different sets
    with which a confirmed pair linked the row's own (pairs that connectivity makes needless
    are not confirmed).  Rows that repeat a doc_id each count by their own text.  Rows
    without a doc_id link with nothing, have no component and are kept.  Texts of any length
    go whole.  An empty table gives an empty one; other columns are ignored.  Sets are told
    apart by 64-bit hashes.
    """
    sets = _Sets(docs, shingle, num, den)
    first = sets.members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(sets.confirmed(sets.similar(first)), "bbit-links")
    labels = stage(components(links, "bbit-labels"), "bbit-labels")
    for best in (True, False):
        more = stage(sets.confirmed(sets.across(labels, best)), "bbit-links")
        links = links.union(more)
        known = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = stage(components(known.union(more), "bbit-labels"), "bbit-labels")
    degree = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = stage(sets.sets.select("node", "doc_id").join(labels, "node", "left").join(degree, "node", "left").select(
        "node", "doc_id", "n_links", F.coalesce("label", "node").alias("label")), "bbit-nodes")
    least = nodes.groupBy("label").agg(F.min("doc_id").alias("root"))
    roots = nodes.join(least, "label").select("node", "root", "n_links")
    own = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return sets.docs.select("doc_id", "node", "n").join(roots, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
