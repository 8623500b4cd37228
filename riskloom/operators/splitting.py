"""Exact, repeatable splits and samples decided by a hash of the key.

Membership depends on ``md5(seed|key)`` alone: not on partitioning, order or
run.  Exact sizes come from cut points, as for ranks: hashes are counted by
prefix, only the prefixes holding a quota boundary are ordered, and the split
itself is a comparison on each row.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import safe_ratio
from riskloom.operators.ranking import sized_broadcast

SEED = 42
#: Rows of a hash cell that are ordered in one task; hex digits of a hash.
ROWS_PER_CELL, HASH_DIGITS = 500_000, 32
HASH, PREFIX = "__hash", "__prefix"


def key_hash(key: str | Column, seed: int | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_cuts(df: DataFrame, strata: str, key: str, seed: int | str, quotas: Mapping[object, Sequence[int]],
              rows_per_cell: int = ROWS_PER_CELL) -> dict[object, list[str | None]]:
    """Per stratum, the hash of the q-th row in hash order for each cumulative quota ``q``.

    Radix selection: the cells in which the wanted rows fall are counted by their next
    digits, and the search goes on in those that hold them, until a cell has few rows and is
    ordered.  A level is one scan that sends at most 256 counts per wanted row.  Quota 0 gives None.
    """
    kind = df.schema[strata].dataType.simpleString()
    hashed = df.select(F.col(strata).alias("__s"), key_hash(key, seed).alias(HASH))
    found: dict[tuple, str] = {}
    # (stratum, prefix) -> {rows left to go inside that cell: quotas that ask for it}
    cells: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for s, qs in quotas.items():
        for q in qs:
            if q > 0:
                cells[(s, "")][q].append(q)
    small: dict[tuple, dict[int, list[int]]] = {}
    width = 0

    def inside(wanted) -> DataFrame:
        table = df.sparkSession.createDataFrame([(*c, sorted(v)) for c, v in wanted.items()], f"__s {kind}, {PREFIX} string, __at array<bigint>")
        at = hashed.withColumn(PREFIX, F.substring(HASH, 1, len(next(iter(wanted))[1])))
        same = at["__s"].eqNullSafe(table["__s"]) & (at[PREFIX] == table[PREFIX])
        return at.join(sized_broadcast(table, len(wanted)), same).select(at["__s"], HASH, at[PREFIX], "__at")

    while cells:
        width += 2
        rows = hashed if width == 2 else inside(cells)
        counts: dict[tuple, dict[str, int]] = defaultdict(dict)
        for r in rows.groupBy("__s", F.substring(HASH, 1, width).alias("p")).count().collect():
            counts[(r["__s"], r["p"][:width - 2])][r["p"]] = r["count"]
        deeper: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for cell, wanted in cells.items():
            for left, qs in wanted.items():
                for prefix in sorted(counts[cell]):
                    n = counts[cell][prefix]
                    if left <= n:
                        if width == HASH_DIGITS:
                            found.update({(cell[0], q): prefix for q in qs})
                        elif n <= rows_per_cell:
                            small.setdefault((cell[0], prefix), defaultdict(list))[left] += qs
                        else:
                            deeper[(cell[0], prefix)][left] += qs
                        break
                    left -= n
        cells = deeper
    for digits in sorted({len(p) for _, p in small}):
        level = {c: v for c, v in small.items() if len(c[1]) == digits}
        w = Window.partitionBy("__s", PREFIX).orderBy(HASH)
        for r in inside(level).withColumn("__rn", F.row_number().over(w)).where(F.array_contains("__at", F.col("__rn").cast("bigint"))).collect():
            found.update({(r["__s"], q): r[HASH] for q in level[(r["__s"], r[PREFIX])][r["__rn"]]})
    return {s: [found.get((s, q)) for q in qs] for s, qs in quotas.items()}


def proportional_quotas(sizes: Mapping[object, int], take: int) -> dict[object, int]:
    """``take`` rows shared over strata by size: floor, then largest remainder (ties: smaller stratum label first)."""
    total = sum(sizes.values())
    if not total:
        return {s: 0 for s in sizes}
    exact = {s: n * take / total for s, n in sizes.items()}
    out = {s: math.floor(v) for s, v in exact.items()}
    order = sorted(sizes, key=lambda s: (-(exact[s] - out[s]), str(s)))
    for s in order[:take - sum(out.values())]:
        out[s] += 1
    return out


def _strata_sizes(df: DataFrame, strata: str) -> dict[object, int]:
    return {r["__s"]: r["count"] for r in df.groupBy(F.col(strata).alias("__s")).count().collect()}


def split_quotas(sizes: Mapping[object, int], test: float, val: float) -> dict[object, tuple[int, int]]:
    """Test and validation rows per stratum for the two-stage split."""
    n = sum(sizes.values())
    n_test = math.ceil(test * n)
    rest = proportional_quotas(sizes, n - n_test)
    n_rest = n - n_test
    n_val = math.ceil(val / (1 - test) * n_rest)
    train = proportional_quotas(rest, n_rest - n_val)
    return {s: (sizes[s] - rest[s], rest[s] - train[s]) for s in sizes}


def _by_stratum(strata: str, branches: Mapping[object, Column], default: Column) -> Column:
    out = F
    for s, expr in branches.items():
        out = out.when(F.col(strata).eqNullSafe(F.lit(s)), expr)
    return out.otherwise(default) if branches else default


def stratified_split(df: DataFrame, strata: str = "y", key: str = "app_id", test: float = 0.20, val: float = 0.20,
                     seed: int | str = SEED) -> DataFrame:
    """Add ``pile`` = train / val / test with exact sizes and exact class shares."""
    sizes = _strata_sizes(df, strata)
    quotas = split_quotas(sizes, test, val) if sizes else {}
    cuts = hash_cuts(df, strata, key, seed, {s: [t, t + v] for s, (t, v) in quotas.items()})
    h = key_hash(key, seed)
    branches = {}
    for s, (a, b) in cuts.items():
        pick = F
        if a is not None:
            pick = pick.when(h <= a, F.lit("test"))
        if b is not None:
            pick = pick.when(h <= b, F.lit("val"))
        branches[s] = pick.otherwise(F.lit("train")) if pick is not F else F.lit("train")
    return df.withColumn("pile", _by_stratum(strata, branches, F.lit("train")))


def stratified_holdout(df: DataFrame, share: float = 0.15, strata: str = "y", key: str = "app_id",
                       seed: int | str = "stop", flag: str = "held_out") -> DataFrame:
    """Add a boolean for an exact stratified share of the rows (early-stopping set)."""
    sizes = _strata_sizes(df, strata)
    n = sum(sizes.values())
    kept = proportional_quotas(sizes, n - math.ceil(share * n)) if n else {}
    cuts = hash_cuts(df, strata, key, seed, {s: [sizes[s] - kept[s]] for s in sizes})
    h = key_hash(key, seed)
    return df.withColumn(flag, _by_stratum(strata, {s: h <= c[0] for s, c in cuts.items() if c[0] is not None}, F.lit(False)))


def split_summary(df: DataFrame, label: str = "y", pile: str = "pile") -> DataFrame:
    """Rows, share, positives and rate per pile; the grand total is a literal."""
    n = df.count()
    return (df.groupBy(pile)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("defaults"))
            .withColumn("share", F.col("n") / F.lit(float(max(n, 1))))
            .withColumn("rate", safe_ratio(F.col("defaults"), F.col("n"))))


def rate_spread(summary: DataFrame) -> DataFrame:
    return summary.agg(((F.max("rate") - F.min("rate")) * 100).alias("spread_pp"))


def split_integrity(df: DataFrame, key: str = "app_id", pile: str = "pile") -> DataFrame:
    """Rows, distinct keys, keys in several piles, rows without a pile; one row."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min(pile).alias("lo"), F.max(pile).alias("hi"),
                                  F.count_if(F.col(pile).isNull()).alias("none"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("lo") != F.col("hi")).alias("n_overlap"),
        F.coalesce(F.sum("none"), F.lit(0)).cast("bigint").alias("n_unassigned"),
    ).withColumn("ok", (F.col("n_rows") == F.col("n_keys")) & (F.col("n_overlap") == 0) & (F.col("n_unassigned") == 0))


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed: int | str = SEED, salts: int = 32) -> DataFrame:
    """``n`` rows of every group by hash order, sorted by group.

    Two steps, so one huge group is cut over many tasks: first the best ``n``
    of every (group, salt), then the best ``n`` of those.
    """
    h = key_hash(key, seed)
    salted = df.withColumn(HASH, h).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = Window.partitionBy(group, "__salt").orderBy(HASH)
    whole = Window.partitionBy(group).orderBy(HASH)
    return (salted.withColumn("__rn", F.row_number().over(part)).where(F.col("__rn") <= n)
            .withColumn("__rn", F.row_number().over(whole)).where(F.col("__rn") <= n)
            .drop(HASH, "__salt", "__rn").orderBy(group))


def fixed_sample(df: DataFrame, n: int, key: str, seed: int | str = SEED) -> DataFrame:
    """The first ``n`` rows in hash order: those up to the n-th hash, left where they are."""
    total = df.count()
    if total <= n:
        return df
    cut = hash_cuts(df.withColumn("__all", F.lit(0)), "__all", key, seed, {0: [n]})[0][0]
    return df.where(F.lit(False) if cut is None else key_hash(key, seed) <= cut)


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    sizes = _strata_sizes(df, label)
    total, kind = sum(sizes.values()), df.schema[label].dataType.simpleString()
    rows = [(y, n, total / (len(sizes) * n)) for y, n in sizes.items()]
    return df.sparkSession.createDataFrame(rows, f"y {kind}, n_class bigint, weight double")


def with_class_weight(df: DataFrame, label: str = "y", name: str = "weight") -> DataFrame:
    """Add each row's balanced class weight as a literal."""
    weights = {r["y"]: r["weight"] for r in class_weights(df, label).collect()}
    return df.withColumn(name, _by_stratum(label, {k: F.lit(v) for k, v in weights.items()}, F.lit(1.0)))
