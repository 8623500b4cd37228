"""Bootstrap intervals, nearest neighbours and synthetic minority rows."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.verdicts import zero_band
from riskloom.operators.evaluation import POS, with_classes
from riskloom.operators.ranking import RANGE, SLOT, fit_layout, global_rank, sized_broadcast
from riskloom.operators.splitting import SEED, key_hash
from riskloom.staging import stage

REPLICATES = 1000
POINT = -1
NEIGHBOURS = 5
BOOT_ROWS_PER_RANGE = 100_000
ROWS_PER_CELL = 4_000
CHUNK = 2_000
ROWS_PER_SALT = 100_000
TABLES, LEAF = 24, 64

# Poisson(1) distribution function, 0 .. 17 events.
_POISSON_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def poisson_weights(keys: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """Poisson(1) counts for replicates ``first`` .. ``last - 1`` from a hash of (seed, key, replicate)."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        h = h + (np.arange(first, last, dtype=np.uint64) + np.uint64(1) + np.uint64(seed) * np.uint64(1 << 20))[None, :] \
            * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(_POISSON_CDF, u, side="right").astype(np.float64)


def bootstrap_gini(df: DataFrame, scores: Sequence[str], replicates: int = REPLICATES, seed: int = SEED,
                   label: str = "y", key: str = "app_id", point: bool = False,
                   rows_per_range: int = BOOT_ROWS_PER_RANGE) -> DataFrame:
    """Gini per score and replicate: ``(model, replicate, gini)``.

    Resampling changes weights, not order.  Every range of the score axis is
    tallied once for all replicates (positive weight, negative weight,
    concordant weight inside), and the tallies are combined: no row is copied per
    replicate.  Weights hash the key, so all scores see the same resample.
    Replicates without both classes are left out.  With ``point`` the same pass also
    tallies the rows as they are, as replicate ``POINT``.
    """
    long = with_classes(df.select(key, F.col(label).alias("y"), *scores)
                        .unpivot([key, "y"], list(scores), "model", "p"), "y").drop("y")
    layout = fit_layout(long, "p", key, ["model"], rows_per_range=rows_per_range)
    hot = set(layout.hot)

    def tally(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model, rng, slot = group
        pdf = pdf.sort_values("p", kind="stable")
        pos = pdf[POS].to_numpy(float)
        keys, p = pdf[key].to_numpy(), pdf["p"].to_numpy()
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        step = max(1, 2_000_000 // max(len(pdf), 1))

        def tallied(first: int, last: int, w: np.ndarray) -> pd.DataFrame:
            wp = np.add.reduceat(w * pos[:, None], starts, axis=0)
            wn = np.add.reduceat(w * (1 - pos)[:, None], starts, axis=0)
            below = np.cumsum(wn, axis=0) - wn
            return pd.DataFrame({
                "model": model, RANGE: rng, "replicate": np.arange(first, last), "wp": wp.sum(axis=0), "wn": wn.sum(axis=0),
                "conc": (wp * (below + wn / 2)).sum(axis=0)})
        parts = [tallied(POINT, 0, np.ones((len(pdf), 1)))] if point else []
        for b0 in range(0, replicates, step):
            b1 = min(b0 + step, replicates)
            parts.append(tallied(b0, b1, poisson_weights(keys, b0, b1, seed)))
        return pd.concat(parts)

    tallies = (layout.slotted(long).select("model", RANGE, SLOT, key, POS, "p")
               .groupBy("model", RANGE, SLOT)
               .applyInPandas(tally, f"model string, {RANGE} int, replicate int, wp double, wn double, conc double"))
    ranges = tallies.groupBy("model", RANGE, "replicate").agg(
        F.sum("wp").alias("wp"), F.sum("wn").alias("wn"), F.sum("conc").alias("conc"))
    if hot:  # one score spread over several slots: all its pairs are ties
        ranges = ranges.withColumn("conc", F.when(F.col(RANGE).isin(list(hot)), F.col("wp") * F.col("wn") / 2)
                                   .otherwise(F.col("conc")))
    w = Window.partitionBy("model", "replicate").orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("conc", F.col("conc") + F.col("wp") * F.coalesce(F.sum("wn").over(w), F.lit(0.0)))
    sums = ranges.groupBy("model", "replicate").agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn"), F.sum("conc").alias("conc"))
    return (sums.where("wp > 0 and wn > 0")
            .select("model", "replicate", (2 * F.col("conc") / (F.col("wp") * F.col("wn")) - 1).alias("gini")))


def interval(replicates: DataFrame, value: str, by: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of a replicate table."""
    q = F.percentile(value, F.array(F.lit(low), F.lit(high)))
    return (replicates.groupBy(*by).agg(F.count(F.lit(1)).alias("n_replicates"), q.alias("q"))
            .select(*by, "n_replicates", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


def paired_difference(replicates: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Challenger minus champion per replicate, in the shape of a replicate table."""
    def value(m: str):
        return F.max(F.when(F.col("model") == m, F.col("gini")))
    return (replicates.groupBy("replicate").agg((value(challenger) - value(champion)).alias("gini"))
            .where("gini is not null")
            .select(F.lit(f"{challenger} - {champion}").alias("model"), "replicate", "gini"))


def bootstrap_ci(df: DataFrame, champion: str = "p", challenger: str = "p2", replicates: int = REPLICATES,
                 seed: int = SEED, label: str = "y", key: str = "app_id") -> DataFrame:
    """Point Gini and 95% interval of two scores and of their paired difference."""
    boot = stage(bootstrap_gini(df, [champion, challenger], replicates, seed, label, key, point=True), "replicates")
    both = boot.unionByName(paired_difference(boot, champion, challenger))
    points = both.where(F.col("replicate") == POINT).select("model", "gini")
    ci = interval(both.where(F.col("replicate") != POINT), "gini", ["model"])
    return (points.join(ci, "model")
            .withColumn("half_width", (F.col("high") - F.col("low")) / 2)
            .withColumn("verdict", F.when(F.col("model").contains(" - "), zero_band("low"))))


# -- nearest neighbours ---------------------------------------------------


def _pivots(df: DataFrame, by: str, key: str, vec: str, cells: dict) -> dict[object, np.ndarray]:
    """The first rows of every group in hash order, one per cell."""
    w = Window.partitionBy(by).orderBy("__h")
    rows = (df.select(by, vec, key_hash(key, "pivot").alias("__h"))
            .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(cells.values(), default=0))
            .orderBy(by, "__rn").collect())
    found: dict[object, list] = {}
    for r in rows:
        if r["__rn"] <= cells[r[by]]:
            found.setdefault(r[by], []).append(r[vec])
    return {g: np.array(v, dtype=float) for g, v in found.items()}


def _nearest_pivot(pivots, by: str):
    """Add the cell (nearest pivot of the group) and the distance to it; ``pivots`` is a broadcast."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby(by):
                x, p = np.stack(part["vec"]).astype(float), pivots.value[g]
                cell, dist = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
                for i in range(len(p)):
                    d = np.sqrt(((x - p[i]) ** 2).sum(axis=1))
                    near = d < dist
                    cell[near], dist[near] = i, d[near]
                yield part.assign(cell=cell.astype(np.int32), d=dist)
    return run


def _other_cells(pivots, radii, by: str):
    """Rows once for each other cell that may hold a neighbour; ``pivots`` is a broadcast.

    ``theta`` is a distance within which a row has all the neighbours it asks for.  By the
    triangle inequality a row of cell j is at least |r p_j| - radius_j away from row r; and as
    no pivot is nearer to it than p_j, it lies beyond the plane between p_j and r's own pivot.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby(by):
                x, p, theta, cell = np.stack(part["vec"]).astype(float), pivots.value[g], part["theta"].to_numpy(float), part["cell"].to_numpy()
                near = ((x - p[cell]) ** 2).sum(axis=1)
                for j in range(len(p)):
                    if (g, j) not in radii:
                        continue
                    far, between = ((x - p[j]) ** 2).sum(axis=1), np.sqrt(((p[cell] - p[j]) ** 2).sum(axis=1))
                    plane = np.divide(far - near, 2 * between, out=np.zeros(len(x)), where=between > 0)
                    slack = 1e-9 * (far + near) / np.where(between > 0, between, 1.0)
                    least = np.maximum(np.sqrt(far) - radii[(g, j)], plane - slack)
                    ask = (cell != j) & ~(least * (1 - 1e-9) - 1e-8 > theta)
                    if ask.any():
                        yield part.loc[ask, [by, "copy", "vec"]].assign(target=np.int32(j))
    return run


def _closest(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and distance of the ``k`` nearest rows for each row of ``a``; equal distances by id.

    The matrix product only preselects; distances are taken again from the differences.
    """
    fast = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T
    slack = 1e-9 * ((a ** 2).sum(1).max() + (b ** 2).sum(1).max() + 1.0)
    kth = np.partition(fast, k - 1, axis=1)[:, k - 1:k] if len(b) >= k else np.inf
    r, c = np.nonzero(fast <= kth + slack)
    d = np.round(np.sqrt(((b[c] - a[r]) ** 2).sum(axis=1)), 9)
    order = np.lexsort((ids[c], d, r))
    r, c, d = r[order], c[order], d[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return r[place < k], c[place < k], d[place < k]


def _local_neighbours(k: int, by: str, vectors: bool):
    """Nearest candidates of every point of one chunk in one chunk of candidates."""
    cols = [by, "copy", "nn_id", "distance", *(["nn_vec"] if vectors else [])]

    def run(group: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in cols})
        a, b = np.stack(left["vec"]).astype(float), np.stack(right["vec"]).astype(float)
        ids = right["id"].to_numpy()
        r, c, d = _closest(a, b, ids, k)
        out = pd.DataFrame({by: group[0], "copy": left["copy"].to_numpy()[r], "nn_id": ids[c], "distance": d})
        return out.assign(nn_vec=list(b[c])) if vectors else out
    return run


def _points(df: DataFrame, k: int, key: str, vec: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the name of their vector, and of every set of copies the k+1 lowest ids, numbered."""
    v = F.col(vec).cast("array<double>")
    rows = stage(df.select(by, F.col(key).cast("bigint").alias("id"), v.alias("vec"),
                           F.unhex(F.substring(F.sha2(F.array_join(v, ","), 256), 1, 32)).alias("copy")), "points")
    w = Window.partitionBy(by, "copy").orderBy("id")
    return rows, stage(rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1), "distinct-points")


def _for_rows(rows: DataFrame, local: DataFrame, k: int, key: str, by: str, vectors: bool, rows_per_salt: int) -> DataFrame:
    """The nearest of all candidates for each vector, given to every row that has it.

    A vector with more than ``rows_per_salt`` copies gets its list once per so many of them.
    """
    near = F.struct("distance", "nn_id", *(["nn_vec"] if vectors else []))
    lists = (local.groupBy(by, "copy", "nn_id").agg(F.min(near).alias("near"))
             .groupBy(by, "copy").agg(F.slice(F.sort_array(F.collect_list("near")), 1, k + 1).alias("near")))
    many = rows.groupBy(by, "copy").agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("salts")).where("salts > 1")
    lists = lists.join(many, [by, "copy"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    own = rows.select(by, "id", "copy").join(many, [by, "copy"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int")).drop("salts")
    others = F.slice(F.filter("near", lambda t: t["nn_id"] != F.col("id")), 1, k)
    return (own.join(lists, [by, "copy", "salt"]).withColumn("near", others)
            .select(by, F.col("id").alias(key), F.posexplode("near").alias("i", "t"))
            .select(by, key, (F.col("i") + 1).alias("nn_rank"), F.col("t.nn_id").alias("nn_id"),
                    F.col("t.distance").alias("distance"), *([F.col("t.nn_vec").alias("nn_vec")] if vectors else [])))


def nearest_neighbours(df: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vec: str = "embedding",
                       by: str = "label", rows_per_cell: int = ROWS_PER_CELL, chunk: int = CHUNK,
                       rows_per_salt: int = ROWS_PER_SALT, vectors: bool = False) -> DataFrame:
    """Exact k nearest other rows within each ``by`` group (few groups): ``(by, key, nn_rank, nn_id, distance)``.

    Copies first: rows with the same vector have the same neighbours, and of one
    set of copies only the k+1 lowest ids can ever be somebody's neighbours.  So
    one point per distinct vector asks, and at most k+1 per distinct vector answer,
    however often a vector occurs.

    Then a partition-based kNN join: points go to the cell of their nearest pivot and
    look for neighbours there.  With the distance of the last one found, a point asks
    only those other cells that the triangle inequality cannot rule out.  Cells are cut
    into chunks on both sides, so a dense cell becomes many bounded tasks.  Equal
    distances are ordered by id.

    With many dimensions the triangle inequality rules out little and all pairs of a group
    are looked at; ``hashed_neighbours`` is the operator for large groups.
    """
    spark = df.sparkSession
    kind = df.schema[by].dataType.simpleString()
    rows, points = _points(df, k, key, vec, by)
    sizes = {r[by]: r["count"] for r in points.where("nth = 1").groupBy(by).count().collect()}
    cells = {g: max(1, math.ceil(n / rows_per_cell)) for g, n in sizes.items()}
    pivots = _pivots(points.where("nth = 1"), by, "id", "vec", cells)
    shape = f"`{by}` {kind}, id bigint, vec array<double>, copy binary, nth int, cell int, d double"
    shared = spark.sparkContext.broadcast(pivots)
    placed = stage(points.mapInPandas(_nearest_pivot(shared, by), shape), "cells")

    extent = placed.groupBy(by, "cell").agg(F.max("d").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    radii = {(r[by], r["cell"]): r["radius"] for r in extent}

    def chunk_no(n: str):
        return F.pmod(F.xxhash64("id" if n == "rparts" else "copy"), F.col(n)).cast("int")

    def spread(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def nearest_of(asking: DataFrame, name: str) -> DataFrame:
        """The nearest rows of cell ``target`` for each row that asks it, in bounded chunks on both sides."""
        asked = asking.groupBy(by, "target").agg(F.count(F.lit(1)).alias("n")).collect()
        own = {(r[by], r["cell"]): r["n"] for r in extent}
        parts = sized_broadcast(spark.createDataFrame(
            [(r[by], r["target"], max(1, math.ceil(r["n"] / chunk)), max(1, math.ceil(own[(r[by], r["target"])] / chunk))) for r in asked],
            f"`{by}` {kind}, target int, lparts int, rparts int"), len(asked))
        left = asking.join(parts, [by, "target"]).select(by, "target", "copy", "vec", chunk_no("lparts").alias("lc"), spread("rparts").alias("rc"))
        right = placed.withColumnRenamed("cell", "target").join(parts, [by, "target"]).select(
            *[F.col(c).alias(c) for c in (by, "target", "id", "vec")],  # new attribute ids for the self cogroup
            chunk_no("rparts").alias("rc"), spread("lparts").alias("lc"))
        groups = [by, "target", "lc", "rc"]
        return stage(left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(
            _local_neighbours(k + 1, by, vectors),
            f"`{by}` {kind}, copy binary, nn_id bigint, distance double" + (", nn_vec array<double>" if vectors else "")), name)

    first = placed.where("nth = 1").select(by, F.col("cell").alias("target"), "copy", "vec")
    local = nearest_of(first, "own-neighbours")
    if len(extent) > len(sizes):
        # How far a row's own cell has as many rows as it asks for; without so many it asks every cell.
        theta = local.groupBy(by, "copy").agg(F.sort_array(F.collect_list("distance")).alias("far")).select(
            by, "copy", F.coalesce(F.get("far", F.lit(k)), F.lit(math.inf)).alias("theta"))
        wide = placed.where("nth = 1").select(by, "cell", "copy", "vec").join(theta, [by, "copy"])
        more = wide.mapInPandas(_other_cells(shared, radii, by), f"`{by}` {kind}, copy binary, vec array<double>, target int")
        local = local.unionByName(nearest_of(stage(more, "asking"), "other-neighbours"))
    return _for_rows(rows, local, k, key, by, vectors, rows_per_salt)


# -- nearest neighbours from hash tables ------------------------------------


def _projections(table: int, levels: range, dims: int, seed: int | str) -> np.ndarray:
    """One random direction per level of a table, the same in every task."""
    return np.stack([np.random.default_rng([zlib.crc32(str(seed).encode()), table, level]).normal(size=dims) for level in levels], axis=1)


def hash_tables(points: DataFrame, by: str, tables: int, leaf: int, seed: int | str = SEED, levels: int = 8) -> DataFrame:
    """``points`` (``by``, ``id``, ``vec``, ..) once per table with the ``bucket`` they are in there.

    All points of a group start in one bucket.  Every level splits the buckets of more than
    ``leaf`` points along a random direction of its own, at the mean of their projections,
    an aggregate that is combined before it is shuffled.  Buckets go on splitting until they
    are small or nothing splits them (equal vectors).  Points of small buckets are done: only
    the others are written again, with the projections of the levels to come.
    """
    first = points.select(by, "id", "vec").where(F.col("vec").isNotNull() & F.col("id").isNotNull() & F.col(by).isNotNull())
    kind, keys = points.schema[by].dataType.simpleString(), [by, "id", "table"]
    start = {"bucket": F.lit(0).cast("bigint"), "open": F.lit(True)}
    # Points that share an id stand for each other, as often as they do; others need no join for that.
    alone = first.groupBy(by, "id").count().where(F.col("count") > 1).isEmpty()
    left = None if alone else first.select(by, "id", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("table")).withColumns(start)
    level, before, done = 0, None, []
    while True:
        steps = range(level, level + levels)

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            made = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["vec"])
                if x.shape[1] not in made:
                    made[x.shape[1]] = [_projections(t, steps, x.shape[1], seed) for t in range(tables)]
                for t, directions in enumerate(made[x.shape[1]]):
                    yield pdf[[by, "id"]].assign(table=t, p=list(np.round(x @ directions, 9)))
        projected = first.mapInPandas(project, f"`{by}` {kind}, id bigint, table int, p array<double>")
        codes = projected.withColumns(start) if left is None else left.join(projected, keys)
        for i in range(levels):
            here = F.get("p", F.lit(0))
            large = (codes.groupBy(by, "table", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(here).alias("at"))
                     .where(F.col("n") > leaf).drop("n"))
            side = F.when(F.col("at").isNotNull(), F.xxhash64("bucket", F.lit(level + i), here > F.col("at"))).otherwise(F.col("bucket"))
            codes = stage(codes.join(large, [by, "table", "bucket"], "left").select(
                *keys, side.alias("bucket"), F.col("at").isNotNull().alias("open"), F.slice("p", 2, levels).alias("p")), "hash-codes")
            done.append(codes.where("not open").select(*keys, "bucket"))
            codes = codes.where("open")
            if codes.isEmpty():
                break
        left = codes.drop("p")
        sizes = left.groupBy(by, "table", "bucket").count().where(F.col("count") > leaf)
        found = sizes.agg(F.count(F.lit(1)).alias("buckets"), F.sum("count").alias("points")).first()
        if not found["buckets"] or (found["buckets"], found["points"]) == before:
            return reduce(DataFrame.union, done, left.select(*keys, "bucket")).join(points, [by, "id"])
        level, before = level + levels, (found["buckets"], found["points"])


def hashed_neighbours(df: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id", vec: str = "embedding", by: str = "label",
                      tables: int = TABLES, leaf: int = LEAF, seed: int | str = SEED, rows_per_salt: int = ROWS_PER_SALT,
                      vectors: bool = False) -> DataFrame:
    """The k nearest other rows of those that share a bucket of a hash table; output as ``nearest_neighbours``.

    Work and shuffle grow with rows x tables, not with the square of a group.  How many of the
    true neighbours are found depends on the data: more tables and larger leaves find more,
    ``neighbour_recall`` measures it.
    """
    rows, points = _points(df, k, key, vec, by)
    placed = hash_tables(points, by, tables, leaf, seed)
    kind = df.schema[by].dataType.simpleString()
    cols = [by, "copy", "nn_id", "distance", *(["nn_vec"] if vectors else [])]

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by bucket, one bucket at a time; buckets that did not split go in chunks."""
        held = None
        for pdf in itertools.chain(batches, [None]):
            rows_ = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows_ is None or not len(rows_):
                continue
            code = pd.factorize(pd.MultiIndex.from_frame(rows_[[by, "table", "bucket"]]))[0]
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]
            if pdf is None:
                cuts.append(len(rows_))
            x, ids, copies, asks = np.stack(rows_["vec"]).astype(float), rows_["id"].to_numpy(), rows_["copy"].to_numpy(), rows_["nth"].to_numpy() == 1
            groups = rows_[by].to_numpy()
            out = [[], [], [], [], []]
            for a, b in zip(cuts, cuts[1:]):
                mine = a + np.flatnonzero(asks[a:b])
                for at in range(0, len(mine), CHUNK):
                    for to in range(a, b, CHUNK):
                        part = mine[at:at + CHUNK]
                        r, c, d = _closest(x[part], x[to:min(b, to + CHUNK)], ids[to:min(b, to + CHUNK)], k + 1)
                        for o, v in zip(out, (groups[part[r]], copies[part[r]], ids[to + c], d, to + c)):
                            o.append(v)
            if out[0]:
                g, copy, nn, d, spot = (np.concatenate(o) for o in out)
                found = pd.DataFrame({by: g, "copy": copy, "nn_id": nn, "distance": d})
                yield (found.assign(nn_vec=list(x[spot])) if vectors else found)[cols]
            held = None if pdf is None else rows_.iloc[cuts[-1]:]

    # Vectors of floats go as they came.
    single = isinstance(df.schema[vec].dataType.elementType, T.FloatType)
    sent = F.col("vec").cast("array<float>" if single else "array<double>").alias("vec")
    keyed = placed.select(by, "table", "bucket", "id", sent, "copy", "nth").repartition(by, "table", "bucket")
    local = keyed.sortWithinPartitions(by, "table", "bucket").mapInPandas(
        buckets, f"`{by}` {kind}, copy binary, nn_id bigint, distance double" + (", nn_vec array<double>" if vectors else ""))
    return _for_rows(rows, local, k, key, by, vectors, rows_per_salt)


def neighbour_recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", by: str = "label") -> DataFrame:
    """``n_exact`` true neighbours, ``n_found`` of them found, ``recall``; one row."""
    have = found.select(by, key, "nn_id", F.lit(1).alias("hit"))
    return (exact.select(by, key, "nn_id").join(have, [by, key, "nn_id"], "left")
            .agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
            .withColumn("recall", F.try_divide(F.col("n_found"), F.col("n_exact"))))


def synthetic_minority(minority: DataFrame, n_new: int, k: int = NEIGHBOURS, seed: int | str = SEED,
                       key: str = "app_id", vec: str = "x", neighbours=nearest_neighbours) -> DataFrame:
    """``n_new`` rows on the segments between minority rows and their neighbours.

    ``neighbours`` finds them: exactly, or ``hashed_neighbours`` for a large minority.

    Output: ``(synthetic_id, base_id, nn_id, gap, x)``.  Base row, neighbour and
    position on the segment are hashes of (seed, number of the new row), so the
    draw spreads evenly over the base rows.
    """
    spark = minority.sparkSession
    rows = stage(minority.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("x")), "minority")
    n = rows.count()
    if n < 2:
        raise ValueError("interpolation needs at least two minority rows")
    k = min(k, n - 1)
    nn = neighbours(rows.withColumn("g", F.lit(0)), k, "id", "x", "g", vectors=True).select(
        F.col("id").alias("base_id"), "nn_rank", "nn_id", F.col("nn_vec").alias("nx"))
    index = (global_rank(rows.select("id", F.col("id").cast("double").alias("s")), "s", "id")
             .select(F.col("id").alias("base_id"), (F.col("rank") - 1).alias("idx")))
    edges = (nn.join(index, "base_id")
             .join(rows.select(F.col("id").alias("base_id"), F.col("x").alias("bx")), "base_id"))

    def draw(tag: str):
        return F.xxhash64(F.lit(f"{seed}|{tag}"), F.col("synthetic_id"))
    draws = spark.range(n_new).withColumnRenamed("id", "synthetic_id").select(
        "synthetic_id",
        F.pmod(draw("base"), F.lit(n)).cast("bigint").alias("idx"),
        (F.pmod(draw("nn"), F.lit(k)) + 1).cast("int").alias("nn_rank"),
        (F.pmod(draw("gap"), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias("gap"))
    return draws.join(edges, ["idx", "nn_rank"]).select(
        "synthetic_id", "base_id", "nn_id", "gap",
        F.zip_with("bx", "nx", lambda a, b: a + F.col("gap") * (b - a)).alias("x"))


def oversample(vectors: DataFrame, k: int = NEIGHBOURS, seed: int | str = SEED, label: str = "y", key: str = "app_id",
               vec: str = "x", neighbours=nearest_neighbours) -> DataFrame:
    """Prepared training rows plus synthetic minority rows until both classes are equal.

    Input and output: ``(y, x)`` with ``x`` an array; to be used inside a fit only.
    """
    counts = {r[label]: r["count"] for r in vectors.groupBy(label).count().collect()}
    minor = min(counts, key=lambda c: counts[c])
    missing = max(counts.values()) - counts[minor]
    new = synthetic_minority(vectors.where(F.col(label) == minor), missing, k, seed, key, vec, neighbours)
    kind = vectors.schema[label].dataType
    return vectors.select(label, vec).unionByName(new.select(F.lit(minor).cast(kind).alias(label), F.col("x").alias(vec)))
