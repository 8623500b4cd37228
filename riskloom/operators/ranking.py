"""Exact global order without a global sort.

A window without ``partitionBy`` moves every row to one task.  Here the score
axis is cut into ranges by literal edges, rows are ordered inside their range
only, and the exact totals of the ranges above are added as offsets:

1. edges come from ``approxQuantile``; their accuracy moves balance, never results;
2. a score that fills several ranges on its own gets a range of its own, cut
   further by key into slots, so mass ties spread over tasks too;
3. totals per slot are one map-side combined aggregate.

Many questions need no row order at all.  "Is this row in the top k?" is a
comparison with the k-th row (the *cut*), and finding a cut means ordering the
one range it falls in.  ``Layout.cuts`` does that, so flags, deciles and capacity
curves leave the rows where they are.

Total order: score descending, key ascending, NULL and NaN scores last.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_RANGES = 64
SKETCH_RANGES = 1024
MAX_RANGES = 65_536
ROWS_PER_RANGE = 1_000_000
BROADCAST_ROWS = 200_000
SAMPLES_PER_RANGE = 32
BELOW_ONE = 1.0 - 2.0 ** -20

RANGE, SLOT = "__range", "__slot"


def known_score(score: str) -> Column:
    """The score with NaN as NULL: both are unknown and stand last."""
    return F.when(~F.isnan(F.col(score).cast("double")), F.col(score))


def sized_broadcast(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a driver-made table of known size; a larger one is joined by shuffle."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


@dataclass(frozen=True)
class Cut:
    """The k-th row of a group in rank order; ``k`` = 0 selects nothing."""

    k: int
    score: float | None
    key: int | None


@dataclass(frozen=True)
class Layout:
    """Ranges of the score axis with their exact totals."""

    score: str
    key: str | None
    by: tuple[str, ...]
    splits: tuple[float, ...]
    slots: tuple[float, ...]
    hot: tuple[int, ...]
    key_span: tuple[float, float] = (0.0, 1.0)
    measures: tuple[str, ...] = ()
    totals: list[dict] = field(default_factory=list, repr=False)

    # -- placing rows ---------------------------------------------------

    def range_table(self, spark, name: str, types: Mapping[str, str]) -> DataFrame:
        """``(by.., range, after_<name>)``: sum of a measure over all lower-scored ranges."""
        sums: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for t in self.totals:
            sums[t["by"]][t["range"]] += t[name]
        data = []
        for group, per_range in sums.items():
            acc = 0
            for rng in sorted(per_range, reverse=True):
                data.append((*group, rng, float(acc)))
                acc += per_range[rng]
        schema = ", ".join([*[f"`{b}` {types[b]}" for b in self.by], f"{RANGE} int", f"after_{name} double"])
        return sized_broadcast(spark.createDataFrame(data, schema), len(data))

    def slotted(self, df: DataFrame) -> DataFrame:
        """Add the range and slot of each row; smaller slot = higher score."""
        n_ranges = len(self.splits) - 1
        s = F.col(self.score).cast("double") + F.lit(0.0)  # one zero, not two
        placed = Bucketizer(splits=list(self.splits), inputCol="__score", outputCol="__bin",
                            handleInvalid="keep").transform(df.withColumn("__score", s))
        s = F.col("__score")
        place = F.when(s.isNull() | F.isnan(s), n_ranges).otherwise(n_ranges - 1 - F.col("__bin").cast("int"))
        # never NULL, and said so: joins on it then need no extra filter
        placed = placed.withColumn(RANGE, F.coalesce(place.cast("int"), F.lit(n_ranges)))
        spot = F.col(RANGE).cast("double")
        if self.slots:
            low, width = self.key_span
            inside = F.least((F.col(self.key).cast("double") - F.lit(low)) / F.lit(width), F.lit(BELOW_ONE))
            spot = spot + F.when(F.col(RANGE).isin(list(self.hot)), inside).otherwise(0.0)
            placed = Bucketizer(splits=list(self.slots), inputCol="__spot", outputCol="__slot_no",
                                handleInvalid="keep").transform(placed.withColumn("__spot", spot))
            number = F.coalesce(F.col("__slot_no").cast("bigint"), F.lit(len(self.slots)).cast("bigint"))
            return placed.withColumn(SLOT, number).drop("__score", "__bin", "__spot", "__slot_no")
        return placed.withColumn(SLOT, F.col(RANGE).cast("bigint")).drop("__score", "__bin")

    def group_sizes(self) -> dict[tuple, dict]:
        """Row count and measure sums per ``by`` group."""
        out: dict[tuple, dict] = {}
        for t in self.totals:
            g = out.setdefault(t["by"], defaultdict(int))
            for name in ("n", *self.measures):
                g[name] += t[name]
        return out

    def offsets(self) -> list[dict]:
        """Totals with the sums of all slots before them (``before_*``) inside the group."""
        running: dict[tuple, dict] = {}
        out = []
        for t in sorted(self.totals, key=lambda r: r["slot"]):
            acc = running.setdefault(t["by"], defaultdict(int))
            row = dict(t)
            for name in ("n", *self.measures):
                row[f"before_{name}"] = acc[name]
                acc[name] += t[name]
            out.append(row)
        return out

    def with_offsets(self, slotted: DataFrame, names: Sequence[str] = ("n",)) -> DataFrame:
        """Join the offsets of each slot: at most ranges x key splits rows per group."""
        rows = self.offsets()
        spark = slotted.sparkSession
        types = {f.name: f.dataType.simpleString() for f in slotted.schema.fields}
        cols = [*self.by, SLOT, *[f"before_{n}" for n in names]]
        kinds = [*[types[b] for b in self.by], "bigint",
                 *["bigint" if all(isinstance(r[f"before_{n}"], int) for r in rows) else "double" for n in names]]
        data = [(*r["by"], r["slot"], *[r[f"before_{n}"] for n in names]) for r in rows]
        table = spark.createDataFrame(data, ", ".join(f"`{c}` {k}" for c, k in zip(cols, kinds)))
        return slotted.join(sized_broadcast(table, len(data)), [*self.by, SLOT])

    # -- order inside slots ---------------------------------------------

    def window(self) -> Window:
        order = [F.desc_nulls_last(known_score(self.score))] + ([F.asc(self.key)] if self.key else [])
        return Window.partitionBy(*self.by, SLOT).orderBy(*order)

    def ranked(self, df: DataFrame, cumulative: Mapping[str, str] | None = None) -> DataFrame:
        """Add ``rank`` and running sums ``{new column: measure}`` down the list."""
        cumulative = cumulative or {}
        w = self.window()
        out = self.with_offsets(self.slotted(df), ["n", *cumulative.values()])
        new = {"rank": F.row_number().over(w).cast("bigint") + F.col("before_n")}
        running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, measure in cumulative.items():
            new[name] = F.sum(measure).over(running) + F.col(f"before_{measure}")
        return out.withColumns(new).drop(RANGE, SLOT, "before_n", *[f"before_{m}" for m in cumulative.values()])

    def cuts(self, df: DataFrame, ks: Mapping[tuple, Sequence[int]]) -> dict[tuple, list[Cut]]:
        """The k-th row for every asked ``k`` of every group.

        Only rows of the slots holding a cut are shuffled and ordered.
        """
        wanted: dict[tuple, set[int]] = defaultdict(set)
        place: dict[tuple, tuple] = {}
        known: dict[tuple, float] = {}
        slots = defaultdict(list)
        for r in self.offsets():
            slots[r["by"]].append(r)
        for group, values in ks.items():
            rows = slots[group]
            starts = [r["before_n"] for r in rows]
            for k in values:
                if k <= 0:
                    continue
                r = rows[int(np.searchsorted(starts, k, side="left")) - 1]
                if k > r["before_n"] + r["n"]:
                    raise ValueError(f"cut {k} lies beyond the {r['before_n'] + r['n']} rows of group {group}")
                if self.key is None and r["range"] in self.hot:
                    known[(*group, k)] = self.range_floor(r["range"])
                    continue
                local = k - r["before_n"]
                wanted[(*group, r["slot"])].add(local)
                place[(*group, k)] = (*group, r["slot"], local)
        found: dict[tuple, tuple] = {}
        if wanted:
            spark = df.sparkSession
            slotted = self.slotted(df)
            types = {f.name: f.dataType.simpleString() for f in slotted.schema.fields}
            cols = [*self.by, SLOT]
            schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", __at array<bigint>"
            targets = spark.createDataFrame([(*g, sorted(v)) for g, v in wanted.items()], schema)
            keep = [self.score] + ([self.key] if self.key else [])
            rows = (slotted.select(*cols, *keep).join(sized_broadcast(targets, len(wanted)), cols)
                    .withColumn("__rn", F.row_number().over(self.window()).cast("bigint"))
                    .where(F.array_contains("__at", F.col("__rn"))).collect())
            for r in rows:
                edge = r[self.score] if r[self.score] == r[self.score] else None
                found[(*[r[b] for b in self.by], r[SLOT], r["__rn"])] = (edge, r[self.key] if self.key else None)
        out: dict[tuple, list[Cut]] = {}
        for group, values in ks.items():
            out[group] = []
            for k in values:
                if k <= 0:
                    row = (None, None)
                elif (*group, k) in known:
                    row = (known[(*group, k)], None)
                else:
                    row = found[place[(*group, k)]]
                out[group].append(Cut(k, *row))
        return out

    def range_floor(self, rng: int) -> float:
        """Lowest score of a range; for a heavy score this is the score itself."""
        return self.splits[len(self.splits) - 2 - rng]

    # -- cuts as columns ------------------------------------------------

    def above(self, cut: Cut) -> Column:
        """True for the first ``cut.k`` rows."""
        if cut.k <= 0:
            return F.lit(False)
        if cut.score is None:
            return known_score(self.score).isNotNull() | (F.col(self.key) <= F.lit(cut.key))
        s, edge = known_score(self.score), F.lit(cut.score)
        return F.coalesce((s > edge) | ((s == edge) & (F.col(self.key) <= F.lit(cut.key))), F.lit(False))

    def above_by(self, cuts: Mapping[tuple, Sequence[Cut]], i: int) -> Column:
        """``above`` for the i-th cut, picked by the row's group."""
        if not self.by:
            return self.above(cuts[()][i])
        out = F
        for group, values in cuts.items():
            cond = None
            for b, v in zip(self.by, group):
                test = F.col(b).eqNullSafe(F.lit(v))
                cond = test if cond is None else cond & test
            out = out.when(cond, self.above(values[i]))
        return out.otherwise(F.lit(False))


def _edges(known: DataFrame, n: int, n_ranges: int) -> list[float]:
    """Approximate quantiles of the score, used to balance the ranges and for nothing else.

    Up to about a thousand ranges a quantile sketch serves; beyond, its size per
    task grows too far and the order of a small random sample takes over.
    """
    if n_ranges <= SKETCH_RANGES:
        return known.approxQuantile("s", [i / n_ranges for i in range(1, n_ranges)], 1.0 / (4 * n_ranges))
    share = min(1.0, n_ranges * SAMPLES_PER_RANGE / n)
    found = np.sort(known.sample(share, 7).toArrow().column(0).to_numpy())
    at = (np.arange(1, n_ranges) * len(found)) // n_ranges
    return list(found[at]) if len(found) else []


def _key_slots(df: DataFrame, score: str, key: str, heavy: Mapping[float, int], place: Mapping[float, int],
               n_ranges: int) -> tuple[list[float], tuple[float, float]]:
    """Slot edges when some ranges are cut further by key.

    A slot position is the range number plus, in a heavy range, the key scaled to
    [0, 1).  A score that fills c ranges' worth of rows gets c slots.
    """
    parts = max(heavy.values())
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    k = F.col(key).cast("double")
    rows = (df.select(F.col(score).cast("double").alias("s"), k.alias("k")).where(F.col("s").isin(list(heavy)))
            .groupBy("s").agg(F.percentile_approx("k", steps, max(10_000, 4 * parts)).alias("q"),
                              F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    low, high = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    width = high - low + 1.0
    edges = {float(i) for i in range(n_ranges + 1)}
    for r in rows:
        count = heavy[r["s"] + 0.0]
        picks = {r["q"][(i * parts) // count - 1] for i in range(1, count)}
        edges |= {place[r["s"] + 0.0] + min((q - low) / width, BELOW_ONE) for q in picks}
    return [*sorted(edges), math.inf], (low, width)


def fit_layout(df: DataFrame, score: str = "p", key: str | None = "app_id", by: Sequence[str] = (),
               measures: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
               min_ranges: int = MIN_RANGES) -> Layout:
    """Choose the ranges of ``score`` and count what falls into them.

    ``by`` columns (few groups: models, piles) share the ranges but have their
    own ranks.  ``measures`` are numeric columns to total.  ``key`` must be an
    integral unique id; without it ties stay unordered.
    """
    n = df.count()
    n_ranges = int(min(max(min_ranges, math.ceil(n / rows_per_range)), MAX_RANGES))
    known = df.select(F.col(score).cast("double").alias("s")).where("s is not null and not isnan(s)")
    counts: dict[float, int] = defaultdict(int)
    for e in _edges(known, n, n_ranges):
        counts[float(e) + 0.0] += 1
    heavy = {e: c for e, c in counts.items() if c >= 3 and not math.isinf(e)}
    inner = {e for e in counts if not math.isinf(e)} | {float(np.nextafter(e, np.inf)) for e in heavy}
    splits = [-math.inf, *sorted(inner), math.inf] if inner else [-math.inf, 0.0, math.inf]
    place = {e: len(splits) - 2 - splits.index(e) for e in heavy}
    slots: list[float] = []
    span = (0.0, 1.0)
    if heavy and key:
        slots, span = _key_slots(df, score, key, heavy, place, len(splits) - 1)
    layout = Layout(score, key, tuple(by), tuple(splits), tuple(slots), tuple(place.values()), span, tuple(measures))
    rows = (layout.slotted(df).groupBy(*by, SLOT, RANGE)
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]).collect())
    layout.totals.extend({"by": tuple(r[b] for b in by), "slot": r[SLOT], "range": r[RANGE], "n": r["n"],
                          **{m: r[m] if r[m] is not None else 0 for m in measures}} for r in rows)
    return layout


def half_even_k(n: int, share: float) -> int:
    """Rows in the top ``share`` of ``n``: nearest integer, halves to even."""
    return int(round(n * share))


def global_rank(df: DataFrame, score: str = "p", key: str = "app_id", by: Sequence[str] = ()) -> DataFrame:
    """Exact descending rank of every row, 1 = highest score."""
    return fit_layout(df, score, key, by).ranked(df)


def capacity_cuts(df: DataFrame, layout: Layout, shares: Sequence[float]) -> dict[tuple, list[Cut]]:
    ks = {g: [half_even_k(t["n"], s) for s in shares] for g, t in layout.group_sizes().items()}
    return layout.cuts(df, ks)


def topk_flag(df: DataFrame, share: float, score: str = "p", key: str = "app_id", by: Sequence[str] = (),
              flag: str = "reviewed") -> DataFrame:
    """Add a boolean for the riskiest ``share`` of the rows; no row is moved."""
    layout = fit_layout(df, score, key, by)
    cuts = capacity_cuts(df, layout, [share])
    return df.withColumn(flag, layout.above_by(cuts, 0))


def cumulative_shares(df: DataFrame, score: str = "p", key: str = "app_id", label: str = "y") -> DataFrame:
    """Rank plus the share of positives and of negatives met so far."""
    marked = df.withColumn("__pos", F.col(label).cast("bigint")).withColumn("__neg", 1 - F.col("__pos"))
    layout = fit_layout(marked, score, key, measures=["__pos", "__neg"])
    size = layout.group_sizes().get((), {"__pos": 0, "__neg": 0})
    ranked = layout.ranked(marked, {"cum_pos": "__pos", "cum_neg": "__neg"})
    return (ranked.withColumn("share_pos", F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(size["__pos"]))))
            .withColumn("share_neg", F.try_divide(F.col("cum_neg").cast("double"), F.lit(float(size["__neg"]))))
            .drop("__pos", "__neg"))


def equal_parts(n: int, parts: int) -> list[int]:
    """Last rank of each of ``parts`` near-equal runs; the first ``n % parts`` get one extra."""
    size, extra = divmod(n, parts)
    return [size * i + min(i, extra) for i in range(1, parts + 1)]


def with_decile(df: DataFrame, score: str = "p", key: str = "app_id", by: Sequence[str] = (), parts: int = 10,
                name: str = "decile") -> DataFrame:
    """Add the decile of each row, 1 = riskiest, from the nine inner cuts."""
    layout = fit_layout(df, score, key, by)
    ks = {g: equal_parts(t["n"], parts)[:-1] for g, t in layout.group_sizes().items()}
    cuts = layout.cuts(df, ks)
    place = F.lit(1)
    for i in range(parts - 1):
        place = place + (~layout.above_by(cuts, i)).cast("int")
    return df.withColumn(name, place)


def first_in_rank(df: DataFrame, cases: Sequence[tuple[str, Column]], score: str = "p", key: str = "app_id",
                  columns: Sequence[str] = (), last: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Highest-ranked row meeting each condition (``cases``) and lowest-ranked (``last``); one aggregate."""
    cols = list(dict.fromkeys([key, score, *columns]))
    row = F.struct(*cols)
    order = F.struct(F.col(score), -F.col(key))
    picks, labels = [], []
    for i, (name, cond) in enumerate(cases):
        picks.append(F.max_by(row, F.when(cond, order)).alias(f"c{i}"))
        labels.append(name)
    for i, (name, cond) in enumerate(last, start=len(cases)):
        picks.append(F.min_by(row, F.when(cond, order)).alias(f"c{i}"))
        labels.append(name)
    rows = F.array(*[F.struct(F.lit(n).alias("pick"), F.col(f"c{i}").alias("r")) for i, n in enumerate(labels)])
    return (df.agg(*picks).select(F.inline(rows)).where("r is not null")
            .select("pick", *[F.col("r")[c].alias(c) for c in cols]))


def average_rank(df: DataFrame, score: str, key: str = "app_id", name: str = "avg_rank") -> DataFrame:
    """Add the descending rank with ties sharing their mean rank.

    Inside a slot the peers of a row are a window frame; a score spread over
    several slots has its mean rank from the totals.
    """
    layout = fit_layout(df, score, key)
    out = layout.with_offsets(layout.slotted(df))
    w = Window.partitionBy(SLOT).orderBy(F.desc_nulls_last(score))
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    place = F.col("before_n") + F.rank().over(w) + (peers - 1) / 2.0
    if layout.hot:
        hot = set(layout.hot)
        first, size = {}, defaultdict(int)
        for r in layout.offsets():
            if r["range"] in hot:
                first.setdefault(r["range"], r["before_n"])
                size[r["range"]] += r["n"]
        shared = df.sparkSession.createDataFrame(
            [(rng, start + (size[rng] + 1) / 2.0) for rng, start in first.items()], f"{RANGE} int, __tied double")
        out = out.join(sized_broadcast(shared, len(first)), RANGE, "left")
        place = F.coalesce(F.col("__tied"), place)
        return out.withColumn(name, place).drop(RANGE, SLOT, "before_n", "__tied")
    return out.withColumn(name, place).drop(RANGE, SLOT, "before_n")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows by an expression; each task keeps ``n``."""
    return df.orderBy(*order).limit(n)
