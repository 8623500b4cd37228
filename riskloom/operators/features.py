"""Feature preparation fitted on the training pile and applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalars import fill_text
from riskloom.operators.quantiles import exact_medians


@dataclass(frozen=True)
class Preparation:
    """Constants learned from training rows only."""

    numeric: tuple[str, ...]
    flags: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    categories: dict[str, tuple[str, ...]]
    unknown: str = "Unknown"

    @property
    def names(self) -> list[str]:
        """Encoded column names, in vector order."""
        onehot = [f"{c}_{v}" for c in self.categorical for v in self.categories[c][1:]]
        return [*self.numeric, *self.flags, *onehot]

    def encoded(self) -> list[Column]:
        """One expression per name: scaled numerics, flags as they are, one-hot without the first category."""
        out = [(F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - F.lit(self.means[c])) / F.lit(self.scales[c])
               for c in self.numeric]
        out += [F.col(f).cast("double") for f in self.flags]
        out += [(fill_text(F.col(c).cast("string"), self.unknown) == v).cast("double")
                for c in self.categorical for v in self.categories[c][1:]]
        return out

    def matrix(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Encoded columns by name, next to the kept ones."""
        return df.select(*keep, *[e.alias(n) for e, n in zip(self.encoded(), self.names)])

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), name: str = "features") -> DataFrame:
        """Encoded columns as one vector column."""
        cols = [f"__f{i}" for i in range(len(self.names))]
        wide = df.select(*keep, *[e.alias(c) for e, c in zip(self.encoded(), cols)])
        return VectorAssembler(inputCols=cols, outputCol=name, handleInvalid="error").transform(wide).select(*keep, name)

    def table(self, spark: SparkSession) -> DataFrame:
        """Constants as rows, the form in which they are saved."""
        rows = [(i, c, "numeric", self.medians[c], self.means[c], self.scales[c], None) for i, c in enumerate(self.numeric)]
        rows += [(i, f, "flag", None, None, None, None) for i, f in enumerate(self.flags)]
        rows += [(i, c, "text", None, None, None, list(self.categories[c])) for i, c in enumerate(self.categorical)]
        return spark.createDataFrame(
            rows, "position int, column string, kind string, median double, mean double, scale double, "
                  "categories array<string>")

    def save(self, spark: SparkSession, path: str) -> None:
        table = self.table(spark)
        fill = spark.createDataFrame([(0, self.unknown, "unknown", None, None, None, None)], table.schema)
        table.unionByName(fill).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["position"])
        pick = {k: [r for r in rows if r["kind"] == k] for k in ("numeric", "flag", "text", "unknown")}
        num = pick["numeric"]
        return cls(tuple(r["column"] for r in num), tuple(r["column"] for r in pick["flag"]),
                   tuple(r["column"] for r in pick["text"]),
                   {r["column"]: r["median"] for r in num}, {r["column"]: r["mean"] for r in num},
                   {r["column"]: r["scale"] for r in num}, {r["column"]: tuple(r["categories"]) for r in pick["text"]},
                   pick["unknown"][0]["column"])


def column_roles(features: Sequence[str], categorical: Sequence[str], flagged: Sequence[str]) -> dict[str, list[str]]:
    """Numeric = features that are not text; flags are named after their column."""
    return {"numeric": [c for c in features if c not in categorical],
            "flags": [f"{c}_missing" for c in flagged],
            "categorical": [c for c in categorical if c in features]}


def fit_preparation(train: DataFrame, numeric: Sequence[str], flags: Sequence[str] = (),
                    categorical: Sequence[str] = (), unknown: str = "Unknown") -> Preparation:
    """Learn medians, means, population spreads and categories.

    A column without any value has no median and is left out.  A constant
    column keeps scale 1.  Categories are sorted text.
    """
    medians = {c: v for c, v in exact_medians(train, numeric).items() if v is not None}
    kept = [c for c in numeric if c in medians]
    means, scales = {}, {}
    if kept:
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in kept}
        row = train.agg(*[F.avg(filled[c]).alias(f"a{i}") for i, c in enumerate(kept)],
                        *[F.stddev_pop(filled[c]).alias(f"s{i}") for i, c in enumerate(kept)]).first()
        means = {c: row[f"a{i}"] for i, c in enumerate(kept)}
        scales = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(kept)}
    return Preparation(tuple(kept), tuple(flags), tuple(categorical), medians, means, scales,
                       _categories(train, categorical, unknown), unknown)


def _categories(train: DataFrame, categorical: Sequence[str], unknown: str) -> dict[str, tuple[str, ...]]:
    if not categorical:
        return {}
    long = (train.select(*[fill_text(F.col(c).cast("string"), unknown).alias(c) for c in categorical])
            .unpivot([], list(categorical), "column", "value").distinct())
    out: dict[str, list[str]] = {c: [] for c in categorical}
    for r in long.toLocalIterator():
        out[r["column"]].append(r["value"])
    return {c: tuple(sorted(v)) for c, v in out.items()}
