"""Conditional, banding, text and math expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (Spark orders NaN above all numbers)."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def outside(col: str, rule: Mapping[str, float]) -> Column:
    """True where the value breaks a ``{"min": a, "max": b}`` rule; bounds themselves pass, NULL is False."""
    c = F.col(col)
    tests = []
    if "min" in rule:
        tests.append(c < F.lit(rule["min"]))
    if "max" in rule:
        tests.append(c > F.lit(rule["max"]))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def fill_text(col: Column | str, value: str = "Unknown") -> Column:
    return F.coalesce(as_col(col), F.lit(value))


def regroup(col: Column | str, groups: Mapping[str, Sequence[str]], other: str,
            missing: str = "not stated") -> Column:
    """Map listed values to their group, NULL to ``missing``, the rest to ``other``."""
    c = as_col(col)
    out = F.when(c.isNull(), F.lit(missing))
    for label, members in groups.items():
        out = out.when(c.isin(list(members)), F.lit(label))
    return out.otherwise(F.lit(other))


def band(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands ``(e0,e1] (e1,e2] ...``; the lowest edge is included, values outside give NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per pair of edges")
    c = as_col(col)
    out = F.when(c < F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        fits = c.isNotNull() if math.isinf(upper) else c <= F.lit(upper)
        out = out.when(fits, F.lit(label))
    return out


def safe_ratio(num: Column, den: Column) -> Column:
    """Double ratio, NULL where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sigmoid(margin: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(margin)))


def half_even(col: Column | str) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.bround(as_col(col), 0).cast("bigint")


def readable_name(col: Column | str, text_prefixes: Sequence[str]) -> Column:
    """Encoded feature name for display: drop ``block__``; text features get spaces for underscores."""
    base = F.regexp_replace(as_col(col), "^.*?__", "")
    first = F.element_at(F.split(base, "_"), 1)
    return F.when(F.contains(base, F.lit("_")) & first.isin(list(text_prefixes)),
                  F.replace(base, F.lit("_"), F.lit(" "))).otherwise(base)


def first_sentence(col: Column | str) -> Column:
    return F.element_at(F.split(as_col(col), "\\."), 1)


def clip_text(col: Column | str, width: int) -> Column:
    return F.substring(as_col(col), 1, width)
