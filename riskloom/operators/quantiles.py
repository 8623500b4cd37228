"""Exact interpolated quantiles for columns of any size.

``percentile`` keeps every distinct value of a column in one buffer.  Here quantiles
come from order statistics: ranges of the value axis are counted, and only the ranges
holding a wanted position are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranking import fit_layout
from riskloom.staging import stage


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, NULL and NaN left out; columns without values give None."""
    cols = list(columns)
    if not cols:
        return {}
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where("value is not null and not isnan(value)"))
    long = stage(long, "values")
    counts = dict.fromkeys(cols, 0) | {r["column"]: r["count"] for r in long.groupBy("column").count().collect()}
    layout = fit_layout(long, "value", None, ["column"])
    spots = {c: [p * (n - 1) for p in probs] for c, n in counts.items() if n}
    # ascending position i is descending rank n - i
    ks = {(c,): sorted({counts[c] - f(h) for h in hs for f in (math.floor, math.ceil)}) for c, hs in spots.items()}
    found = {(c, cut.k): cut.score for (c,), cuts in layout.cuts(long, ks).items() for cut in cuts}
    out: dict[str, list[float | None]] = {}
    for c, n in counts.items():
        if not n:
            out[c] = [None] * len(probs)
            continue
        values = []
        for h in spots[c]:
            lo, hi = found[(c, n - math.floor(h))], found[(c, n - math.ceil(h))]
            values.append(lo if lo == hi else (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi)
        out[c] = values
    return out


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5]).items()}
