import numpy as np
import pandas as pd
import pytest

from riskloom.operators import stability


def reference_psi(e, a, bins=10):
    e, a = e[~np.isnan(e)], a[~np.isnan(a)]
    edges = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    which = lambda x: np.searchsorted(edges[1:-1], x, side="right")
    pe = np.maximum(np.bincount(which(e), minlength=len(edges) - 1) / len(e), 1e-6)
    pa = np.maximum(np.bincount(which(a), minlength=len(edges) - 1) / len(a), 1e-6)
    return float(((pa - pe) * np.log(pa / pe)).sum())


def test_psi_numeric(spark):
    rng = np.random.default_rng(1)
    n = 3000
    pdf = pd.DataFrame({"even": rng.random(n) < 0.5, "a": rng.normal(size=n), "b": rng.integers(0, 4, n).astype(float),
                        "c": np.ones(n), "d": np.where(rng.random(n) < 0.3, np.nan, rng.random(n))})
    pdf.loc[~pdf["even"], "a"] += 0.4
    df = spark.createDataFrame(pdf)
    from riskloom.functions.scalars import nan_to_null
    got = {r["feature"]: r["psi"] for r in stability.psi_numeric(nan_to_null(df), list("abcd"), side="even").collect()}
    for c in "abcd":
        want = reference_psi(pdf.loc[pdf["even"], c].to_numpy(), pdf.loc[~pdf["even"], c].to_numpy())
        assert got[c] == pytest.approx(want, abs=1e-12)
    assert got["c"] == 0.0


def test_psi_without_values_is_null(spark):
    df = spark.createDataFrame([(True, None), (True, None), (False, 1.0)], "even boolean, x double")
    assert stability.psi_numeric(df, ["x"], side="even").first()["psi"] is None


def test_psi_categorical_floor(spark):
    df = spark.createDataFrame([(True, "a"), (True, "a"), (False, "a"), (False, "b"), (False, None)], "even boolean, x string")
    e, a = np.array([1, 1e-6]), np.array([0.5, 0.5])
    want = ((a - e) * np.log(a / e)).sum()
    assert stability.psi_categorical(df, ["x"], "even").first()["psi"] == pytest.approx(want)


def test_report_order_and_bands(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", None), ("c", 0.1), ("d", 0.01)], "feature string, psi double")
    assert [(r["feature"], r["band"]) for r in stability.psi_report(df, 3).collect()] == [
        ("a", "significant"), ("c", "moderate"), ("d", "stable")]
    assert tuple(stability.psi_summary(df).first()) == (3, 2)


def test_unseen_skips_absent_columns_and_nulls(spark):
    ref = spark.createDataFrame([("a", "x"), ("b", None)], "s string, only_ref string")
    new = spark.createDataFrame([("a", 1), ("z", 2), ("z", 3), (None, 4)], "s string, n int")
    assert [tuple(r) for r in stability.unseen_categories(ref, new, ["s", "only_ref", "other"]).collect()] == [("s", "z", 2)]
    assert stability.unseen_categories(ref, new, ["other"]).count() == 0
