"""Correlations from sums of pairs against the definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import profile


def _found(df, names):
    return {(r["left_column"], r["right_column"]): r["correlation"] for r in profile.correlations(df, names).collect()}


def test_many_columns_with_gaps(spark):
    """200 columns, a tenth of the values missing, large values with a small spread."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 200))
    base[:, 1::2] += base[:, ::2]
    base[:, 7] = 1e9 + base[:, 7]
    gaps = rng.random(base.shape) < 0.1
    names = [f"c{i}" for i in range(200)]
    rows = [[None if g else float(v) for v, g in zip(*both, strict=True)] for both in zip(base, gaps, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = _found(df, names)
    assert len(got) == 200 * 199 // 2
    for i, j in [(0, 1), (6, 7), (7, 8), (3, 150), (198, 199)]:
        both = ~gaps[:, i] & ~gaps[:, j]
        want = np.corrcoef(base[both, i] - base[both, i].mean(), base[both, j] - base[both, j].mean())[0, 1]
        assert got[names[i], names[j]] == pytest.approx(want, abs=1e-6)


def test_pairs_without_a_correlation(spark):
    rows = [
        (1.0, 0.1, None, 1.0, 5, 1.0), (2.0, 0.1, None, float("nan"), 7, 4.0), (4.0, 0.1, 3.0, 2.0, 11, 2.0),
        (None, 0.1, None, float("inf"), 2, 3.0)]
    df = spark.createDataFrame(rows, "x double, same double, once double, nan double, `n n` int, y double")
    got = _found(df, ["x", "same", "once", "nan", "n n", "y"])
    assert got["x", "same"] is None and got["x", "once"] is None
    assert got["once", "nan"] is None and math.isnan(got["x", "nan"])
    for pair in [("x", "n n"), ("x", "y"), ("n n", "y")]:
        assert got[pair] == pytest.approx(df.select(F.corr(*[f"`{c}`" for c in pair])).first()[0])


def test_odd_values_spoil_shared_rows_only(spark):
    rows = [(1.0, None), (2.0, 3.0), (float("nan"), None), (5.0, 4.0), (float("inf"), None)]
    got = _found(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    assert got == {("x", "y"): pytest.approx(1.0)}


def test_empty_tables_and_single_columns(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert _found(df, ["x", "y"]) == {("x", "y"): None}
    assert _found(df, ["x"]) == {}
