"""Cox regression against a direct row-by-row likelihood."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.operators import cox


def efron(rows, beta):
    """Log partial likelihood, straight from its definition."""
    t = np.array([r[0] for r in rows])
    e = np.array([r[1] for r in rows])
    x = np.array([r[2:] for r in rows], dtype=float)
    eta = x @ beta
    w = np.exp(eta)
    total = 0.0
    for time in sorted(set(t[e == 1])):
        dead = (t == time) & (e == 1)
        d = dead.sum()
        total += eta[dead].sum()
        for k in range(d):
            total -= np.log(w[t >= time].sum() - k / d * w[dead].sum())
    return total


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x1, x2 = rng.normal(size=200), rng.integers(0, 2, 200)
    t = np.ceil(rng.exponential(8 * np.exp(-0.7 * x1 + 0.4 * x2))) + 1
    e = (rng.random(200) < 0.7).astype(int)
    return [(float(a), int(b), float(c), float(d)) for a, b, c, d in zip(t, e, x1, x2)]


@pytest.fixture(scope="module")
def fit(spark, rows):
    df = spark.createDataFrame(rows, "_t double, _event int, x1 double, x2 double")
    return cox.fit_cox(df.withColumn("flat", F.lit(1.0)), ["x1", "x2", "flat"])


def test_covariate_without_variance_is_dropped(fit):
    assert fit.converged
    assert fit.names == ["x1", "x2"]


def test_maximum_of_the_direct_likelihood(fit, rows):
    best = efron(rows, fit.coefficients)
    for step in ([1e-3, 0], [0, 1e-3]):
        assert best > efron(rows, fit.coefficients + step)
        assert best > efron(rows, fit.coefficients - step)


def test_covariance_is_the_inverse_curvature(fit, rows):
    h, b = 1e-3, fit.coefficients
    unit = np.eye(2) * h
    curvature = np.array([
        [
            (efron(rows, b + u + v) - efron(rows, b + u - v) - efron(rows, b - u + v) + efron(rows, b - u - v))
            / (4 * h * h)
            for v in unit
        ]
        for u in unit
    ])
    assert fit.covariance == pytest.approx(np.linalg.inv(-curvature), rel=1e-3)


def test_ties_are_summed_in_blocks(monkeypatch):
    whole = cox._tie_sums(5000.0, 800.0, 900)
    monkeypatch.setattr(cox, "TIE_BLOCK", 7)
    assert cox._tie_sums(5000.0, 800.0, 900) == pytest.approx(whole, rel=1e-12)


def test_separated_groups_do_not_count_as_converged(spark, monkeypatch):
    rows = [(float(t), 1, float(t < 6)) for t in range(1, 11)]
    df = spark.createDataFrame(rows, "_t double, _event int, x double")
    monkeypatch.setattr(cox, "MAX_STEPS", 3)
    fit = cox.fit_cox(df, ["x"])
    assert not fit.converged
    assert not cox.hazard_ratios(spark, fit).first()["converged"]


def test_hazard_table_and_residuals(spark, fit):
    table = {r["covariate"]: r for r in cox.hazard_ratios(spark, fit).collect()}
    assert table["x1"]["hazard_ratio"] == pytest.approx(np.exp(fit.coefficients[0]))
    assert table["x1"]["hazard_ratio_low"] < table["x1"]["hazard_ratio"] < table["x1"]["hazard_ratio_high"]
    # At the maximum the residuals add up to zero.
    sums = np.array([r["residuals"] for r in fit.durations.collect()]).sum(axis=0)
    assert sums == pytest.approx([0, 0], abs=1e-4)
    test = cox.proportionality_test(spark, fit).collect()
    assert all(0 <= r["p"] <= 1 for r in test)


def test_two_group_closed_form(spark):
    """One binary covariate, no ties: the score equation solved by bisection."""
    rows = [(1.0, 1, 1.0), (2.0, 1, 0.0), (3.0, 1, 1.0), (4.0, 1, 0.0), (5.0, 1, 0.0), (6.0, 0, 1.0)]
    df = spark.createDataFrame(rows, "_t double, _event int, x double")
    fit = cox.fit_cox(df, ["x"])

    def slope(b):
        return efron(rows, np.array([b + 1e-5])) - efron(rows, np.array([b - 1e-5]))

    low, high = -10.0, 10.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    assert fit.coefficients[0] == pytest.approx(low, abs=1e-3)


def test_residuals_and_test_equal_the_definition(spark, fit, rows):
    """Schoenfeld residuals row by row, their correlation with mean ranks, and no cap."""
    t, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    x = np.array([r[2:] for r in rows], dtype=float)
    w = np.exp(x @ fit.coefficients)
    want = {}
    for time in sorted(set(t[e == 1])):
        dead, risk = (t == time) & (e == 1), t >= time
        d = int(dead.sum())
        expected = sum(
            (w[risk] @ x[risk] - k / d * w[dead] @ x[dead]) / (w[risk].sum() - k / d * w[dead].sum()) for k in range(d))
        want[time] = (d, x[dead].sum(axis=0) - expected)
    got = {r["duration"]: r for r in fit.durations.collect()}
    assert set(got) == set(want)
    for time, (d, residual) in want.items():
        assert got[time]["deaths"] == d and got[time]["residuals"] == pytest.approx(residual, abs=1e-8)
    deaths = np.array([want[k][0] for k in sorted(want)])
    sums = np.array([want[k][1] for k in sorted(want)])
    rank = np.cumsum(deaths) - (deaths - 1) / 2
    centred = rank - (rank * deaths).sum() / deaths.sum()
    statistic = (centred @ (deaths.sum() * sums @ fit.covariance)) ** 2 / (
        deaths.sum() * np.diag(fit.covariance) * (deaths * centred**2).sum())
    table = cox.proportionality_test(spark, fit).collect()
    assert [r["test_statistic"] for r in table] == pytest.approx(statistic.tolist(), rel=1e-6)


def test_every_duration_may_differ(spark):
    """As many durations as rows: they stay in Spark."""
    n = 30_000
    df = spark.range(n).select(
        ((F.col("id") * 7919) % n + F.lit(1.0)).alias("_t"), (F.col("id") % 3 > 0).cast("int").alias("_event"),
        (F.col("id") % 2).cast("double").alias("x"))
    fit = cox.fit_cox(df, ["x"])
    assert fit.converged and abs(fit.coefficients[0]) < 0.05 and fit.durations.count() == n - n // 3
