"""Cox proportional hazards regression with Efron's treatment of ties.

Rows are laid out once, in ranges of falling duration, and kept. A Newton step reads
them twice: each range sends its sums of weight, weight*x and weight*x*x'; with the
sums of all earlier ranges, which start a range's own running sums, each range then
adds up its terms of the likelihood, its gradient and its information. A duration may
reach over several ranges, so a frequent one is split: the first and the last duration
of a range are sent as sums and finished by the driver. It gets a few p-by-p sums of
each range and solves a p-by-p system; rows, all other durations and residuals stay in
Spark, so there may be any number of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.ordering import running_sums
from ebbline.functions.scalars import churn_flag, clip
from ebbline.functions.staging import ensure_checkpoint_dir, stage
from ebbline.operators.features import one_hot

MAX_STEPS = 30
TOLERANCE = 1e-9
SMALLEST_STEP = 1e-4
TIE_BLOCK = 1_000_000  # terms of one duration that are in memory at once
PER_DURATION = "duration double, deaths bigint, residuals array<double>"
SUMS = "part int, place int, t double, deaths bigint, sums array<double>"
INSIDE, FIRST, LAST = 0, 1, 2  # places of durations in a range


@dataclass
class CoxFit:
    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    steps: int
    converged: bool
    durations: DataFrame  # deaths and summed Schoenfeld residuals of durations with deaths


def cox_design(
    df: DataFrame, duration: str, event: str, numeric: Sequence[str], categorical: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Duration of at least 1, event flag and covariates with reference levels."""
    encoded = one_hot(df, categorical, drop_first=True)
    names = list(numeric) + [c for c in encoded.columns if c not in df.columns]
    design = encoded.select(
        clip(F.col(duration), lower=1).cast("double").alias("_t"),
        churn_flag(df, event).alias("_event"),
        *[F.col(f"`{n}`").cast("double").alias(n) for n in names],
    )
    return design.na.drop(), names


def _tie_sums(risk: float, tied: float, deaths: int) -> np.ndarray:
    """Sums over the Efron terms c = k/deaths, phi = risk - c * tied, in blocks of terms."""
    total = np.zeros(6)
    for first in range(0, deaths, TIE_BLOCK):
        c = np.arange(first, min(deaths, first + TIE_BLOCK)) / deaths
        phi = risk - c * tied
        inverse = 1 / phi
        total += (
            np.log(phi).sum(), inverse.sum(), (c * inverse).sum(), (inverse**2).sum(),
            (c * inverse**2).sum(), (c**2 * inverse**2).sum(),
        )
    return total


class _Durations:
    """Runs of equal duration in batches of rows that come in falling order.

    Yields (duration, deaths, sums of all rows, sums of the dead, plain sums of the dead),
    where sums are of weight, weight*x and weight*x*x', one after the other.
    """

    def __init__(self, beta: np.ndarray) -> None:
        self.beta = beta
        self.open = None

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        return (a[0], *[x + y for x, y in zip(a[1:], b[1:])])

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        p = len(self.beta)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(0).to_numpy()
            dead = batch.column(1).to_numpy().astype(bool)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(t), p)
            w = np.exp(x @ self.beta)
            cuts = np.flatnonzero(np.diff(t)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)]):
                own = slice(a, b)
                gone = dead[own]
                run = (
                    t[a], int(gone.sum()), self._sums(w[own], x[own]),
                    self._sums(w[own][gone], x[own][gone]), x[own][gone].sum(axis=0))
                if self.open is not None and self.open[0] == run[0]:
                    self.open = self._joined(self.open, run)
                    continue
                if self.open is not None:
                    yield self.open
                self.open = run
        if self.open is not None:
            yield self.open

    @staticmethod
    def _sums(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        wx = x * w[:, None]
        return np.concatenate([[w.sum()], wx.sum(axis=0), (wx.T @ x).ravel()])


class _Layout:
    """Kept rows `t, dead, x` in ranges of falling duration."""

    def __init__(self, design: DataFrame, columns: list) -> None:
        ensure_checkpoint_dir(design.sparkSession)
        rows = stage(design.select(
            F.col("_t").cast("double").alias("t"), F.col("_event").cast("int").alias("dead"),
            F.array(*columns).alias("x")), "cox-rows")
        # The row number splits a frequent duration over ranges.
        self.rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(
            F.desc("t"), F.col("_row")).drop("_row").sortWithinPartitions(F.desc("t")).checkpoint()
        self.p = len(columns)

    def _range_sums(self, beta: np.ndarray) -> dict[int, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for run in _Durations(beta).read(batches):
                total = run[2] if total is None else total + run[2]
            if total is not None:
                yield _sums_rows([(INSIDE, 0.0, 0, total)])

        return {r["part"]: np.array(r["sums"]) for r in self.rows.mapInArrow(work, SUMS).collect()}

    def _starts(self, beta: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Sums of all earlier ranges, and with its own, of each range."""
        starts, total = {}, np.zeros(1 + self.p + self.p**2)
        for part, sums in sorted(self._range_sums(beta).items()):
            starts[part] = (total, total + sums)
            total = total + sums
        return starts

    def _pass(self, beta: np.ndarray) -> tuple[np.ndarray, list[tuple[float, int, np.ndarray]], object]:
        """Sums of the terms inside ranges, terms of the durations at their ends, and the
        broadcast sums that ranges start from."""
        starts = self._starts(beta)
        sent = self.rows.sparkSession.sparkContext.broadcast({p: s for p, (s, _) in starts.items()})

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, ends = None, []
            for place, run, terms in _places(batches, beta, sent.value):
                if place == INSIDE:
                    total = terms if total is None else total + terms
                else:
                    ends.append((place, run[0], run[1], np.concatenate(run[2:])))
            rows = ends + ([] if total is None else [(INSIDE, 0.0, 0, total)])
            if rows:
                yield _sums_rows(rows)

        inside, ends = np.zeros(1 + self.p + self.p**2), {}
        for part, place, t, deaths, sums in sorted(self.rows.mapInArrow(work, SUMS).collect()):
            sums = np.array(sums)
            if place == INSIDE:
                inside = inside + sums
                continue
            # The last range of a duration says who is at risk: everyone up to its end there.
            width = len(inside)
            at_risk = starts[part][0] + sums[:width] if place == FIRST else starts[part][1]
            before = ends.get(t, (0, np.zeros(len(sums))))
            ends[t] = (before[0] + deaths, before[1] + sums, at_risk)
        terms = [
            (t, deaths, _duration_terms(beta, at_risk, deaths, sums[width:2 * width], sums[2 * width:]))
            for t, (deaths, sums, at_risk) in ends.items() if deaths]
        return inside, terms, sent

    def likelihood(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, gradient and information."""
        p = self.p
        inside, ends, _ = self._pass(beta)
        found = sum((terms for _, _, terms in ends), inside)
        return found[0], found[1:1 + p], found[1 + p:].reshape(p, p)

    def residuals(self, beta: np.ndarray, scale: np.ndarray) -> DataFrame:
        """Deaths and residual sums of every duration with deaths."""
        p = self.p
        _, ends, sent = self._pass(beta)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for place, run, terms in _places(batches, beta, sent.value):
                if place == INSIDE and run[1]:
                    held.append((run[0], run[1], (terms[1:1 + p] * scale).tolist()))
                if len(held) == 10_000:
                    yield _residual_rows(held)
                    held = []
            yield _residual_rows(held)

        rows = [(float(t), int(n), (terms[1:1 + p] * scale).tolist()) for t, n, terms in ends]
        return self.rows.mapInArrow(work, PER_DURATION).unionByName(
            self.rows.sparkSession.createDataFrame(rows, PER_DURATION))


def _sums_rows(rows: list[tuple]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    columns = list(zip(*[(part, place, t, n, sums.tolist()) for place, t, n, sums in rows]))
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "place", "t", "deaths", "sums"])


def _residual_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.float64(), pa.int64(), pa.list_(pa.float64())]
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, kinds)], names=["duration", "deaths", "residuals"])


def _duration_terms(
    beta: np.ndarray, at_risk: np.ndarray, deaths: int, dead: np.ndarray, dead_x: np.ndarray
) -> np.ndarray:
    """Log likelihood, gradient and information that the deaths of one duration add."""
    p = len(beta)
    cut = lambda sums: (sums[0], sums[1:1 + p], sums[1 + p:].reshape(p, p))
    (r0, r1, r2), (e0, e1, e2) = cut(at_risk), cut(dead)
    logs, s1, sc1, s2, sc2, scc2 = _tie_sums(r0, e0, deaths)
    cross = np.outer(r1, e1)
    information = (
        s1 * r2 - sc1 * e2
        - (s2 * np.outer(r1, r1) - sc2 * (cross + cross.T) + scc2 * np.outer(e1, e1)))
    return np.concatenate([[beta @ dead_x - logs], dead_x - (s1 * r1 - sc1 * e1), information.ravel()])


def _places(
    batches: Iterator[pa.RecordBatch], beta: np.ndarray, starts: dict[int, np.ndarray]
) -> Iterator[tuple[int, tuple, np.ndarray | None]]:
    """The durations of a range: the first, those inside with their terms, the last."""
    p = len(beta)
    at_risk, held = starts.get(TaskContext.get().partitionId()), None
    for number, run in enumerate(_Durations(beta).read(batches)):
        if not number:
            at_risk = at_risk + run[2]
            yield FIRST, run, None
            continue
        if held is not None:
            at_risk = at_risk + held[2]
            yield INSIDE, held, (
                _duration_terms(beta, at_risk, held[1], held[3], held[4]) if held[1] else np.zeros(1 + p + p * p))
        held = run
    if held is not None:
        yield LAST, held, None


def fit_cox(design: DataFrame, names: Sequence[str]) -> CoxFit:
    """Newton's method on standardised covariates, with step halving.

    Covariates without variance are left out of the fit.
    """
    moments = design.agg(
        *[F.avg(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)],
    ).first()
    spread = [moments[f"s{i}"] or 0.0 for i in range(len(names))]
    kept = [i for i, s in enumerate(spread) if s > 1e-12]
    scale = np.array([spread[i] for i in kept])
    layout = _Layout(design, [(F.col(f"`{names[i]}`") - moments[f"m{i}"]) / spread[i] for i in kept])
    beta = np.zeros(len(kept))
    loglik, gradient, information = layout.likelihood(beta)
    converged = False
    for step in range(1, MAX_STEPS + 1):
        direction = np.linalg.solve(information, gradient)
        size, better = 1.0, False
        while not better and size >= SMALLEST_STEP:
            trial = beta + size * direction
            new = layout.likelihood(trial)
            better = new[0] >= loglik - 1e-12 * abs(loglik)
            size /= 2
        if not better:
            # No step along the ascent direction helps: a maximum as far as doubles go,
            # or a fit that failed. A worse one is never taken.
            converged = bool(gradient @ direction < TOLERANCE * (abs(loglik) + 1))
            break
        gain = new[0] - loglik
        beta = trial
        loglik, gradient, information = new
        if abs(gain) < TOLERANCE * (abs(loglik) + 1):
            converged = True
            break
    covariance = np.linalg.inv(information) / np.outer(scale, scale)
    return CoxFit(
        [names[i] for i in kept], beta / scale, covariance, loglik, step, converged,
        layout.residuals(beta, scale))


def hazard_ratios(spark, fit: CoxFit, level: float = 0.95) -> DataFrame:
    """Coefficient, hazard ratio, standard error, z, p and interval per covariate.

    `converged` is false where the fit stopped before the likelihood settled.
    """
    errors = np.sqrt(np.diag(fit.covariance))
    critical = NormalDist().inv_cdf(0.5 + level / 2)
    rows = [
        (
            name, float(b), float(np.exp(b)), float(se), float(b / se),
            math.erfc(abs(b / se) / math.sqrt(2)),
            float(np.exp(b - critical * se)), float(np.exp(b + critical * se)), fit.converged,
        )
        for name, b, se in zip(fit.names, fit.coefficients, errors)
    ]
    return spark.createDataFrame(
        rows,
        "covariate string, coef double, hazard_ratio double, se double, z double, p double, "
        "hazard_ratio_low double, hazard_ratio_high double, converged boolean",
    )


def proportionality_test(spark, fit: CoxFit) -> DataFrame:
    """Test of constant hazard ratios against the rank of the event time.

    Correlates the scaled Schoenfeld residuals of the deaths with the mean rank
    of their durations, which is a running sum of deaths over the durations.
    """
    p = len(fit.names)
    ranked = running_sums(fit.durations, [F.col("duration")], ["deaths"]).select(
        "deaths", "residuals", (F.col("cum_deaths") - (F.col("deaths") - 1) / 2).alias("rank"))
    n, d = F.col("rank"), F.col("deaths")
    found = ranked.agg(
        F.sum(d).alias("total"), F.sum(n * d).alias("nd"), F.sum(n * n * d).alias("nnd"),
        F.array(*[F.sum(F.col("residuals")[i]) for i in range(p)]).alias("s"),
        F.array(*[F.sum(n * F.col("residuals")[i]) for i in range(p)]).alias("ns"),
    ).first()
    total, mean = found["total"], found["nd"] / found["total"]
    spread = found["nnd"] - mean * found["nd"]
    centred = np.array(found["ns"]) - mean * np.array(found["s"])
    statistic = (total * centred @ fit.covariance) ** 2 / (total * np.diag(fit.covariance) * spread)
    rows = [
        (name, float(x), math.erfc(math.sqrt(x / 2)))
        for name, x in zip(fit.names, statistic)
    ]
    return spark.createDataFrame(rows, "covariate string, test_statistic double, p double")
