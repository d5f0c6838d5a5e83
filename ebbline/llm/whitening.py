"""PCA whitening of embeddings; components by QDWH spectral divide-and-conquer.

Entries become integers by `floor(scale * c)`. The fit list is each distinct integer vector
once. Its count, sums (exact integers) and centred cross products are gathered by tasks in
one pass, merged pairwise without cancellation, and reach the driver as one d x d matrix
per merging task; only d, never the number of rows, decides what the driver holds.

The covariance is then split: the polar factor U of V - s*I, found by the dynamically
weighted Halley iteration (QDWH) in its inverse-free form with QR factorisations, has the
eigenvalues +1 and -1 for those of V above and below s, so (U + I) / 2 projects onto the
invariant subspace above s and (I - U) / 2 onto the one below. Both are split again on
their own covariance until one dimension, or a multiple of the identity, is left.

The components wanted are broadcast as a d x k matrix and applied to all rows in one pass.

Defined results: rows whose vector is null or holds null or non-finite entries are left out,
and so are vectors that do not have the most frequent length (of equally frequent ones the
shortest). Entries beyond the range of long are held at its ends. Null ids and repeated rows
keep a result each. Components without variance cannot be scaled and are left out; a
single distinct vector therefore gives no rows. A deviation beyond the range of long is
null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stage

EPS = np.finfo(float).eps
#: Bytes of partial matrices that may reach the driver together.
DRIVER_BYTES = 32 << 20
LONG = 1 << 63


# ── spectral divide-and-conquer ──────────────────────────────────────────────

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The symmetric orthogonal polar factor of a symmetric matrix, by QDWH with QR."""
    m = len(a)
    x = a / max(np.linalg.norm(a), EPS)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * math.sqrt(m))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(1.0, max(low, EPS))
    for _ in range(40):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(m)]))
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved <= 10 * EPS ** (1 / 3) and 1 - low <= 10 * EPS:
            break
    return x


def _range_basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range, by two steps of subspace iteration."""
    start = np.random.default_rng(rank).standard_normal((len(projector), rank))
    basis, _ = np.linalg.qr(projector @ start)
    basis, _ = np.linalg.qr(projector @ basis)
    return basis


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift.

    The shift starts at the mean eigenvalue, which always lies between the extremes; if it
    comes too close to an eigenvalue for a clean projector, others are tried.
    """
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / math.sqrt(m)
    best = None
    for step in (0.0, 0.1, -0.1, 0.3, -0.3, 0.05, -0.05, 0.6, -0.6, 0.9, -0.9):
        factor = polar_factor(a - (mean + step * spread) * np.eye(m))
        rank = round((m + np.trace(factor)) / 2)
        if not 0 < rank < m:
            continue
        above = _range_basis((np.eye(m) + factor) / 2, rank)
        below = _range_basis((np.eye(m) - factor) / 2, m - rank)
        joint, _ = np.linalg.qr(np.hstack([above, below]))
        above, below = joint[:, :rank], joint[:, rank:]
        rest = np.linalg.norm(above.T @ a @ below)
        if best is None or rest < best[0]:
            best = rest, above, below
        if rest <= 100 * EPS * m * np.linalg.norm(a):
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def spectral_components(v: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the first `wanted` or all."""
    scale = np.linalg.norm(v)
    goal = len(v) if wanted is None else min(wanted, len(v))
    vectors: list[np.ndarray] = []
    parts = [np.eye(len(v))]  # bases still to split, the largest eigenvalues last
    while parts and len(vectors) < goal:
        basis = parts.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m = len(a)
        if m == 1 or np.linalg.norm(a - np.trace(a) / m * np.eye(m)) <= 10 * EPS * m * scale:
            vectors += list(basis.T)
            continue
        above, below = _split(a)
        parts += [basis @ below, basis @ above]
    chosen = np.array(vectors[:goal]).reshape(-1, len(v)).T
    chosen /= np.maximum(np.linalg.norm(chosen, axis=0), EPS)
    values = np.einsum("ij,ij->j", chosen, v @ chosen)
    order = np.argsort(-values, kind="stable")
    return values[order], chosen[:, order]


# ── moments gathered by tasks ────────────────────────────────────────────────

@dataclass
class Moments:
    """Count, exact sums (where entries are integers), mean and centred cross products."""

    n: int
    sums: list[int]
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> Moments:
        if block.dtype == np.int64:
            small = np.abs(block.astype(float)).max(initial=0) * len(block) < 2.0**62
            sums = [int(s) for s in (block if small else block.astype(object)).sum(axis=0)]
            mean = np.array([s / len(block) for s in sums])
        else:
            sums, mean = [0] * block.shape[1], block.mean(axis=0)
        centred = block - mean
        return cls(len(block), sums, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n, [a + b for a, b in zip(self.sums, other.sums)], self.mean + gap * (other.n / n),
            self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n))

    def row(self) -> tuple:
        return self.n, [str(s) for s in self.sums], self.mean.tolist(), self.cross.tobytes()

    @classmethod
    def read(cls, n: int, sums: list[str], mean: list[float], cross: bytes) -> Moments:
        d = len(mean)
        return cls(n, [int(s) for s in sums], np.array(mean), np.frombuffer(cross).reshape(d, d))


_PARTIAL = "part bigint, n bigint, sums array<string>, mean array<double>, cross binary"


def _partial(held: Moments | None) -> Iterator[pa.RecordBatch]:
    if held is not None:
        n, sums, mean, cross = held.row()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()),
            "sums": pa.array([sums], pa.list_(pa.string())), "mean": pa.array([mean], pa.list_(pa.float64())),
            "cross": pa.array([cross], pa.binary())})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gather_moments(
    vectors: DataFrame, dim: int, change: Callable[[np.ndarray], np.ndarray] = lambda block: block
) -> Moments | None:
    """Moments of the column `x` over all rows, after `change`; None for no rows.

    Each task sends one partial; partials are merged by so many tasks that theirs, together,
    stay within DRIVER_BYTES.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                own = Moments.of(change(_matrix(batch.column(0))))
                held = own if held is None else held.merged(own)
        yield from _partial(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                own = Moments.read(row["n"], row["sums"], row["mean"], row["cross"])
                held = own if held is None else held.merged(own)
        yield from _partial(held)

    groups = max(1, min(16, DRIVER_BYTES // (8 * dim * dim)))
    partial = vectors.select("x").mapInArrow(collect, _PARTIAL)
    merged = partial.repartition(groups, "part").sortWithinPartitions("part").mapInArrow(merge, _PARTIAL)
    total = None
    for row in sorted(merged.collect(), key=lambda r: r["part"]):
        own = Moments.read(row["n"], row["sums"], row["mean"], row["cross"])
        total = own if total is None else total.merged(own)
    return total


# ── the operator ─────────────────────────────────────────────────────────────

@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    values: np.ndarray      # eigenvalues, falling
    components: np.ndarray  # d x k, unit columns
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - sums)^2; null beyond the range of long."""
        largest = max(
            float(np.abs(x.astype(float)).max(initial=0)) * self.n, float(max(map(abs, self.sums), default=0)))
        fits = largest < 2.0**61 and 4 * largest * largest * x.shape[1] < 2.0**62
        kind = np.int64 if fits else object
        gap = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(s) if s < LONG else None for s in (gap * gap).sum(axis=1)]


def integer_vectors(
    table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """`id, x` of the rows that take part; x is an array of long."""
    doubles = table.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = doubles.where(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))
    lengths = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), "d").first()
    return sound.where(F.size("v") == (common["d"] if common else 0)).select(
        "id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def fit_whitening(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """From `x` of all rows, each distinct vector once; None if there is no variance."""
    fit = stage(vectors.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return None
    dim = len(first["x"])
    moments = gather_moments(fit, dim)
    covariance = moments.cross / moments.n
    values, basis = spectral_components(covariance, components)
    some = values > dim * EPS * max(values[0], np.trace(covariance))
    if not some.any():
        return None
    found = Whitening(
        moments.n, tuple(moments.sums), values[some], basis[:, some], float(np.trace(covariance)), 0.0)
    after = gather_moments(fit, int(some.sum()), found.whiten)
    error = np.abs(after.cross / after.n - np.eye(len(after.cross))).max()
    return Whitening(found.n, found.sums, found.values, found.components, found.trace, float(error))


def whiten_embeddings(
    table: DataFrame, components: int | None = None, id_column: str = "vec_id",
    vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """One row per usable vector: id, `n`, `deviation`, `whitened` and `explained` (arrays in
    the order of components) and `identity_error`."""
    vectors = stage(integer_vectors(table, id_column, vector, scale), "whitening-vectors")
    fitted = fit_whitening(vectors, components)
    schema = (
        "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double")
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema).select(
            F.lit(None).cast(vectors.schema["id"].dataType).alias(id_column), "*")
    sent = table.sparkSession.sparkContext.broadcast(fitted)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for column in batches:
            block = _matrix(column) if len(column) else np.zeros((0, len(own.sums)), dtype=np.int64)
            flat = own.whiten(block)
            yield pa.StructArray.from_arrays(
                [pa.array(own.deviation(block), pa.int64()), pa.array(list(flat), pa.list_(pa.float64()))],
                ["deviation", "whitened"])

    return vectors.select("id", apply.asNondeterministic()("x").alias("w")).select(
        F.col("id").alias(id_column), F.lit(fitted.n).cast("long").alias("n"), "w.deviation", "w.whitened",
        F.lit((fitted.values / fitted.trace).tolist()).cast("array<double>").alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"))
