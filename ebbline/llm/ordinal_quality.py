"""Quality scores by ordinal cumulative-link regression on hashed text.

Grades are ordered numbers. One weight per hashed feature is shared by all grades, and
ordered thresholds t1 < t2 < ... turn a text's score s into
P(grade <= k) = 1 / (1 + exp(s - t_k)), from which come the expected grade and the tail
probability of a wanted grade. Features of a text are its lower-cased words, the shapes of
its tokens (runs of capitals, letters, digits and the marks themselves) and whether a
token repeats the one before; each counts with the root of its share of the tokens.

Fitted is on at most `sample_docs` rated documents, those of the smallest hash: features
are hashed in the tasks, weights are found on the driver by gradient steps (Adam) on the
exact likelihood with a ridge penalty; thresholds are a first value and the logarithms of
their gaps, so their order cannot be lost. Scoring reads whole texts.

Defined results: a null or empty text has no features and gets the score 0, that is, what
the thresholds alone say. Null ratings are not learned from; of repeated ratings the larger
counts. With fewer than two grades among the ratings the only grade (0 without any) is
certain. Repeated rows get equal results. An empty table gives an empty result. Input
columns named like result columns give way.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import WORD_CHARS, replace_columns, utf8

BUCKETS = 1 << 16
MEMO_TOKENS = 400_000
REPEATED = zlib.crc32(b"=") % BUCKETS
#: Capitals to A, small letters and non-ASCII bytes to a, digits to 0, marks stay.
_SHAPES = bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)


def token_shape(token: bytes) -> bytes:
    """The token's classes of characters, runs of one class written once or twice."""
    shape, out = token.translate(_SHAPES), bytearray()
    for b in shape:
        if len(out) < 2 or out[-1] != b or out[-2] != b:
            out.append(b)
    return bytes(out[:12])


class TextHasher:
    """Sparse features of a text: bucket numbers and values."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def _buckets(self, token: bytes) -> tuple[int, ...]:
        words = token.translate(WORD_CHARS).split()
        return (
            zlib.crc32(b"s" + token_shape(token)) % self.buckets,
            *(zlib.crc32(b"w" + w) % self.buckets for w in words),
        )

    def features(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or b"").split()
        counts: Counter = Counter()
        memo = self.memo
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        for token, n in Counter(tokens).items():
            found = memo.get(token)
            if found is None:
                found = memo[token] = self._buckets(token)
            for bucket in found:
                counts[bucket] += n
        repeats = sum(map(bytes.__eq__, tokens, tokens[1:]))
        if repeats:
            counts[REPEATED % self.buckets] += repeats
        index = np.fromiter(counts.keys(), np.int32, len(counts))
        value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(1, len(tokens)))
        return index, value


@dataclass(frozen=True)
class OrdinalModel:
    grades: tuple[int, ...]
    weights: np.ndarray     # one per bucket
    thresholds: np.ndarray  # one less than grades, ascending

    def cumulative(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all but the last grade: rows x thresholds."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds, -40, 40)))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, dtype=float))
        return self.grades[0] + (1 - self.cumulative(scores)) @ steps

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        """P(grade at least the given one)."""
        below = sum(g < grade for g in self.grades)
        if below == 0:
            return np.ones(len(scores))
        if below == len(self.grades):
            return np.zeros(len(scores))
        return 1 - self.cumulative(scores)[:, below - 1]


def fit_ordinal(
    features: list[tuple[np.ndarray, np.ndarray]], ratings: list[int], buckets: int = BUCKETS,
    rounds: int = 250, rate: float = 0.15, penalty: float = 2e-4,
) -> OrdinalModel:
    """Maximum likelihood with a ridge penalty on the shared weights."""
    grades = tuple(sorted(set(ratings))) or (0,)
    weights = np.zeros(buckets)
    if len(grades) < 2:
        return OrdinalModel(grades, weights, np.zeros(0))
    place = np.searchsorted(grades, ratings)
    sizes = np.array([len(i) for i, _ in features])
    index = np.concatenate([i for i, _ in features]) if sizes.sum() else np.zeros(0, np.int32)
    value = np.concatenate([v for _, v in features]) if sizes.sum() else np.zeros(0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shares = np.cumsum(np.bincount(place, minlength=len(grades)) / len(place))[:-1]
    starts = np.log(shares / (1 - shares))
    gaps = np.concatenate([starts[:1], np.log(np.maximum(np.diff(starts), 1e-3))])
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (weights, gaps)]
    rows = np.arange(len(sizes))
    for n in range(1, rounds + 1):
        thresholds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        scores = np.bincount(row, weights=value * weights[index], minlength=len(sizes))
        # Each grade lies between two thresholds; the outer ones are at infinity.
        cdf = 1 / (1 + np.exp(np.clip(scores[:, None] - thresholds, -40, 40)))
        cdf = np.hstack([np.zeros((len(sizes), 1)), cdf, np.ones((len(sizes), 1))])
        density = cdf * (1 - cdf)
        chance = np.maximum(cdf[rows, place + 1] - cdf[rows, place], 1e-12)
        upper, lower = density[rows, place + 1] / chance, density[rows, place] / chance
        slope = (upper - lower) / len(sizes)  # of minus the likelihood, by the score
        by_threshold = np.array([
            (lower[place == k + 1].sum() - upper[place == k].sum()) / len(sizes) for k in range(len(thresholds))])
        after = np.cumsum(by_threshold[::-1])[::-1]
        grads = [
            np.bincount(index, weights=value * slope[row], minlength=buckets) + penalty * weights,
            np.concatenate([after[:1], after[1:] * np.exp(gaps[1:])]),
        ]
        for w, g, (m, v) in zip((weights, gaps), grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return OrdinalModel(grades, weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def fit_quality(
    docs: DataFrame, ratings: DataFrame, may_learn: Column, id_column: str = "doc_id",
    text: str = "text", grade: str = "grade", sample_docs: int = 4000, seed: int = 31,
    buckets: int = BUCKETS, **options,
) -> OrdinalModel:
    """Learn from the rated documents for which `may_learn` (over the id) holds."""
    usable = (
        ratings.where(F.col(grade).isNotNull() & F.col(id_column).isNotNull() & may_learn)
        .groupBy(id_column).agg(F.max(grade).cast("long").alias("_grade"))
    )
    chosen = usable.orderBy(F.xxhash64(id_column, F.lit(seed)), id_column).limit(sample_docs)

    @F.arrow_udf("struct<i:array<int>,v:array<double>>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = TextHasher(buckets)
        for texts in batches:
            found = [hasher.features(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([
                pa.array([i for i, _ in found], type=pa.list_(pa.int32())),
                pa.array([v for _, v in found], type=pa.list_(pa.float64()))], ["i", "v"])

    # At most `sample_docs` ids are sent out, and as many sparse rows come back.
    rows = (
        docs.select(id_column, text).join(F.broadcast(chosen), id_column)
        .select(id_column, "_grade", hashed(utf8(text)).alias("f")).orderBy(id_column).toLocalIterator()
    )
    features, grades = [], []
    for r in rows:
        features.append((np.array(r["f"]["i"], dtype=np.int32), np.array(r["f"]["v"])))
        grades.append(r["_grade"])
    return fit_ordinal(features, grades, buckets, **options)


def score_quality(
    docs: DataFrame, model: OrdinalModel, wanted: int, text: str = "text", least: float = 0.5,
) -> DataFrame:
    """Add expected_grade, tail_probability (of `wanted` or better) and selected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<expected:double,tail:double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        hasher = TextHasher(len(own.weights))
        for texts in batches:
            found = [hasher.features(t.as_py()) for t in texts]
            scores = np.array([own.weights[i] @ v for i, v in found], dtype=np.float64)
            yield pa.StructArray.from_arrays(
                [pa.array(own.expected(scores)), pa.array(own.tail(scores, wanted))], ["expected", "tail"])

    scored = replace_columns(docs, {"_graded": compute.asNondeterministic()(utf8(text))})
    return replace_columns(scored, {
        "expected_grade": F.col("_graded.expected"), "tail_probability": F.col("_graded.tail"),
        "selected": F.col("_graded.tail") >= least,
    }).drop("_graded")
