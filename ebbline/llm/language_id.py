"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads every byte of a text in both directions and labels every position; a
document's probabilities are the mean over its positions. It is trained in numpy by
backpropagation through time (Adam, balanced over languages) on windows of a bounded
sample of labelled documents: of each language of the whole table an equal part of
`sample_docs` distinct ids, one at least, those of the smallest hash, and `windows` evenly
spaced windows of each; of copies of an id in a language one counts. Labelling reads whole texts: a text is cut
into segments of `steps` bytes, each read with fresh states, and segments of many
documents run side by side as matrices inside an Arrow function.

Defined results: a null text and one without a letter are `und` with score 0. Without
labelled rows every text with a letter is `und` too. Repeated rows get equal results. An
empty table gives an empty result; input columns named like result columns give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.common import replace_columns, utf8

UNKNOWN = "und"
STEPS = 64
SIDE_BY_SIDE = 2048  # segments in one matrix


@dataclass(frozen=True)
class ByteReader:
    """Weights; H units and L languages. Gates are stacked as update, reset, candidate."""

    languages: tuple[str, ...]
    inputs: np.ndarray     # 2 x 3H x 256, biases included
    recurrent: np.ndarray  # 2 x 3H x H
    readout: np.ndarray    # L x 2H
    bias: np.ndarray       # L x 1

    def label(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, steps: int) -> np.ndarray:
        """Sums of position probabilities (L x segments) for segments of a byte array."""
        units = self.recurrent.shape[2]
        # sigmoid(x) = tanh(x / 2) / 2 + 1/2: one tanh serves both gates.
        inputs, recurrent = self.inputs.copy(), self.recurrent.copy()
        inputs[:, : 2 * units] *= 0.5
        recurrent[:, : 2 * units] *= 0.5
        longest = int(lengths.max(initial=0))
        at = np.minimum(starts[None, :] + np.arange(longest)[:, None], len(data) - 1)
        letters = data[at]
        inside = (np.arange(longest)[:, None] < lengths[None, :]).astype(np.float32)
        forward = np.empty((longest, units, len(starts)), dtype=np.float32)
        state = np.zeros((units, len(starts)), dtype=np.float32)
        for t in range(longest):
            state = _advance(inputs[0], recurrent[0], letters[t], state, units)
            forward[t] = state
        total = np.zeros((len(self.languages), len(starts)), dtype=np.float32)
        state = np.zeros_like(state)
        left, right = self.readout[:, :units], self.readout[:, units:]
        for t in range(longest - 1, -1, -1):
            state = _advance(inputs[1], recurrent[1], letters[t], state, units)
            state *= inside[t]  # a shorter segment begins at its own end
            scores = left @ forward[t]
            scores += right @ state
            scores += self.bias
            np.exp(scores, out=scores)
            scores *= inside[t] / scores.sum(axis=0)
            total += scores
        return total

    def documents(self, texts: pa.Array, steps: int = STEPS) -> np.ndarray:
        """Mean position probabilities, documents x languages; zeros for no bytes."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
        sizes = np.diff(offsets)
        if texts.null_count:
            sizes = np.where(np.asarray(texts.is_null()), 0, sizes)
        pooled = np.zeros((len(texts), len(self.languages)))
        if not sizes.sum():
            return pooled
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        pieces = -(-sizes // steps)
        owner = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = offsets[owner] + number * steps
        lengths = np.minimum(sizes[owner] - number * steps, steps)
        for n in range(0, len(owner), SIDE_BY_SIDE):
            part = slice(n, n + SIDE_BY_SIDE)
            sums = self.label(data, starts[part], lengths[part], steps)
            for k, row in enumerate(sums):
                pooled[:, k] += np.bincount(owner[part], weights=row, minlength=len(texts))
        return pooled / np.maximum(sizes, 1)[:, None]


def _advance(inputs, recurrent, letters, state, units):
    """One step of all segments; gate weights are halved beforehand."""
    given = np.take(inputs, letters, axis=1)
    kept = recurrent @ state
    gates = given[: 2 * units]
    gates += kept[: 2 * units]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    fresh = kept[2 * units:]
    fresh *= gates[units:]
    fresh += given[2 * units:]
    np.tanh(fresh, out=fresh)
    state = state - fresh
    state *= gates[:units]
    state += fresh
    return state


class _Trainer:
    """Forward and backward passes over windows of equal length."""

    def __init__(self, languages: int, units: int, rng: np.random.Generator) -> None:
        self.units = units
        scale = 1 / np.sqrt(units)
        self.weights = {
            "inputs": rng.normal(0, 0.3, (2, 3 * units, 256)),
            "recurrent": rng.normal(0, scale, (2, 3 * units, units)),
            "readout": rng.normal(0, scale, (languages, 2 * units)),
            "bias": np.zeros((languages, 1)),
        }
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.weights.items()}
        self.count = 0

    def _read(self, side: int, letters: np.ndarray):
        units, trace = self.units, []
        inputs, recurrent = self.weights["inputs"][side], self.weights["recurrent"][side]
        state = np.zeros((units, letters.shape[1]), dtype=np.float32)
        for row in letters:
            given, kept = inputs[:, row], recurrent @ state
            gates = 1 / (1 + np.exp(-(given[: 2 * units] + kept[: 2 * units])))
            update, reset = gates[:units], gates[units:]
            fresh = np.tanh(given[2 * units:] + reset * kept[2 * units:])
            trace.append((state, update, reset, fresh, kept[2 * units:]))
            state = fresh + update * (state - fresh)
        return trace, [*[t[0] for t in trace[1:]], state]

    def _unread(self, side: int, letters: np.ndarray, trace: list, wished: np.ndarray):
        """Backpropagation through time; `wished` is the gradient at each state."""
        units = self.units
        recurrent = self.weights["recurrent"][side]
        inner = np.empty((len(letters), 3 * units, letters.shape[1]), dtype=np.float32)
        grad = np.zeros_like(recurrent)
        carried = np.zeros_like(trace[0][0])
        for t in range(len(letters) - 1, -1, -1):
            before, update, reset, fresh, kept = trace[t]
            d = wished[t] + carried
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_update = d * (before - fresh) * update * (1 - update)
            d_reset = d_fresh * kept * reset * (1 - reset)
            inner[t, :units], inner[t, units: 2 * units], inner[t, 2 * units:] = d_update, d_reset, d_fresh
            through = np.concatenate([d_update, d_reset, d_fresh * reset])
            grad += through @ before.T
            carried = d * update + recurrent.T @ through
        flat = letters.ravel()
        rows = inner.transpose(1, 0, 2).reshape(3 * units, -1)
        return np.stack([np.bincount(flat, weights=r, minlength=256) for r in rows]), grad

    def step(self, letters: np.ndarray, labels: np.ndarray, rate: float) -> float:
        """One update on windows (steps x batch) with a label each; the mean loss."""
        steps, batch = letters.shape
        forward, states = self._read(0, letters)
        backward, back_states = self._read(1, letters[::-1])
        both = np.concatenate([np.stack(states), np.stack(back_states[::-1])], axis=1)
        scores = np.einsum("lh,thb->tlb", self.weights["readout"], both, optimize=True) + self.weights["bias"]
        scores -= scores.max(axis=1, keepdims=True)
        odds = np.exp(scores)
        odds /= odds.sum(axis=1, keepdims=True)
        loss = -np.log(odds[:, labels, np.arange(batch)] + 1e-9).mean()
        d = odds
        d[:, labels, np.arange(batch)] -= 1
        d /= steps * batch
        grads = {
            "readout": np.einsum("tlb,thb->lh", d, both, optimize=True),
            "bias": d.sum(axis=(0, 2))[:, None],
        }
        wished = np.einsum("lh,tlb->thb", self.weights["readout"], d, optimize=True)
        one = self._unread(0, letters, forward, wished[:, : self.units])
        two = self._unread(1, letters[::-1], backward, wished[::-1, self.units:])
        grads["inputs"], grads["recurrent"] = np.stack([one[0], two[0]]), np.stack([one[1], two[1]])
        self.count += 1
        for name, g in grads.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            m, v = self.moments[name]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.weights[name] -= rate * (m / (1 - 0.9**self.count)) / (
                np.sqrt(v / (1 - 0.99**self.count)) + 1e-6)
        return float(loss)


def train_reader(
    windows: list[bytes], labels: list[str], units: int = 8, updates: int = 260,
    batch: int = 192, steps: int = 48, rate: float = 0.02, seed: int = 3,
) -> ByteReader | None:
    """Fit on labelled windows; batches have equally many of each language."""
    usable = [(w, s) for w, s in zip(windows, labels) if w]
    languages = tuple(sorted({s for _, s in usable}))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    by_language = [
        np.stack([np.resize(np.frombuffer(w, dtype=np.uint8), steps) for w, s in usable if s == name])
        for name in languages
    ]
    trainer = _Trainer(len(languages), units, rng)
    for n in range(updates):
        drawn = rng.integers(0, len(languages), batch)
        rows = np.stack([by_language[k][rng.integers(len(by_language[k]))] for k in drawn])
        trainer.step(rows.T, drawn, rate * (1 - 0.9 * n / updates))
    w = trainer.weights
    return ByteReader(languages, w["inputs"], w["recurrent"], w["readout"], w["bias"])


def training_windows(
    docs: DataFrame, label: str = "lang", id_column: str = "doc_id", text: str = "text",
    sample_docs: int = 3000, windows: int = 4, steps: int = 48, seed: int = 11,
) -> tuple[list[bytes], list[str]]:
    """Windows of labelled documents of the smallest hash, as many of each language."""

    @F.arrow_udf("array<binary>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts:
                body = t.as_py() or b""
                room = max(0, len(body) - steps)
                starts = sorted({room * (2 * i + 1) // (2 * windows) for i in range(windows)})
                out.append([body[s:s + steps] for s in starts] if body else [])
            yield pa.array(out, type=pa.list_(pa.binary()))

    # Ids first, so that no text is sorted; copies of an id count once per language.
    labelled = docs.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(
        id_column, F.col(label).alias("label"), F.col(text).alias("_text"))
    pairs = labelled.select(id_column, "label").distinct().withColumn("_hash", F.xxhash64(id_column, F.lit(seed)))
    sizes = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least"))
    each = max(1, sample_docs // max(1, sizes.count()))
    # What may be among a language's smallest hashes is little, so that no task ranks all of it.
    near = (F.col("_hash") / F.lit(2.0**64) + 0.5) * F.col("_n") <= 2 * each + 20
    first = Window.partitionBy("label").orderBy("_hash", id_column)
    chosen = (
        pairs.join(sizes, "label").where(near | (F.col("_hash") == F.col("_least")))
        .withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= each)
        .select(id_column, "label")
    )
    rows = (
        labelled.join(F.broadcast(chosen), [id_column, "label"], "left_semi")
        .select(id_column, "label", cut(utf8("_text")).alias("windows"))
        .groupBy(id_column, "label").agg(F.max("windows").alias("windows"))
        .orderBy(id_column, "label").collect()
    )
    pairs = [(bytes(w), r["label"]) for r in rows for w in r["windows"]]
    return [w for w, _ in pairs], [s for _, s in pairs]


def predict_language(docs: DataFrame, reader: ByteReader | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score to every document."""
    if reader is None:
        return replace_columns(docs, {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    guess = language_column(docs.sparkSession, text, reader)
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return replace_columns(replace_columns(docs, {"_guess": guess, "_letter": has_letter}), {
        "lang_pred": F.when(F.col("_letter"), F.col("_guess.lang")).otherwise(UNKNOWN),
        "score": F.when(F.col("_letter"), F.col("_guess.score")).otherwise(0.0),
    }).drop("_guess", "_letter")


def language_column(spark: SparkSession, text: str, reader: ByteReader) -> Column:
    """An Arrow function that gives language and score of whole texts."""
    sent = spark.sparkContext.broadcast(reader)

    @F.arrow_udf("struct<lang:string,score:double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = np.array(sent.value.languages, dtype=object)
        for texts in batches:
            pooled = sent.value.documents(texts)
            best = pooled.argmax(axis=1)
            yield pa.StructArray.from_arrays(
                [pa.array(names[best], type=pa.string()),
                 pa.array(pooled[np.arange(len(best)), best].clip(0, 1))], ["lang", "score"])

    return compute.asNondeterministic()(utf8(text))


def fit_language_reader(docs: DataFrame, may_learn: Column, text: str = "text", **options) -> ByteReader | None:
    """Fit on the labelled documents for which `may_learn` holds."""
    windows, labels = training_windows(docs.where(may_learn), text=text, **options)
    return train_reader(windows, labels)
