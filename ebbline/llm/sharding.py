"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each block of each shard is drawn first,
exactly as a uniform permutation of all rows would have it: the matrix is multivariate
hypergeometric, with the partitions' row counts and the blocks' sizes as margins. Inside
a partition a random permutation of its block labels deals its rows out (local shuffle),
the rows are exchanged by block, and each block orders what it got at random (second
local shuffle). The result is a uniform permutation, and all sizes are exact.

The matrix is never built. It is drawn down a binary tree over the partitions, every node
with its own seeded generator; a task walks from the root to its own partition and so
derives its row alone. What is sent to the tasks is one number per partition. Shards are
cut into blocks of at most `block_rows` rows and, at the rows' mean size, `block_bytes` of
text, so that no task holds a whole shard; each block is a task of its own.

Law `rows`: shard sizes differ by at most one. A row's place depends only on the seed, its
partition and its position there, so a lost task redraws the same. If the input does not
show the same partitions in both passes (it is counted first), the job fails; with
`staged` it is written to the shared folder before. Reading files directly is stable.

Defined results: null texts count as empty, null ids and repeated rows are ordinary rows.
An empty table gives an empty result; fewer rows than shards leave shards empty. Input
columns named like result columns give way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import replace_columns, stage

BLOCK_ROWS = 1_000_000
BLOCK_BYTES = 64 << 20


def split_sizes(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by at most one, larger ones first."""
    return total // parts + (np.arange(parts) < total % parts).astype(np.int64)


def block_sizes(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, int]:
    """Sizes of all blocks, shard after shard, and the number of blocks in a shard."""
    per_shard = split_sizes(rows, shards)
    blocks = max(1, -(-int(per_shard.max(initial=0)) // block_rows))
    return np.concatenate([split_sizes(int(n), blocks) for n in per_shard]), blocks


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Number of good ones in a sample without replacement, for any population size.

    The distribution is summed up outwards from its mode until the rest is below what
    double precision can tell, then inverted.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(max(1.0, sample * (good / total) * (bad / total) * (total - sample) / max(1, total - 1)))
    reach = int(12 * spread) + 40
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right").clip(0, b - a))


def draw_split(rng: np.random.Generator, margins: np.ndarray, sample: int) -> np.ndarray:
    """How many of a sample of `sample` items fall to each colour of `margins`."""
    out = np.zeros_like(margins)
    rest = int(margins.sum())
    for i in np.flatnonzero(margins):
        rest -= int(margins[i])
        out[i] = draw_hypergeometric(rng, int(margins[i]), rest, sample)
        sample -= int(out[i])
        if not sample:
            break
    return out


def matrix_row(counts: Sequence[int], sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix, from the root of the tree down."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    low, high, margins = 0, len(counts), np.asarray(sizes, dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw_split(rng, margins, int(ends[middle] - ends[low]))
        if part < middle:
            high, margins = middle, left
        else:
            low, margins = middle, margins - left
    return margins


def _deal(df: DataFrame, counts: dict[int, int], sizes: np.ndarray, seed: int) -> DataFrame:
    """Add `_block` and a random `_key` to every row, without moving it."""
    parts = sorted(counts)
    sent = df.sparkSession.sparkContext.broadcast([counts[p] for p in parts])
    number = {p: i for i, p in enumerate(parts)} if parts != list(range(len(parts))) else None
    schema = T.StructType([*df.schema, T.StructField("_block", T.LongType()), T.StructField("_key", T.LongType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, keys, at = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if labels is None:
                own = TaskContext.get().partitionId()
                part = own if number is None else number.get(own)
                if part is None or part >= len(sent.value):
                    raise RuntimeError("the input's partitions changed between the passes")
                rng = np.random.default_rng([seed, 7, part])
                row = matrix_row(sent.value, sizes, part, seed)
                labels = rng.permutation(np.repeat(np.arange(len(row)), row))
                keys = rng.integers(0, 1 << 62, len(labels))
            upto = at + batch.num_rows
            if upto > len(labels):
                raise RuntimeError("the input's partitions changed between the passes")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels[at:upto]), pa.array(keys[at:upto])],
                names=[*batch.schema.names, "_block", "_key"])
            at = upto
        if labels is not None and at != len(labels):
            raise RuntimeError("the input's partitions changed between the passes")

    return df.mapInArrow(deal, schema)


def _number(df: DataFrame) -> DataFrame:
    """Add `_n`, a row's place (from 1) in its `_block`, to partitions that hold whole blocks.

    Unlike a window over blocks this moves no row again.
    """
    schema = T.StructType([*df.schema, T.StructField("_n", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(batch.schema.get_field_index("_block")).to_numpy()
            at = np.arange(len(block))
            starts = np.where(np.diff(block, prepend=block[0]) != 0, at, 0)
            place = at - np.maximum.accumulate(starts) + 1
            if block[0] == last:
                place[block == last] += n
            last, n = block[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place)], names=[*batch.schema.names, "_n"])

    return df.sortWithinPartitions("_block", "_key").mapInArrow(number, schema)


def shuffle_into_shards(
    docs: DataFrame, shards: int, seed: int = 17, block_rows: int = BLOCK_ROWS, staged: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns, plus `shard` (from 0) and `slot` (gapless from 0 in it)."""
    source = replace_columns(docs, {})
    source = source.drop("shard", "slot", "_block", "_key")
    if staged:
        source = stage(source, "shard-input")
    texts = [f.name for f in source.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    length = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in texts), F.lit(0)).cast("long")
    # One row per input partition comes back.
    found = source.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("bytes")).collect()
    counts = {r["p"]: r["n"] for r in found}
    rows = sum(counts.values())
    mean = sum(r["bytes"] for r in found) / max(1, rows)
    sizes, blocks = block_sizes(rows, shards, max(1, min(block_rows, int(block_bytes / max(mean, 1.0)))))
    dealt = _deal(source, counts, sizes, seed).repartitionById(len(sizes), F.col("_block").cast("int"))
    shard = F.floor(F.col("_block") / blocks)
    at = F.col("_block") - shard * blocks
    size = F.lit(rows // shards) + F.when(shard < rows % shards, 1).otherwise(0)
    before = at * F.floor(size / blocks) + F.least(at, size % blocks)
    return replace_columns(_number(dealt), {
        "shard": shard.cast("int"), "slot": (before + F.col("_n") - 1).cast("long"),
    }).drop("_block", "_key", "_n")
