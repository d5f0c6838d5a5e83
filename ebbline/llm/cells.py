"""Overlapping cluster cells of bounded size for vectors of any number, and tasks per cell.

A group starts as one cell. Cells above the limit are split around centres that are learned
from a sample of them of bounded expected size (`SAMPLE` rows, picked by hash); each vector
goes to its nearest centre and its home membership also to the next nearest (`overlap` in
all), until no cell is above the limit. A hot group is thereby split like any other, and the number of
rounds is the logarithm of its size. Nothing but the decision to go on reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.llm.common import stage

SAMPLE = 1024   # expected rows that the centres of a cell are learned from
FAN = 32        # most centres of a cell
SALT = 65_536   # rows of one cell that one task assigns
ROUNDS = 60
PARTS = 32      # parts of a cell whose vectors all have one direction

MEMBER = "id bigint, cell string, home boolean, r double, v array<double>"
NAMES = ["id", "cell", "home", "r", "v"]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` unit centres: farthest points first, then a few rounds of averaging."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, sample @ sample[far])
    centres = sample[chosen]
    for _ in range(4):
        owner = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def _learn(sampled: DataFrame, limit: int, overlap: int) -> DataFrame:
    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        cell, n = table.column("cell")[0].as_py(), table.column("n")[0].as_py()
        found = _centres(matrix(table.column("v")), max(2, min(FAN, -(-3 * overlap * n // (2 * limit)))))
        return pa.table({"cell": [cell], "centres": [found.ravel().tolist()]}, schema=pa.schema(
            [("cell", pa.string()), ("centres", pa.list_(pa.float64()))]))

    return sampled.groupBy("cell").applyInArrow(learn, "cell string, centres array<double>")


def _assign(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, salt, kind): the cell's centres first, then its members."""
    centres, at = None, None
    for batch in batches:
        cells, salts, kinds = (batch.column(i).to_pylist() for i in range(3))
        keys = list(zip(cells, salts, kinds))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            run = batch.slice(a, b - a)
            if kinds[a] == 0:
                centres, at = np.array(run.column(6)[0].as_py()), keys[a][:2]
                continue
            if at != keys[a][:2]:
                raise RuntimeError("members without their centres")
            vectors, home = matrix(run.column(6)), run.column(4).to_numpy(zero_copy_only=False).astype(bool)
            own = centres.reshape(-1, vectors.shape[1])
            if len(own) == 1:  # a cell of one direction: dealt by number
                names = [f"{cells[a]}/={i % PARTS}" for i in run.column(3).to_pylist()]
                yield _members(run, names, home)
                continue
            order = np.argsort(-(vectors @ own.T), axis=1, kind="stable")
            yield _members(run, [f"{cells[a]}/{c}" for c in order[:, 0]], home)
            both = np.flatnonzero(home)
            for nth in range(1, min(overlap, len(own))):
                yield _members(
                    run.take(pa.array(both)), [f"{cells[a]}/{c}" for c in order[both, nth]], np.zeros(len(both), bool))


def _members(run: pa.RecordBatch, cells: list[str], home: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [run.column(3), pa.array(cells, pa.string()), pa.array(home), run.column(5), run.column(6)], names=NAMES)


def overlapping_cells(vectors: DataFrame, limit: int, overlap: int = 2) -> DataFrame:
    """`id, cell, home, r, v` for unit vectors `id, group, r, v`: memberships of every vector.

    Each vector has one membership with `home`, and `overlap` - 1 more for each round of its
    splits. A group within the limit is one cell. Cells never mix groups.
    """
    current = stage(vectors.select("id", F.col("group").cast("string").alias("cell"), F.lit(True).alias("home"), "r", "v"), "cells")
    done: list[DataFrame] = []
    for round_ in range(ROUNDS):
        sizes = stage(current.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit), "cell-sizes")
        if sizes.isEmpty():
            break
        large = attach_lookup(current, sizes, ["cell"])
        done.append(large.where("n IS NULL").select("id", "cell", "home", "r", "v"))
        large = large.where("n IS NOT NULL")
        drawn = F.pmod(F.xxhash64("id", F.lit(round_)), F.lit(1 << 30)).cast("double")
        share = drawn * F.col("n") < float(SAMPLE << 30)
        centres = _learn(large.where(share), limit, overlap)
        salts = F.ceil(F.col("n") / SALT).cast("int")
        spread = centres.join(sizes, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("home"),
            F.lit(None).cast("double").alias("r"), F.col("centres").alias("v"))
        members = large.select(
            "cell", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "home", "r", "v")
        current = stage(
            spread.unionByName(members).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "id")
            .mapInArrow(lambda batches: _assign(batches, overlap), MEMBER), "cells")
    else:
        raise RuntimeError("cells did not reach the limit")
    out = current
    for frame in done:
        out = out.unionByName(frame)
    return out


def per_cell(frame: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` on the rows of each cell, one cell in memory at a time."""
    return frame.groupBy("cell").applyInArrow(work, schema)
