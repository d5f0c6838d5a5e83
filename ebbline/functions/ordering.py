"""Exact global order statistics without pulling the data into one task.

A window without `partitionBy` sorts everything in a single task. Here the rows
are range-partitioned on the full ordering key, sorted inside each partition
and checkpointed; only one total per block is then combined. Range bounds are
sampled, so the layout has to be made durable before it is read twice: a lost
executor must not redraw them. A hot value does not overload a block, because
equal values are either collapsed to one counted row or split by the
tie-breaking key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.staging import ensure_checkpoint_dir

BLOCK_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def range_layout(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Globally ordered blocks, with `_pos` (position) and `_block` (number)."""
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_block", F.shiftright("_pos", BLOCK_BITS))
    )


def block_offsets(
    layout: DataFrame, totals: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Sum of each total over all earlier blocks (of the same group)."""
    per_block = layout.groupBy(*by, "_block").agg(*[e.alias(n) for n, e in totals.items()])
    before = (
        Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_block.withColumns(
        {f"_before_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in totals}
    )


def _with_offsets(layout: DataFrame, offsets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bring the small table of block offsets to the rows without moving them."""
    return attach_lookup(layout, offsets, [*by, "_block"], "inner")


def global_row_number(
    df: DataFrame, order_by: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """Row number over the whole frame; end `order_by` with a unique key."""
    layout = range_layout(df, order_by)
    offsets = block_offsets(layout, {"n": F.count(F.lit(1))}).select("_block", "_before_n")
    local = F.col("_pos") - F.shiftleft(F.col("_block"), BLOCK_BITS) + 1
    return (
        _with_offsets(layout, offsets)
        .withColumn(name, F.col("_before_n") + local)
        .drop("_block", "_pos", "_before_n")
    )


def ntile_of(row_number: Column, total: Column, tiles: int) -> Column:
    """SQL NTILE from a row number: the first `total % tiles` tiles are longer."""
    total = total.cast("long")
    small = F.floor(total / tiles)
    longer = total % tiles
    in_longer = longer * (small + 1)
    return F.when(
        row_number <= in_longer, F.floor((row_number - 1) / (small + 1)) + 1
    ).otherwise(
        longer + F.floor(F.try_divide(row_number - in_longer - 1, small)) + 1
    ).cast("int")


def running_sums(
    df: DataFrame, order_by: Sequence[Column], columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums of `columns`, added as `cum_<column>`."""
    keys = [F.col(c) for c in by] + list(order_by)
    layout = range_layout(df, keys)
    offsets = block_offsets(layout, {c: F.sum(c) for c in columns}, by).drop(*columns)
    inside = (
        Window.partitionBy(*by, "_block")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = layout.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in columns})
    return (
        _with_offsets(summed, offsets, by)
        .withColumns({f"cum_{c}": F.col(f"_in_{c}") + F.col(f"_before_{c}") for c in columns})
        .drop("_block", "_pos", *[f"_in_{c}" for c in columns], *[f"_before_{c}" for c in columns])
    )


def values_at_ranks(
    df: DataFrame, value: str, ranks: Column, by: Sequence[str] = ()
) -> DataFrame:
    """The values found at given 0-based ranks, per group.

    `ranks` is an array of positions computed from the group's row count `n`.
    Returns one row per group with `n` and `ranked`, a map from rank to value.
    Equal values travel as one counted row, so only distinct values are sorted.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    layout = range_layout(counted, [*[F.col(c) for c in by], F.col("_value")])
    blocks = block_offsets(layout, {"_count": F.sum("_count")}, by)
    before = F.col("_before__count")
    inside_block = lambda rank: (rank >= before) & (rank < before + F.col("_count"))
    wanted = (
        blocks.withColumn("n", F.sum("_count").over(Window.partitionBy(*by)))
        .withColumn("_ranks", F.filter(F.array_distinct(ranks), inside_block))
        .where(F.size("_ranks") > 0)
        .select(*by, "_block", "_before__count", "n", "_ranks")
    )
    # Only the blocks that hold a wanted rank are walked in order.
    position = (
        Window.partitionBy(*by, "_block")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        _with_offsets(layout, wanted, by)
        .withColumn("_end", F.col("_before__count") + F.sum("_count").over(position))
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_count")))
    )
    return found.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("ranked"),
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Adds `n` (non-null rows) and `quantiles`, an array in the order of
    `probabilities`.
    """

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("n") - 1)

    ranks = F.array(
        *[f(position(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]
    )
    at = values_at_ranks(df, value, ranks, by)

    def interpolated(p: float) -> Column:
        low, high = F.floor(position(p)).cast("long"), F.ceil(position(p)).cast("long")
        below, above = F.col("ranked")[low], F.col("ranked")[high]
        return below + (above - below) * (position(p) - low)

    return at.select(
        *by, "n", F.array(*[interpolated(p) for p in probabilities]).alias("quantiles")
    )
