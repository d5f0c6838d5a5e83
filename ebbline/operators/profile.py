"""Describing a table: missing values, distributions, correlations, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.ordering import exact_quantiles
from ebbline.functions.scalars import percent, ratio, rounded


def numeric_columns(df: DataFrame, limit: int | None = None) -> list[str]:
    """Names of the numeric columns, in schema order."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return names if limit is None else names[:limit]


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys of a table, to show that none is doubled."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("distinct_keys")
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with nulls: how many, and their share in percent. One pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    return (
        counts.unpivot(["_n"], df.columns, "column_name", "missing_count")
        .where(F.col("missing_count") > 0)
        .select(
            "column_name", "missing_count",
            rounded(percent("missing_count", "_n"), 2).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share in percent of every value of a column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("customers")
    )
    total = counts.agg(F.sum("customers")).scalar()
    return counts.withColumn("pct", rounded(percent("customers", total), 2)).orderBy(
        F.desc("customers"), column
    )


def describe_columns(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row per column: counts, most frequent text, moments and quartiles."""
    none = lambda kind: F.lit(None).cast(kind)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        [], list(numeric), "column_name", "value"
    )
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("n_values"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column_name"]).select(
        "column_name",
        *[F.col("quantiles")[i].alias(q) for i, q in enumerate(["p25", "p50", "p75"])],
    )
    numbers = moments.join(quartiles, "column_name", "left").select(
        "column_name", "n_values", none("long").alias("n_unique"), none("string").alias("top"),
        none("long").alias("freq"), "mean", "std", "min", "p25", "p50", "p75", "max",
    )
    values = (
        df.select(*[F.col(c).cast("string").alias(c) for c in text])
        .unpivot([], list(text), "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    texts = values.groupBy("column_name").agg(
        F.sum("_n").alias("n_values"),
        F.count(F.lit(1)).alias("n_unique"),
        F.min_by("value", F.struct(-F.col("_n"), F.col("value"))).alias("top"),
        F.max("_n").alias("freq"),
        *[none("double").alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]],
    )
    return numbers.unionByName(texts)


#: Sums over the rows in which both columns of a pair have a value.
PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy", "odd"]
#: Deviations this small, against their squared sum, are rounding of a constant column.
CONSTANT = 1e-13


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition for each pair of columns, from products of matrices."""
    total = None
    for batch in batches:
        present = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
        values = np.column_stack([
            c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
        # Infinite values and NaN are counted, as they would spoil the sums of other pairs.
        odd = (~np.isfinite(values)).astype(float)
        values[odd > 0] = 0.0
        mask, squares = present.astype(float), values * values
        n, sx, sxx, sxy = mask.T @ mask, values.T @ mask, squares.T @ mask, values.T @ values
        spoiled = odd.T @ mask
        found = np.stack([n, sx, sx.T, sxx, sxx.T, sxy, spoiled + spoiled.T])
        total = found if total is None else total + found
    if total is None:
        return
    left, right = np.triu_indices(total.shape[1], 1)
    sums = [pa.array(m[left, right]) for m in total]
    yield pa.RecordBatch.from_arrays(
        [pa.array(left.astype("int32")), pa.array(right.astype("int32")), *sums], ["l", "r", *PAIR_SUMS])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, over rows that have both values.

    Each partition multiplies its rows' matrix with itself and passes on one row of sums per
    pair, so the plan and its generated code do not grow with the number of pairs. Values are
    taken from the column's mean first, so that large values with a small spread keep their
    digits. A pair without two different values on each side has none; a NaN or an infinite
    value among its rows makes it NaN.
    """
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "left_column string, right_column string, correlation double")
    numbers = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    means = numbers.agg(*[F.avg(finite(F.col(c))).alias(c) for c in numbers.columns]).first()
    shifted = numbers.select(*[(F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in numbers.columns])
    schema = "l int, r int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    sums = shifted.mapInArrow(_pair_sums, schema).groupBy("l", "r").agg(
        *[F.sum(c).alias(c) for c in PAIR_SUMS])

    def spread(square: str, plain: str) -> Column:
        left = F.col(square) - ratio(F.col(plain) * F.col(plain), "n")
        return F.when(left > F.col(square) * CONSTANT, left)

    shared = F.col("sxy") - ratio(F.col("sx") * F.col("sy"), "n")
    found = shared / (F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy")))
    measured = sums.select("l", "r", F.when(F.col("odd") > 0, float("nan")).otherwise(
        F.when(found > 1, 1.0).when(found < -1, -1.0).otherwise(found)).alias("_c"))
    named = lambda i: F.element_at(F.array(*map(F.lit, names)), F.col(i) + 1)
    pairs = df.sparkSession.range(len(names) * len(names)).select(
        F.floor(F.col("id") / len(names)).cast("int").alias("l"),
        (F.col("id") % len(names)).cast("int").alias("r")).where("l < r")
    # A table without rows has every pair, without a correlation.
    return pairs.join(measured, ["l", "r"], "left").select(
        named("l").alias("left_column"), named("r").alias("right_column"), F.col("_c").alias("correlation"))


def histogram(
    df: DataFrame, column: str, bins: int, group: str | None = None
) -> DataFrame:
    """Counts in equal-width bins between the column's minimum and maximum."""
    known = df.where(F.col(column).isNotNull())
    limits = known.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    keys = ["bucket"] + ([group] if group else [])
    width = (F.col("_limits.hi") - F.col("_limits.lo")) / bins
    position = F.floor(F.try_divide(F.col(column) - F.col("_limits.lo"), width))
    counted = (
        known.withColumn("_limits", limits)
        .withColumn("bucket", F.coalesce(F.least(position, F.lit(bins - 1)), F.lit(0)).cast("int"))
        .groupBy(*keys, "_limits")
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    return counted.select(
        *keys,
        (F.col("_limits.lo") + F.col("bucket") * width).alias("bucket_from"),
        (F.col("_limits.lo") + (F.col("bucket") + 1) * width).alias("bucket_to"),
        "customers",
    ).orderBy(*keys)


def segment_average(df: DataFrame, segment: str, value: str) -> DataFrame:
    return (
        df.groupBy(segment)
        .agg(F.count(F.lit(1)).alias("customers"), F.avg(value).alias(f"avg_{value}"))
        .orderBy(F.desc(f"avg_{value}"))
    )
