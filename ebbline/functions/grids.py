"""Filling the gaps of small per-group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_zero_rows(
    df: DataFrame, by: Sequence[str], position: str, last: Column, values: Sequence[str]
) -> DataFrame:
    """One row per group and whole position from 0 to `last`, gaps filled with 0.

    `df` is an aggregate with one row per group and position. The first row of
    each group brings the zero rows along, so the aggregate is read only once.
    """
    kind = {f.name: f.dataType for f in df.schema}
    own = F.struct(position, *values)
    zeros = F.transform(
        F.sequence(F.lit(0), F.greatest(last.cast("int"), F.lit(0))),
        lambda x: F.struct(
            x.cast(kind[position]).alias(position),
            *[F.lit(0).cast(kind[v]).alias(v) for v in values],
        ),
    )
    layout = ",".join(f"{c}:{kind[c].simpleString()}" for c in [position, *values])
    nothing = F.array().cast(f"array<struct<{layout}>>")
    is_first = F.row_number().over(Window.partitionBy(*by).orderBy(position)) == 1
    return (
        df.withColumn("_extra", F.when(is_first, zeros).otherwise(nothing))
        .select(*by, F.inline(F.concat(F.array(own), F.col("_extra"))))
        .groupBy(*by, position)
        .agg(*[F.sum(v).alias(v) for v in values])
    )
