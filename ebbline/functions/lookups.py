"""Joining a large frame with a small aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ebbline.functions.staging import stage


def attach_lookup(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join `df` with a per-segment aggregate.

    The aggregate is computed once, into a staged file. The planner knows that file's size:
    below its broadcast threshold every task reads it and `df` is not shuffled, beyond it
    the join is shuffled and adaptive execution splits skewed keys.
    """
    return df.join(stage(lookup, "lookup"), list(on), how)
