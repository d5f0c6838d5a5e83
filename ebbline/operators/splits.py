"""Repeatable splits of a table: by order, by stratum, into folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import values_at_ranks


def mark_first_share(
    df: DataFrame, order_by: Sequence[str], fraction: float, name: str = "in_first"
) -> DataFrame:
    """Add whether a row belongs to the earliest share of the rows.

    `order_by` has to end with a unique key. Only these columns are put in
    order, to find the first key of the second part; the rows are then marked by
    comparing with it.
    """
    key = F.struct(*order_by)
    rank = F.floor(F.col("n") * fraction).cast("long")
    cut = values_at_ranks(df.select(key.alias("_key")), "_key", F.array(rank)).select(
        F.col("ranked")[rank]
    )
    return df.withColumn("_cut", cut.scalar()).withColumn(
        name, F.coalesce(key < F.col("_cut"), F.lit(True))
    ).drop("_cut")


def split_by_fraction(
    df: DataFrame, order_by: Sequence[str], fraction: float
) -> tuple[DataFrame, DataFrame]:
    """The earliest share of the rows, and the rest; see mark_first_share()."""
    marked = mark_first_share(df, order_by, fraction, "_first")
    part = lambda flag: marked.where(flag).drop("_first")
    return part(F.col("_first")), part(~F.col("_first"))


def _shuffle_key(id_column: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_column), F.lit(seed))


def stratified_folds(
    df: DataFrame, folds: int, label: str = "label", id_column: str = "customer_id",
    seed: int = 42, name: str = "fold",
) -> DataFrame:
    """Fold number per row; every label is spread over the folds evenly.

    Rows are put in the order of a hash of their id. Only the cut points of
    that order are looked up, so the rows themselves are not ranked.
    """
    keyed = df.withColumn("_key", _shuffle_key(id_column, seed))
    ranks = F.array(*[
        (F.floor(F.col("n") * k / folds)).cast("long") for k in range(1, folds)
    ])
    cuts = values_at_ranks(keyed, "_key", ranks, [label]).select(
        label, F.array(*[F.col("ranked")[ranks[k]] for k in range(folds - 1)]).alias("_cuts")
    )
    passed = F.aggregate(
        "_cuts", F.lit(0), lambda acc, cut: acc + (F.col("_key") >= cut).cast("int")
    )
    return attach_lookup(keyed, cuts, [label]).withColumn(name, passed).drop("_key", "_cuts")


def stratified_split(
    df: DataFrame, test_size: float = 0.20, label: str = "label",
    id_column: str = "customer_id", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with the same share of every label."""
    keyed = df.withColumn("_key", _shuffle_key(id_column, seed))
    rank = F.least(F.ceil(F.col("n") * test_size), F.col("n") - 1).cast("long")
    cuts = values_at_ranks(keyed, "_key", F.array(rank), [label]).select(
        label, F.col("ranked")[rank].alias("_cut")
    )
    marked = attach_lookup(keyed, cuts, [label])
    in_test = F.col("_key") < F.col("_cut")
    return (
        marked.where(~in_test).drop("_key", "_cut"),
        marked.where(in_test).drop("_key", "_cut"),
    )
