"""MRR snapshot, split, concentration and the monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import block_offsets, exact_quantiles, ntile_of, range_layout
from ebbline.functions.scalars import percent, ratio, rounded
from ebbline.operators.churn_metrics import active
from ebbline.operators.mrr import calendar_totals


def mrr_snapshot(subs: DataFrame) -> DataFrame:
    """Current MRR, active customers, mean and median revenue per customer."""
    paying = active(subs)
    median = exact_quantiles(paying, "monthly_charges", [0.5]).select(F.col("quantiles")[0])
    return paying.agg(
        rounded(F.sum("monthly_charges"), 0).alias("current_mrr"),
        F.count(F.lit(1)).alias("active_customers"),
        rounded(F.avg("monthly_charges"), 2).alias("arpu"),
    ).withColumn("median_arpu", rounded(median.scalar(), 2))


def mrr_by(subs: DataFrame, segment: str) -> DataFrame:
    """Active customers, MRR, ARPU and share of MRR per segment."""
    per_segment = active(subs).groupBy(segment).agg(
        F.count(F.lit(1)).alias("active_customers"),
        F.sum("monthly_charges").alias("_mrr"),
        rounded(F.avg("monthly_charges"), 2).alias("arpu"),
    )
    # The window runs over one row per segment.
    total = F.sum("_mrr").over(Window.partitionBy())
    return (
        per_segment.withColumn("pct_of_total_mrr", rounded(percent("_mrr", total), 1))
        .select(
            segment, "active_customers", rounded("_mrr", 0).alias("mrr"), "arpu",
            "pct_of_total_mrr",
        )
        .orderBy(F.desc("mrr"))
    )


def mrr_series(subs: DataFrame, reference_date: str, max_months: int | None = None) -> DataFrame:
    """Active customers, MRR and ARPU per calendar month up to a reference date.

    A customer is active from the sign-up month for `tenure` months; a report may
    count the first `max_months` of them only.
    """
    first = F.col("signup_month")
    months = F.col("tenure")
    if max_months is not None:
        months = F.least(months, F.lit(max_months))
    totals = calendar_totals(subs, first, months, reference_date)
    return totals.select(
        "month",
        "active_customers",
        rounded("total_mrr", 0).alias("mrr"),
        rounded(ratio("total_mrr", "active_customers"), 2).alias("arpu"),
    ).orderBy("month")


def revenue_concentration(subs: DataFrame, tiles: int = 10) -> DataFrame:
    """Customers and MRR in equally sized tiles by descending charge.

    Customers with the same charge are interchangeable here, so the distinct
    charges are laid out with a count each and a charge that spans a tile
    boundary is split between the tiles it reaches into.
    """
    charges = (
        active(subs).groupBy("monthly_charges").agg(F.count(F.lit(1)).alias("_count"))
    )
    layout = range_layout(charges, [F.desc("monthly_charges")])
    blocks = block_offsets(layout, {"_count": F.sum("_count")})
    total = F.sum("_count").over(Window.partitionBy())  # one row per block
    inside = (
        Window.partitionBy("_block").orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    spans = (
        attach_lookup(
            layout.withColumn("_in", F.sum("_count").over(inside)),
            blocks.select("_block", "_before__count", total.alias("n")), ["_block"], "inner",
        )
        .withColumn("last", F.col("_before__count") + F.col("_in"))
        .withColumn("first", F.col("last") - F.col("_count") + 1)
    )
    per_tile = (
        spans.withColumn(
            "decile",
            F.explode(F.sequence(
                ntile_of(F.col("first"), F.col("n"), tiles),
                ntile_of(F.col("last"), F.col("n"), tiles),
            )),
        )
        # Rank range of the tile, to count how many of these customers it takes.
        .withColumn("_small", F.floor(F.col("n") / tiles))
        .withColumn("_longer", F.col("n") % tiles)
        .withColumn(
            "_tile_end",
            F.col("decile") * F.col("_small") + F.least(F.col("decile"), F.col("_longer")),
        )
        .withColumn(
            "_tile_start",
            (F.col("decile") - 1) * F.col("_small")
            + F.least(F.col("decile") - 1, F.col("_longer")) + 1,
        )
        .withColumn(
            "_members",
            F.least("last", "_tile_end") - F.greatest("first", "_tile_start") + 1,
        )
        .groupBy("decile")
        .agg(
            F.sum("_members").alias("customers"),
            F.sum(F.col("_members") * F.col("monthly_charges")).alias("_mrr"),
        )
    )
    share = percent("_mrr", F.sum("_mrr").over(Window.partitionBy()))
    return per_tile.select(
        "decile", "customers", rounded("_mrr", 0).alias("mrr"),
        rounded(share, 1).alias("pct_of_total_mrr"),
    ).orderBy("decile")
