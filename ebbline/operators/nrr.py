"""Net revenue retention from a panel of customer-months.

The panel has `customer_id`, `month` (counted per customer) and `mrr`. What
became of each row in the following month is read with one window over the
customer's own few months, instead of joining the panel with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.scalars import ratio

MOVEMENTS = ["starting_mrr", "expansion_mrr", "contraction_mrr", "churned_mrr", "ending_mrr", "nrr"]


def _next_month(panel: DataFrame, by: Sequence[str]) -> DataFrame:
    """Panel rows, one per customer and month, with the following row's figures."""
    keys = [*by, "customer_id"]
    once = panel.groupBy(*keys, "month").agg(F.sum("mrr").alias("mrr"))
    own = Window.partitionBy(*keys).orderBy("month")
    return once.withColumns(
        {"next_month": F.lead("month").over(own), "next_mrr": F.lead("mrr").over(own)}
    )


def nrr_by_month(
    panel: DataFrame, by: Sequence[str] = (), observed_until: str | None = None
) -> DataFrame:
    """Starting, expansion, contraction, churned and ending MRR and NRR per month.

    A customer without a row in the month after counts as churned there. With
    `observed_until`, a panel column holding the last month a still active
    customer was observed, such a customer leaves without counting as churn or
    as starting revenue. The first month starts with its own revenue; a month
    whose predecessor is missing starts with nothing and has no NRR.
    """
    rows = _next_month(panel, by)
    stays = F.col("next_month") == F.col("month") + 1
    change = F.when(stays, F.col("next_mrr") - F.col("mrr"))
    gone = F.when(stays, F.lit(0.0)).otherwise(F.col("mrr"))
    carried = F.col("mrr")
    if observed_until is not None:
        keys = [*by, "customer_id"]
        ends = panel.groupBy(*keys).agg(F.max(observed_until).alias("_until"))
        rows = rows.join(ends, keys, "left")
        censored = ~F.coalesce(stays, F.lit(False)) & (F.col("month") >= F.col("_until"))
        censored = F.coalesce(censored, F.lit(False))
        gone = F.when(censored, F.lit(0.0)).otherwise(gone)
        carried = F.when(censored, F.lit(0.0)).otherwise(carried)
    totals = rows.groupBy(*by, "month").agg(
        F.sum("mrr").alias("ending_mrr"),
        F.sum(carried).alias("_start"),
        F.sum(F.when(change > 0, change).otherwise(0.0)).alias("_up"),
        F.sum(F.when(change < 0, -change).otherwise(0.0)).alias("_down"),
        F.sum(gone).alias("_gone"),
    )
    # One row per group and month from here on.
    months = Window.partitionBy(*by).orderBy("month")
    follows = F.lag("month").over(months) == F.col("month") - 1
    is_first = F.row_number().over(months) == 1

    def from_previous(name: str):
        return F.when(follows, F.lag(name).over(months)).otherwise(F.lit(0.0))

    moved = totals.select(
        *by,
        "month",
        F.when(is_first, F.col("ending_mrr")).otherwise(from_previous("_start")).alias("starting_mrr"),
        from_previous("_up").alias("expansion_mrr"),
        from_previous("_down").alias("contraction_mrr"),
        from_previous("_gone").alias("churned_mrr"),
        "ending_mrr",
    )
    kept = (
        F.col("starting_mrr") + F.col("expansion_mrr")
        - F.col("contraction_mrr") - F.col("churned_mrr")
    )
    return moved.withColumn(
        "nrr", F.when(F.col("starting_mrr") > 0, ratio(kept, "starting_mrr"))
    )


def observed_panel(panel: DataFrame, customers: DataFrame, event: str = "churned") -> DataFrame:
    """The panel with `observed_until`: the last month of a customer who has not churned.

    It is null for customers who have churned or are unknown, whose last month ends in churn.
    """
    # Merged first, so that a customer with a great many billing rows is a few months.
    monthly = panel.groupBy("customer_id", "month").agg(F.sum("mrr").alias("mrr"))
    own = Window.partitionBy("customer_id")
    known = monthly.join(customers.select("customer_id", F.col(event).alias("_event")), "customer_id", "left")
    return known.withColumn(
        "observed_until", F.when(F.col("_event") == 0, F.max("month").over(own))
    ).drop("_event")


def nrr_by_segment(panel: DataFrame, customers: DataFrame, segment: str) -> DataFrame:
    """NRR per customer segment; customers without a segment are left out."""
    # Rows per customer are merged before the join, so that a customer with a
    # great many billing rows does not gather in one task.
    monthly = panel.groupBy("customer_id", "month").agg(F.sum("mrr").alias("mrr"))
    labelled = monthly.join(
        customers.select("customer_id", segment).where(F.col(segment).isNotNull()), "customer_id"
    )
    return nrr_by_month(labelled, [segment])


def nrr_summary(nrr: DataFrame, window: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median NRR and summed movements over the last months."""
    newest = Window.partitionBy(*by).orderBy(F.desc("month"))
    return (
        nrr.where(F.col("nrr").isNotNull())
        .withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= window)
        .groupBy(*by)
        .agg(
            F.avg("nrr").alias("avg_nrr"),
            F.median("nrr").alias("median_nrr"),
            F.sum("expansion_mrr").alias("total_expansion_mrr"),
            F.sum("contraction_mrr").alias("total_contraction_mrr"),
            F.sum("churned_mrr").alias("total_churned_mrr"),
            F.count(F.lit(1)).alias("months_in_window"),
        )
    )


def mrr_bridge(nrr: DataFrame, month: int | None = None) -> DataFrame:
    """Steps from starting to ending MRR of one month, by default the median one."""
    if month is None:
        valid = nrr.where(F.col("nrr").isNotNull())
        chosen = valid.agg(F.floor(F.median("month")).cast("int")).scalar()
    else:
        chosen = F.lit(month)
    step = lambda position, name, amount: F.struct(
        F.lit(position).alias("step"), F.lit(name).alias("component"), amount.alias("amount")
    )
    start, up = F.col("starting_mrr"), F.col("expansion_mrr")
    down, gone = F.col("contraction_mrr"), F.col("churned_mrr")
    steps = F.array(
        step(1, "Starting MRR", start),
        step(2, "Expansion", up),
        step(3, "Contraction", -down),
        step(4, "Churned", -gone),
        step(5, "Ending MRR", start + up - down - gone),
    )
    return nrr.where(F.col("month") == chosen).select("month", F.inline(steps)).orderBy("step")


def label_events(panel: DataFrame) -> DataFrame:
    """Name what happened in each customer-month.

    `churn` marks a row without a successor in the next month although the
    panel goes on; otherwise the change against the customer's previous row
    decides between `expansion`, `contraction` and `active`.
    """
    rows = _next_month(panel, [])
    own = Window.partitionBy("customer_id").orderBy("month")
    last = panel.agg(F.max("month")).scalar()
    before = F.lag("mrr").over(own)
    leaves = (F.col("month") < last) & ~F.coalesce(
        F.col("next_month") == F.col("month") + 1, F.lit(False)
    )
    event = (
        F.when(leaves, "churn")
        .when(F.col("mrr") > before, "expansion")
        .when(F.col("mrr") < before, "contraction")
        .otherwise("active")
    )
    return rows.withColumn("event", event).select("customer_id", "month", "mrr", "event")
