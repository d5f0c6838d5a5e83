"""Customer retention by sign-up cohort.

Nobody is paired with every offset they reached. Customers are counted per
cohort and tenure, and a suffix sum over that small table says how many were
still there at each offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.grids import add_zero_rows
from ebbline.functions.scalars import month_label, month_start, ratio, rounded

MIN_HISTORY = 12


def _reached(
    subs: DataFrame, by: Sequence[str], last_offset: int | None, value: str | None = None
) -> DataFrame:
    """Customers (and their summed value) that reached each offset, per group.

    Offsets run from 0 to the longest tenure of the group, or to `last_offset`
    where a report ends there. Customers without a tenure count in the size only.
    """
    capped = F.col("tenure")
    if last_offset is not None:
        capped = F.least(capped, F.lit(last_offset))
    offset = F.when(F.col("tenure") >= 0, capped).otherwise(-1)
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    stopped = subs.groupBy(*by, offset.alias("month_offset")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_amount")
    )
    longest = F.max("month_offset").over(Window.partitionBy(*by))
    dense = add_zero_rows(stopped, by, "month_offset", longest, ["_n", "_amount"])
    whole = Window.partitionBy(*by)
    later = whole.orderBy(F.desc("month_offset")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return dense.select(
        *by,
        "month_offset",
        F.sum("_n").over(whole).alias("size"),
        F.sum("_amount").over(whole).alias("size_amount"),
        F.sum("_n").over(later).alias("active"),
        F.sum("_amount").over(later).alias("active_amount"),
    ).where(F.col("month_offset") >= 0)


def cohort_table(subs: DataFrame, last_offset: int | None = None) -> DataFrame:
    """Size, active customers and retention rate per cohort and offset."""
    cohorts = subs.where(F.col("signup_date").isNotNull()).withColumn(
        "_month", month_start("signup_date")
    )
    return _reached(cohorts, ["_month"], last_offset).select(
        month_label("_month").alias("cohort"),
        "month_offset",
        F.col("size").alias("cohort_size"),
        F.col("active").alias("active_customers"),
        ratio("active", "size").alias("retention_rate"),
    )


def mature_cohorts(cohorts: DataFrame, max_offset: int = 24) -> DataFrame:
    """Offsets up to `max_offset` of the cohorts with enough of them."""
    shown = cohorts.where(F.col("month_offset") <= max_offset)
    known = F.count("retention_rate").over(Window.partitionBy("cohort"))
    return shown.withColumn("_known", known).where(F.col("_known") >= MIN_HISTORY).drop("_known")


def pivot_retention(cohorts: DataFrame, max_offset: int = 24) -> DataFrame:
    """One row per cohort, retention at offset n in column `m<n>`."""
    offsets = list(range(max_offset + 1))
    wide = (
        mature_cohorts(cohorts, max_offset)
        .groupBy("cohort")
        .pivot("month_offset", offsets)
        .agg(F.first("retention_rate"))
    )
    return wide.withColumnsRenamed({str(n): f"m{n}" for n in offsets}).orderBy("cohort")


def retention_milestones(
    cohorts: DataFrame, offsets: Sequence[int] = (1, 3, 6, 12), max_offset: int = 24
) -> DataFrame:
    """Unweighted mean retention over the cohorts at chosen offsets."""
    return (
        mature_cohorts(cohorts, max_offset)
        .where(F.col("month_offset").isin(list(offsets)))
        .groupBy("month_offset")
        .agg(F.count("retention_rate").alias("cohorts"), F.avg("retention_rate").alias("avg_retention"))
        .orderBy("month_offset")
    )


def latest_cohort_curves(cohorts: DataFrame, n_cohorts: int = 8, max_offset: int = 24) -> DataFrame:
    """Retention curves of the most recent mature cohorts."""
    # One row per cohort and offset, so ranking the cohorts is a small job.
    age = F.dense_rank().over(Window.partitionBy().orderBy(F.desc("cohort")))
    return (
        mature_cohorts(cohorts, max_offset)
        .withColumn("_age", age)
        .where(F.col("_age") <= n_cohorts)
        .select("cohort", "month_offset", "retention_rate")
    )


def cohort_sizes(subs: DataFrame) -> DataFrame:
    """Size, ARPU and eventual churn rate per sign-up month."""
    return (
        subs.groupBy("signup_month")
        .agg(
            F.count(F.lit(1)).alias("cohort_size"),
            rounded(F.avg("monthly_charges"), 2).alias("avg_arpu"),
            rounded(F.avg("churned") * 100, 2).alias("eventual_churn_rate_pct"),
        )
        .orderBy("signup_month")
    )


def cohort_retention(subs: DataFrame, last_offset: int = 24) -> DataFrame:
    """Customers still active and retention in percent per sign-up month."""
    return _reached(subs, ["signup_month"], last_offset).select(
        "signup_month",
        "month_offset",
        F.col("size").alias("cohort_size"),
        F.col("active").alias("still_active"),
        rounded(ratio("active", "size") * 100, 1).alias("retention_pct"),
    ).where(F.col("still_active") > 0)


def average_retention(subs: DataFrame, last_offset: int = 24) -> DataFrame:
    """Retention in percent of the whole base at each offset."""
    base = subs.withColumn("_base", F.lit(0))
    return _reached(base, ["_base"], last_offset).where(F.col("active") > 0).select(
        "month_offset",
        F.col("active").alias("still_active"),
        rounded(ratio("active", "size") * 100, 1).alias("avg_retention_pct"),
    ).orderBy("month_offset")


def revenue_retention(subs: DataFrame, last_offset: int = 24) -> DataFrame:
    """Cohort retention weighted by monthly charges."""
    return _reached(subs, ["signup_month"], last_offset, "monthly_charges").where(
        F.col("active") > 0
    ).select(
        "signup_month",
        "month_offset",
        F.col("size_amount").alias("cohort_mrr"),
        F.col("active_amount").alias("retained_mrr"),
        rounded(ratio("active_amount", "size_amount") * 100, 1).alias("revenue_retention_pct"),
    )
