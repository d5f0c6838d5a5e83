"""Churn rates and revenue at risk over the customer table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.scalars import REPORT_BANDS, band, percent, rounded


OUTSIDE = "outside"  # label of rows that no band holds


def churn_rate_pct() -> Column:
    return rounded(F.avg("churned") * 100, 2).alias("churn_rate_pct")


def active(subs: DataFrame) -> DataFrame:
    return subs.where(F.col("churned") == 0)


def churned(subs: DataFrame) -> DataFrame:
    return subs.where(F.col("churned") == 1)


def overall_churn(subs: DataFrame) -> DataFrame:
    """Size, churn rate, average charge and MRR of the whole base."""
    return subs.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("churned").alias("churned_customers"),
        churn_rate_pct(),
        rounded(F.avg("monthly_charges"), 2).alias("avg_monthly_charges"),
        rounded(F.sum("monthly_charges"), 0).alias("total_mrr"),
    )


def churn_by(subs: DataFrame, dims: Sequence[str | Column]) -> DataFrame:
    """Churn rate and average charge per combination of dimensions."""
    return (
        subs.groupBy(*dims)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("churned").alias("churned"),
            churn_rate_pct(),
            rounded(F.avg("monthly_charges"), 2).alias("avg_monthly_charges"),
        )
        .orderBy(F.desc("churn_rate_pct"))
    )


def churn_by_band(
    subs: DataFrame, bands: dict = REPORT_BANDS, column: str = "tenure",
    keep_empty: bool = False,
) -> DataFrame:
    """Churn rate per band of a numeric column, in the order of the labels.

    Rows outside every band, and those without a value, are counted as OUTSIDE.
    `keep_empty` also lists bands without customers.
    """
    name = f"{column}_band"
    labels = [*bands["labels"], *([bands["else_label"]] if bands.get("else_label") else [])]
    labels.append(OUTSIDE)
    report = churn_by(subs, [F.coalesce(band(column, **bands), F.lit(OUTSIDE)).alias(name)])
    if keep_empty:
        domain = subs.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")
        report = domain.join(report, name, "left").fillna(0, ["customers", "churned"])
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(name))
    return report.orderBy(position)


def churn_grouping_sets(subs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Overall churn and churn by each dimension, from one scan.

    `dimension` names the column a row is grouped by ('all' for the total).
    """
    picked = F.posexplode(F.array(F.lit("all"), *[F.col(d).cast("string") for d in dims]))
    names = F.array(F.lit("all"), *[F.lit(d) for d in dims])
    long = subs.select("churned", "monthly_charges", picked.alias("_i", "value"))
    return churn_by(
        long.withColumn("dimension", names[F.col("_i")]), ["dimension", "value"]
    ).orderBy("dimension", "value")


def revenue_at_risk(subs: DataFrame, segment: str = "contract") -> DataFrame:
    """MRR lost to churned customers per segment, and its share."""
    lost = F.sum(F.when(F.col("churned") == 1, F.col("monthly_charges")).otherwise(0))
    total = F.sum("monthly_charges")
    return (
        subs.groupBy(segment)
        .agg(
            lost.alias("churned_mrr"),
            total.alias("total_mrr"),
            rounded(percent(lost, total), 2).alias("pct_mrr_at_risk"),
        )
        .orderBy(F.desc("churned_mrr"))
    )


def top_churned(subs: DataFrame, limit: int = 20) -> DataFrame:
    """Churned customers with the highest charges; ties go to the lower id."""
    return (
        churned(subs)
        .select(
            "customer_id", "contract", "tenure", "monthly_charges", "internet_service",
            "tech_support", "online_security",
        )
        .orderBy(F.desc("monthly_charges"), "customer_id")
        .limit(limit)
    )
