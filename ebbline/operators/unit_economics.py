"""Unit economics that take one over the churn rate as the lifetime.

This is the quick estimate; `survival` holds the one that respects censoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.scalars import ratio, rounded


def _segment_churn(subs: DataFrame, segment: str) -> DataFrame:
    return subs.groupBy(segment).agg(F.avg("churned").alias("segment_churn_rate"))


def naive_unit_economics(
    subs: DataFrame, cac: float = 250.0, margin: float = 0.75, segment: str = "contract"
) -> DataFrame:
    """Lifetime, CLV, payback and LTV:CAC per segment."""
    profit = F.col("_charge") * margin
    clv = ratio(profit, "_rate")
    return (
        subs.groupBy(segment)
        .agg(F.avg("churned").alias("_rate"), F.avg("monthly_charges").alias("_charge"))
        .select(
            segment,
            rounded(F.col("_rate") * 100, 2).alias("churn_rate_pct"),
            rounded(ratio(F.lit(1.0), "_rate"), 1).alias("expected_lifetime_months"),
            rounded("_charge", 2).alias("avg_monthly_charges"),
            rounded(clv, 0).alias("avg_clv"),
            rounded(ratio(F.lit(cac), profit), 1).alias("payback_months"),
            rounded(clv / cac, 1).alias("ltv_cac_ratio"),
        )
        .orderBy(F.desc("avg_clv"))
    )


def naive_clv(
    subs: DataFrame, cac: float = 250.0, margin: float = 0.75, segment: str = "contract"
) -> DataFrame:
    """CLV, payback and LTV:CAC of every customer from their segment's churn rate.

    Left unsorted: ordering all customers is the caller's choice.
    """
    profit = F.col("monthly_charges") * margin
    clv = ratio(profit, "segment_churn_rate")
    return attach_lookup(subs, _segment_churn(subs, segment), [segment], "inner").select(
        "customer_id", segment, "monthly_charges", "tenure", "churned", "segment_churn_rate",
        rounded(clv, 0).alias("clv"),
        rounded(ratio(F.lit(cac), profit), 1).alias("payback_months"),
        rounded(clv / cac, 2).alias("ltv_cac_ratio"),
    )


def naive_health(
    subs: DataFrame, cac: float = 250.0, margin: float = 0.75, segment: str = "contract"
) -> DataFrame:
    """Average LTV:CAC and the shares of healthy and under-water customers."""
    joined = attach_lookup(subs, _segment_churn(subs, segment), [segment], "inner")
    value = ratio(F.col("monthly_charges") * margin, "segment_churn_rate") / cac
    share = lambda test: rounded(F.avg(F.when(test, 1.0).otherwise(0.0)) * 100, 1)
    return joined.withColumn("_ltv_cac", value).agg(
        rounded(F.avg("_ltv_cac"), 2).alias("avg_ltv_cac"),
        share(F.col("_ltv_cac") >= 3).alias("pct_healthy"),
        share(F.col("_ltv_cac") < 1).alias("pct_underwater"),
    )


def naive_churn_reduction(
    subs: DataFrame, segment_value: str, points: float = 0.10, floor: float = 0.01,
    margin: float = 0.75, segment: str = "contract",
) -> DataFrame:
    """CLV gained if one segment's churn rate fell by some points."""
    profit = F.col("_charge") * margin
    return (
        subs.where(F.col(segment) == segment_value)
        .agg(
            F.avg("churned").alias("_rate"),
            F.avg("monthly_charges").alias("_charge"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_reduced", F.greatest(F.col("_rate") - points, F.lit(floor)))
        .select(
            rounded(F.col("_rate") * 100, 1).alias("current_churn_pct"),
            rounded(F.col("_reduced") * 100, 1).alias("reduced_churn_pct"),
            rounded(ratio(profit, "_rate"), 0).alias("clv_before"),
            rounded(ratio(profit, "_reduced"), 0).alias("clv_after"),
            rounded(
                F.col("_n") * profit
                * (ratio(F.lit(1), "_reduced") - ratio(F.lit(1), "_rate")), 0
            ).alias("total_incremental_clv"),
        )
    )
