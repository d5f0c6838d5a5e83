"""What drives a linear score: additive contributions on the log-odds scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_contributions(
    df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0,
    id_column: str = "customer_id",
) -> DataFrame:
    """Contribution of each feature against the average customer.

    Adds `phi_<feature>` for every feature, the `base` value of the average
    customer and the customer's `margin`; base plus contributions is margin.
    """
    means = df.agg(
        F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in coefficients])
    ).scalar()
    marked = df.withColumn("_means", means)
    base = F.lit(float(intercept))
    for feature, beta in coefficients.items():
        base = base + float(beta) * F.col(f"_means.{feature}")
    phis = {
        f"phi_{f}": float(beta) * (F.col(f) - F.col(f"_means.{f}"))
        for f, beta in coefficients.items()
    }
    total = base
    for phi in phis.values():
        total = total + phi
    return marked.select(
        id_column, *[e.alias(n) for n, e in phis.items()], base.alias("base"), total.alias("margin")
    )


def mean_absolute(contributions: DataFrame) -> DataFrame:
    """Average size of each feature's contribution, largest first."""
    names = [c for c in contributions.columns if c.startswith("phi_")]
    means = contributions.agg(*[F.avg(F.abs(F.col(n))).alias(n[4:]) for n in names])
    return means.unpivot([], [n[4:] for n in names], "feature", "mean_abs").orderBy(
        F.desc("mean_abs")
    )


def explain_top_customer(contributions: DataFrame, id_column: str = "customer_id") -> DataFrame:
    """Contributions of the customer with the highest margin, one row each."""
    names = [c for c in contributions.columns if c.startswith("phi_")]
    top = contributions.orderBy(F.desc("margin"), id_column).limit(1)
    return top.unpivot([id_column, "base", "margin"], names, "feature", "contribution").withColumn(
        "feature", F.substring("feature", 5, 200)
    )
