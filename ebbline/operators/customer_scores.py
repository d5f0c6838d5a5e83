"""What is known about each customer, in one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ebbline.functions.staging import stage
from ebbline.operators import survival


def scorecard(
    customers: DataFrame, scores: DataFrame, id_column: str = "customer_id", cac: float = 250.0,
    margin: float = 0.75, segment: str = "contract", duration: str = "tenure", event: str = "churned",
    charge: str = "monthly_charges",
) -> DataFrame:
    """Customers with their model score, lifetime value, unit economics and value tier.

    `scores` has one row per scored customer; a customer without one keeps null there.
    The valued customers are staged, as the tiers' cut points need them before the rows do.
    """
    valued = survival.customer_value(customers, segment, duration, event, charge, margin)
    valued = stage(survival.unit_economics(valued, cac, margin, charge), "valued")
    return survival.value_tiers(valued).join(scores, id_column, "left")
