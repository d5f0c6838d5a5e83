"""Monthly recurring revenue: customer-months, totals and decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.grids import add_zero_rows
from ebbline.functions.scalars import as_column, month_index, month_label, month_start, ratio


def first_full_month(signup: Column | str) -> Column:
    """First month start on or after the sign-up day."""
    signup = as_column(signup)
    start = month_start(signup)
    return F.when(signup == start, start).otherwise(F.add_months(start, 1))


def customer_months(subs: DataFrame, reference_date: str) -> DataFrame:
    """One row per customer and active month, up to the reference date.

    `churned` is true only on the last month of a churned customer. The output
    has tenure-many rows per customer; for totals use `monthly_totals`, which
    needs no expansion.
    """
    reference = F.lit(reference_date).cast("date")
    start = first_full_month("signup_date")
    last = F.add_months(start, F.col("tenure") - 1)
    months = F.when(
        (F.col("tenure") > 0) & (start <= reference),
        F.sequence(start, F.least(last, month_start(reference)), F.expr("interval 1 month")),
    )
    return (
        subs.withColumn("_last", last)
        .withColumn("month", F.explode(months))
        .select(
            "month",
            "customer_id",
            F.col("monthly_charges").alias("mrr"),
            ((F.col("churned") == 1) & (F.col("month") == F.col("_last"))).alias("churned"),
            "contract",
        )
    )


def _per_customer(totals: DataFrame) -> DataFrame:
    return totals.select(
        "month",
        "total_mrr",
        "active_customers",
        "churned_customers",
        ratio("total_mrr", "active_customers").alias("avg_revenue_per_customer"),
        ratio("churned_customers", "active_customers").alias("churn_rate"),
        month_label("month").alias("month_str"),
    ).orderBy("month")


def aggregate_months(long: DataFrame) -> DataFrame:
    """Monthly totals of a customer-month frame."""
    # Per customer and month first: the distinct count becomes a plain count.
    per_customer = long.groupBy("month", "customer_id").agg(
        F.sum("mrr").alias("mrr"), F.sum(F.col("churned").cast("long")).alias("churned")
    )
    return _per_customer(
        per_customer.groupBy("month").agg(
            F.sum("mrr").alias("total_mrr"),
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("churned").alias("churned_customers"),
        )
    )


def calendar_totals(
    subs: DataFrame, first: Column, months: Column, reference_date: str
) -> DataFrame:
    """Totals per calendar month from joins and leaves alone.

    Every customer adds their charge in the first month and takes it back
    after the last, and a running sum over the calendar gives the totals. This
    replaces tenure-many rows per customer by two. Money is summed as decimals,
    so that what was added cancels exactly when it is taken back.
    """
    reference = F.lit(reference_date).cast("date")
    end = F.add_months(first, months)
    event = lambda month, sign, left: F.struct(
        month.alias("month"), F.lit(sign).alias("sign"), left.alias("left")
    )
    no_leave = F.lit(0)
    leave = F.when(F.col("churned") == 1, 1).otherwise(0)
    moves = (
        subs.where((months > 0) & (first <= reference))
        .select(
            F.col("monthly_charges").cast("decimal(18,6)").alias("charge"),
            F.explode(F.array(
                event(first, 1, no_leave),
                event(end, -1, no_leave),
                # The churn is counted in the last active month itself.
                event(F.add_months(end, -1), 0, leave),
            )).alias("e"),
        )
        .groupBy("e.month")
        .agg(
            F.sum(F.col("e.sign") * F.col("charge")).alias("mrr_change"),
            F.sum("e.sign").alias("customer_change"),
            F.sum("e.left").alias("left"),
        )
    )
    # From here on there is one row per calendar month.
    whole = Window.partitionBy()
    first_month = F.min("month").over(whole)
    position = (month_index("month") - month_index("_first")).cast("int")
    calendar = (
        moves.withColumn("_first", first_month)
        .withColumn("_position", position)
        .select("_first", "_position", "mrr_change", "customer_change", "left")
    )
    longest = F.max("_position").over(Window.partitionBy("_first"))
    dense = add_zero_rows(
        calendar, ["_first"], "_position", longest, ["mrr_change", "customer_change", "left"]
    )
    running = whole.orderBy("_position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.select(
        F.add_months("_first", F.col("_position")).alias("month"),
        F.sum("mrr_change").over(running).cast("double").alias("total_mrr"),
        F.sum("customer_change").over(running).alias("active_customers"),
        F.col("left").alias("churned_customers"),
    ).where((F.col("active_customers") > 0) & (F.col("month") <= reference))


def monthly_totals(subs: DataFrame, reference_date: str) -> DataFrame:
    """`aggregate_months(customer_months(...))` without the expansion."""
    return _per_customer(
        calendar_totals(subs, first_full_month("signup_date"), F.col("tenure"), reference_date)
    )


def mrr_decomposition(monthly: DataFrame) -> DataFrame:
    """Month-over-month change split into new and churned MRR."""
    before = F.lag("total_mrr").over(Window.partitionBy().orderBy("month"))
    return (
        monthly.withColumn("mrr_change", F.col("total_mrr") - before)
        .withColumn("churned_mrr", F.col("churned_customers") * F.col("avg_revenue_per_customer"))
        .withColumn("new_mrr", F.greatest(F.col("mrr_change") + F.col("churned_mrr"), F.lit(0.0)))
        .where(F.col("mrr_change").isNotNull())
        .orderBy("month")
    )


def latest_months(monthly: DataFrame, n: int = 24) -> DataFrame:
    return monthly.orderBy(F.desc("month")).limit(n)


def mrr_kpis(monthly: DataFrame) -> DataFrame:
    """Mean churn rate and the figures of the latest month."""
    newest = lambda name: F.max_by(name, "month").alias(f"latest_{name}")
    return monthly.agg(
        F.max("month").alias("latest_month"),
        newest("total_mrr"),
        newest("active_customers"),
        newest("avg_revenue_per_customer"),
        newest("churn_rate"),
        F.avg("churn_rate").alias("avg_churn_rate"),
    )
