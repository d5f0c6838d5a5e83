"""Subscription tables derived from an order history and an event stream.

A customer's orders stand for their subscription: the first order is the
sign-up, the span of order months is the tenure, and a customer without a
recent order has churned. Every derivation is a plain aggregate, so a customer
with a very large share of the orders is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.functions.scalars import cents, month_index, month_start
from ebbline.schemas import INPUT_TABLES

REFERENCE_DATE = "2001-08-01"
LAST_ACTIVE_FROM = "2001-02-01"
DRIFT_CUTOFF = "1999-08-01"
# Average charges are about 40,000, so acquisition cost is scaled to match.
CAC = 250_000.0
GROSS_MARGIN = 0.75
SCENARIO_SEGMENT = "BUILDING"

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in INPUT_TABLES:
        reader = reader.schema(INPUT_TABLES[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every input table, and `subscribers`, to `spark.sql`."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    subscribers(spark, sf_dir).createOrReplaceTempView("subscribers")


def _order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(
            F.min(day).alias("first_order"),
            F.max(day).alias("last_order"),
            F.sum(cents("o_totalprice")).alias("total_cents"),
            F.min_by("o_orderpriority", "o_orderkey").alias("payment_method"),
            F.max(F.when(F.col("o_totalprice") > 450000, 1).otherwise(0)).alias("online_security"),
            F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias(
                "senior_citizen"
            ),
        )
    )


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    # Nation and region are fixed-size dimensions; the planner broadcasts them
    # after checking their size.
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    customer = table(spark, sf_dir, "customer")
    return customer.join(places, customer.c_nationkey == places.n_nationkey)


def _subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = _homes(spark, sf_dir)
    summary = _order_summary(spark, sf_dir)
    tenure = month_index("last_order") - month_index("first_order") + 1
    return homes.join(summary, homes.c_custkey == summary.customer_id).withColumns(
        {
            "contract": F.col("c_mktsegment"),
            "internet_service": F.col("r_name"),
            "tech_support": F.when(F.col("c_acctbal") > 5000, 1).otherwise(0),
            "signup_date": F.col("first_order"),
            "signup_month": month_start("first_order"),
            "tenure": tenure.cast("int"),
            "churned": F.when(F.col("last_order") < F.lit(LAST_ACTIVE_FROM).cast("date"), 1).otherwise(0),
            "total_charges": F.col("total_cents") / 100,
            "monthly_charges": F.round(F.col("total_cents") / tenure) / 100,
        }
    )


SUBSCRIBER_COLUMNS = [
    "customer_id", "contract", "internet_service", "payment_method", "tech_support",
    "online_security", "senior_citizen", "signup_date", "signup_month", "tenure",
    "churned", "total_charges", "monthly_charges",
]


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with at least one order."""
    return _subscription(spark, sf_dir).select(*SUBSCRIBER_COLUMNS)


def _yes_no(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def _service(condition: Column, available: Column, missing: str) -> Column:
    return F.when(~available, missing).otherwise(_yes_no(condition))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same customers in the raw snapshot layout, text flags included.

    Every 97th customer has a blank total, as real exports do.
    """
    key = F.col("customer_id")
    phone = key % 10 != 0
    internet = F.col("internet_service") != "AFRICA"
    no_phone, no_internet = "No phone service", "No internet service"
    total = F.concat(
        F.expr("total_cents div 100").cast("string"), F.lit("."),
        F.lpad((F.col("total_cents") % 100).cast("string"), 2, "0"),
    )
    return _subscription(spark, sf_dir).select(
        F.concat(F.lit("CUST-"), key.cast("string")).alias("customerID"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.col("senior_citizen").alias("SeniorCitizen"),
        _yes_no(F.col("c_acctbal") > 0).alias("Partner"),
        _yes_no(key % 3 == 0).alias("Dependents"),
        "tenure",
        _yes_no(phone).alias("PhoneService"),
        _service(key % 2 == 0, phone, no_phone).alias("MultipleLines"),
        F.col("internet_service").alias("InternetService"),
        _service(F.col("online_security") == 1, internet, no_internet).alias("OnlineSecurity"),
        _service(key % 4 == 1, internet, no_internet).alias("OnlineBackup"),
        _service(key % 5 == 2, internet, no_internet).alias("DeviceProtection"),
        _service(F.col("tech_support") == 1, internet, no_internet).alias("TechSupport"),
        _service(key % 7 < 3, internet, no_internet).alias("StreamingTV"),
        _service(key % 11 < 5, internet, no_internet).alias("StreamingMovies"),
        F.col("contract").alias("Contract"),
        _yes_no(key % 5 < 3).alias("PaperlessBilling"),
        F.col("payment_method").alias("PaymentMethod"),
        F.col("monthly_charges").alias("MonthlyCharges"),
        F.when(key % 97 == 0, " ").otherwise(total).alias("TotalCharges"),
        _yes_no(F.col("churned") == 1).alias("Churn"),
    )


def panel_orders12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per customer and 12-month block since their first order month."""
    monthly = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("customer_id"),
            month_index("o_orderdate").alias("order_month"),
        )
        .agg(F.sum(cents("o_totalprice")).alias("spent"))
    )
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    block = F.floor((F.col("order_month") - first) / 12) + 1
    return (
        monthly.withColumn("month", block.cast("int"))
        .groupBy("customer_id", "month")
        .agg((F.sum("spent") / 100).alias("mrr"))
    )


def panel_events3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per user and 3-day block since 2024-01-01."""
    block = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3) + 1
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("customer_id"), block.cast("int").alias("month"))
        .agg((F.sum(cents("value")) / 100).alias("mrr"))
    )


def drift_sides(spark: SparkSession, sf_dir: str, price_factor: float = 1.25) -> tuple[DataFrame, DataFrame]:
    """Orders before and from a cut-off date, the later ones with raised prices."""
    orders = table(spark, sf_dir, "orders")
    cut = F.col("o_orderdate") < F.lit(DRIFT_CUTOFF).cast("timestamp_ntz")
    baseline = orders.where(cut)
    recent = orders.where(~cut).withColumn("o_totalprice", F.col("o_totalprice") * price_factor)
    return baseline, recent
