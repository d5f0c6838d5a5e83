"""Billing months that are published as a whole: written aside, audited, then committed.

A delivery is written next to the published months, in one pass over its rows. The audit
reads what was written. Months without a fault become visible together, with one commit of
a `keyed_table` manifest whose buckets are the months; a month with a fault stays as it was
published before. A delivered month replaces that month, so a repeated run leaves one copy.
Of two deliveries of a month at once, the one committed last counts, as a whole.

The manifest names one folder per month, so it grows with the calendar, not with the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.schemas import STORED_REVENUE
from ebbline.sources import keyed_table
from ebbline.sources.store import log_months

TABLE = "published_revenue"


def month_audit(delivery: DataFrame) -> DataFrame:
    """Rows and faults of each delivered month.

    Faults are rows without a customer, rows beyond the first of a customer, and rows whose
    amount is missing, negative or not a finite number. Rows without a month are a row of
    their own, which is never fit to publish.
    """
    amount = F.col("mrr")
    sound = amount.isNotNull() & ~F.isnan(amount) & (amount >= 0) & (amount < float("inf"))
    # A customer with very many rows is counted before the shuffle.
    per_customer = delivery.groupBy("month", "customerID").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("_unsound"))
    known = F.col("customerID").isNotNull()
    faults = per_customer.groupBy("month").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("without_customer"),
        F.coalesce(F.sum(F.when(known, F.col("_n") - 1)), F.lit(0)).alias("repeated"),
        F.sum("_unsound").alias("unsound_amount"),
    )
    total = F.col("without_customer") + F.col("repeated") + F.col("unsound_amount")
    return faults.withColumn("fit", (total == 0) & F.col("month").isNotNull())


def publish_months(
    spark: SparkSession, root: str, panel: DataFrame, run: str | None = None
) -> DataFrame:
    """Publish the months of a delivery that pass the audit; the audit, one row per month.

    `panel` is read once. Months that become visible are logged as one run; a repeated `run`
    replaces its own log entries. An empty delivery, or one with faults in every month,
    commits nothing.
    """
    path, folder = f"{root}/{TABLE}", uuid.uuid4().hex
    written = f"{path}/data/{folder}"
    panel.withColumn("ingested_at", F.current_timestamp()).select(
        *[F.col(f.name).cast(f.dataType) for f in STORED_REVENUE]
    ).withColumn(keyed_table.BUCKET, F.col("month")).hint("rebalance", F.col("month")).write.partitionBy(
        keyed_table.BUCKET).parquet(written)
    delivery = spark.read.schema(STORED_REVENUE).parquet(written)
    audit = month_audit(delivery)
    rows = audit.collect()  # one per month
    report = spark.createDataFrame(rows, audit.schema)
    fit = [row["month"] for row in rows if row["fit"]]
    if fit:
        _commit(spark, path, dict.fromkeys(fit, folder))
        log_months(spark, root, report.where("fit").select("month", F.col("n_rows").alias("rows_ingested")), run)
    return report


def _commit(spark: SparkSession, path: str, months: dict[int, str]) -> int:
    """Make the months visible; the new version. Other writers' months are kept."""
    for _ in range(keyed_table.ATTEMPTS):
        current = keyed_table.manifest(spark, path)
        new = keyed_table.Manifest(
            current.version + 1, current.buckets, current.batch, current.live | months)
        if keyed_table.commit(spark, path, new):
            return new.version
    raise RuntimeError("other writers were faster each time")


def published_months(
    spark: SparkSession, root: str, months: Collection[int] | None = None, version: int | None = None
) -> DataFrame:
    """The published rows, of some months or all; of the newest version or an earlier one.

    Only the folders of the wanted months are listed and read.
    """
    path = f"{root}/{TABLE}"
    found = keyed_table.manifest(spark, path, version)
    return keyed_table.read(spark, path, STORED_REVENUE, found, None if months is None else set(months))


def remove_unreferenced(spark: SparkSession, root: str, keep: int = 2, older_than_ms: int = 86_400_000) -> int:
    """Delete replaced and rejected months that none of the newest versions refers to."""
    return keyed_table.remove_unreferenced(spark, f"{root}/{TABLE}", keep, older_than_ms)
