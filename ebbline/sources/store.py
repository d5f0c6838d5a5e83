"""The persistent store: customers, monthly revenue and ingestion log.

Each table lives in a folder of a shared file system. Customers are a table of key
buckets (`keyed_table`): an upsert rewrites the buckets it touches and commits the
next version, so nothing is overwritten while it is read. Revenue is partitioned
by month and appended to.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.staging import scratch_path, stage
from ebbline.sources import keyed_table
from ebbline.schemas import (
    INGESTION_LOG,
    MUTABLE_COLUMNS,
    RAW_CUSTOMERS,
    STORED_CUSTOMERS,
    STORED_REVENUE,
)


#: What a run writes to its own folder of the log; `run` comes from the folder's name.
LOG_FILES = T.StructType([
    T.StructField("entry", T.LongType()),
    *[f for f in INGESTION_LOG if f.name != "ingestion_id"],
    T.StructField("run", T.StringType()),
])


# ── plain files ──────────────────────────────────────────────────────────────

def read_customers_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_CUSTOMERS).option("header", True).csv(path)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _rebalanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring rows of a partition together, in files of the advised size.

    Adaptive execution splits a partition that holds a large part of all rows
    over several tasks and joins small ones.
    """
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    if partition_by:
        writer = _rebalanced(df, partition_by).write.partitionBy(*partition_by)
    else:
        writer = df.write
    writer.mode("overwrite").parquet(path)
    return path


def replace_table(
    df: DataFrame, name: str, path: str, key: str | None = None, buckets: int = 64
) -> DataFrame:
    """(Re)create a catalog table from a query; running it again is harmless.

    With `key`, rows are bucketed and sorted by it, so that later joins and
    aggregations on the key need no shuffle.
    """
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    if key is not None:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _fs(spark, path)
    return fs.exists(folder)


# ── tables ───────────────────────────────────────────────────────────────────

def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest committed version, or an empty table."""
    return keyed_table.read(spark, path, schema)


def upsert_snapshot(
    spark: SparkSession, path: str, staged: DataFrame, key: str, mutable: Sequence[str],
    order_by: Sequence[str], batch: int | None = None, buckets: int = keyed_table.BUCKETS,
) -> int | None:
    """Merge `staged` into the newest version and commit the next one; its number.

    `order_by` (an event time, then a sequence) says which of two rows of a key is newer,
    within the staged rows and against the table; it is kept as data. Only the key buckets
    that `staged` touches are read and written; `buckets` counts for a new table. Batches
    are numbered upwards from 1: one that was merged before changes nothing and gives None.
    """
    newest = stage(newest_per_key(staged, key, order_by), "changes")
    return keyed_table.change(
        spark, path, newest, key,
        lambda current, changes: merge_rows(current, changes, key, mutable, order_by), buckets, batch)


def customers(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed version; empty before the first upsert."""
    return read_snapshot(spark, f"{root}/customers", STORED_CUSTOMERS)


def monthly_revenue(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/monthly_revenue"
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED_REVENUE)
    return spark.read.schema(STORED_REVENUE).parquet(path)


def ingestion_history(spark: SparkSession, root: str) -> DataFrame:
    """Every ingestion run, oldest first, numbered from 1.

    Runs are ordered by the time-ordered name of their folder, so two runs at once never
    share a number; there is one row per table or month of a run.
    """
    path = f"{root}/ingestion_log"
    if not path_exists(spark, path):
        return spark.createDataFrame([], INGESTION_LOG)
    log = spark.read.schema(LOG_FILES).parquet(path)
    number = F.row_number().over(Window.partitionBy().orderBy("run", "entry"))
    return log.withColumn("ingestion_id", number.cast("long")).select(*INGESTION_LOG.names)


def register_store(spark: SparkSession, root: str) -> None:
    """Expose the store's tables to `spark.sql`."""
    customers(spark, root).createOrReplaceTempView("store_customers")
    monthly_revenue(spark, root).createOrReplaceTempView("store_monthly_revenue")
    ingestion_history(spark, root).createOrReplaceTempView("store_ingestion_log")


def declare_tables(spark: SparkSession, root: str, database: str = "default") -> None:
    """Declare the store in the catalog: revenue and log where ingestion writes them,
    customers as a view of the newest committed version's files.

    Declaring again is harmless and brings the catalog up to date with the store.
    """
    for name, schema, parts in [
        ("monthly_revenue", STORED_REVENUE, "month"), ("ingestion_log", LOG_FILES, "run"),
    ]:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet "
            f"PARTITIONED BY ({parts}) LOCATION '{root}/{name}'"
        )
        if path_exists(spark, f"{root}/{name}"):
            spark.sql(f"MSCK REPAIR TABLE {database}.{name}")
            spark.catalog.refreshTable(f"{database}.{name}")
    live = keyed_table.manifest(spark, f"{root}/customers").live
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORED_CUSTOMERS)
    bucket = keyed_table.BUCKET
    spark.sql(f"DROP TABLE IF EXISTS {database}.customers_files")  # its files stay
    spark.sql(
        f"CREATE TABLE {database}.customers_files ({columns}, {bucket} INT) USING parquet "
        f"PARTITIONED BY ({bucket}) LOCATION '{root}/customers/data'")
    if live:
        parts = " ".join(
            f"PARTITION ({bucket} = {b}) LOCATION '{root}/customers/data/{f}/{bucket}={b}'"
            for b, f in sorted(live.items()))
        spark.sql(f"ALTER TABLE {database}.customers_files ADD {parts}")
    names = ", ".join(STORED_CUSTOMERS.names)
    spark.sql(f"CREATE OR REPLACE VIEW {database}.customers AS SELECT {names} FROM {database}.customers_files")


# ── ingestion ────────────────────────────────────────────────────────────────

def newest_per_key(staged: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One staged row per key: the last by `order_by`; full ties go to the largest row.

    A mergeable maximum instead of a ranking, so that a key with very many
    copies is reduced before the shuffle.
    """
    if not order_by:
        raise ValueError("order_by is needed to know which row of a key is newer")
    rest = [c for c in staged.columns if c != key]
    ranked = F.struct(*order_by, *[c for c in rest if c not in order_by])
    return staged.groupBy(key).agg(F.max(ranked).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in rest]
    ).select(*staged.columns)


def merge_rows(
    current: DataFrame, staged: DataFrame, key: str, mutable: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Upsert: new keys are added; known keys only change in `mutable` columns.

    With `order_by`, a staged row that is older than the current one changes nothing.
    """
    old, new = current.alias("old"), staged.alias("new")
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    known, arriving = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()
    if order_by:
        age = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in order_by])
        arriving = arriving & (~known | (age("new") >= age("old")))

    def pick(name: str):
        was, becomes = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name in mutable or name in order_by:
            return F.when(arriving, becomes).otherwise(was).alias(name)
        return F.when(known, was).otherwise(becomes).alias(name)

    return joined.select(*[pick(name) for name in current.columns])


def new_run() -> str:
    """A run's name: later runs sort behind earlier ones, runs at once differ."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _log(spark: SparkSession, root: str, entries: DataFrame, run: str | None) -> None:
    """Write a run's log rows to its own folder; repeating the run replaces them."""
    entries.withColumn("ingested_at", F.current_timestamp()).select(
        *[F.col(f.name).cast(f.dataType) for f in LOG_FILES if f.name != "run"]
    ).write.mode("overwrite").parquet(f"{root}/ingestion_log/run={run or new_run()}")


def log_run(
    spark: SparkSession, root: str, table: str, rows: int, detail: str, run: str | None = None
) -> None:
    entry = [(1, table, rows, detail)]
    _log(spark, root, spark.createDataFrame(
        entry, "entry long, table_name string, rows_ingested long, detail string"
    ), run)


def log_months(spark: SparkSession, root: str, counts: DataFrame, run: str | None = None) -> None:
    """One log row for each row of `counts`: `month` and `rows_ingested`."""
    _log(spark, root, counts.select(
        F.col("month").cast("long").alias("entry"),
        F.lit("monthly_revenue").alias("table_name"),
        "rows_ingested",
        F.format_string("month %d: %d billing events", "month", "rows_ingested").alias("detail"),
    ), run)


def ingest_customers(
    spark: SparkSession, root: str, staged: DataFrame, order_by: Sequence[str],
    run: str | None = None, buckets: int = keyed_table.BUCKETS,
) -> int:
    """Upsert customers and log the run; returns the number of staged rows.

    Total charges have to be numbers or null by now. `order_by` names the columns by which
    one of several staged rows of a customer is the newest; against the store a run is
    always newer than the runs before it.
    """
    counted = Observation()
    # Counted while the rows pass by, so that the input is derived once.
    stamped = newest_per_key(
        staged.observe(counted, F.count(F.lit(1)).alias("rows")), "customerID", order_by
    ).withColumn("last_updated", F.current_timestamp()).select(
        *[F.col(f.name).cast(f.dataType) for f in STORED_CUSTOMERS]
    )
    upsert_snapshot(
        spark, f"{root}/customers", stamped, "customerID", MUTABLE_COLUMNS, ["last_updated"],
        buckets=buckets)
    staged_rows = counted.get["rows"]
    log_run(spark, root, "customers", staged_rows, f"upserted {staged_rows} customer records", run)
    return staged_rows


def _append_months(root: str, panel: DataFrame, replace: bool) -> None:
    stamped = panel.withColumn("ingested_at", F.current_timestamp()).select(
        *[F.col(f.name).cast(f.dataType) for f in STORED_REVENUE]
    )
    writer = _rebalanced(stamped, ["month"]).write.partitionBy("month")
    if replace:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(f"{root}/monthly_revenue")


def ingest_month(
    spark: SparkSession, root: str, panel: DataFrame, month: int, replace: bool = False,
    run: str | None = None,
) -> int:
    """Append one month of billing rows and log the run.

    With `replace` the month's partition is rewritten, so that a repeated run
    leaves the same rows instead of doubling them.
    """
    counted = Observation()
    part = panel.where(F.col("month") == month).observe(counted, F.count(F.lit(1)).alias("rows"))
    _append_months(root, part, replace)
    rows = counted.get["rows"]
    log_run(spark, root, "monthly_revenue", rows, f"month {month}: {rows} billing events", run)
    return rows


def ingest_all_months(
    spark: SparkSession, root: str, panel: DataFrame, replace: bool = False, run: str | None = None
) -> None:
    """Append every month in one partitioned write, with one log row each."""
    panel = stage(panel, "panel")  # written once, then read for the rows and for the counts
    _append_months(root, panel, replace)
    log_months(spark, root, panel.groupBy("month").agg(F.count(F.lit(1)).alias("rows_ingested")), run)
