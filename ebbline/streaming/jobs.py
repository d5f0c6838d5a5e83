"""Incremental jobs: ingestion, windowed revenue, and drift checks.

Every job runs over whatever files have arrived and stops. What a micro-batch
writes is keyed by its number, so a batch that is repeated after a failure
replaces its own output instead of doubling it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.operators import drift
from ebbline.schemas import DRIFT_LOG, INPUT_TABLES
from ebbline.sources.store import save_table, upsert_snapshot

EVENTS = INPUT_TABLES["events"]


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet",
    files_per_batch: int = 100,
) -> DataFrame:
    """New parquet files of a folder whose names match `glob`."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived, batch by batch."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _batch_log(batch: DataFrame, root: str, table: str, batch_id: int, rows: int) -> None:
    entry = batch.sparkSession.createDataFrame(
        [(batch_id + 1, table, rows, f"batch {batch_id}: {rows} rows")],
        "ingestion_id long, table_name string, rows_ingested long, detail string",
    ).withColumn("ingested_at", F.current_timestamp())
    save_table(entry, f"{root}/stream_log/table={table}/batch={batch_id}")


def ingest_billing(stream: DataFrame, root: str, month: Column) -> None:
    """Append billing events, partitioned by batch and month, and log each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col("user_id").cast("string").alias("customerID"),
            month.cast("int").alias("month"),
            F.col("value").alias("mrr"),
            F.col("event_type").alias("event"),
        )
        target = f"{root}/stream_revenue/batch={batch_id}"
        save_table(rows, target, ["month"])
        written = batch.sparkSession.read.parquet(target).count()
        _batch_log(batch, root, "revenue", batch_id, written)

    run_available(stream, f"{root}/checkpoints/billing", handle)


def ingest_upserts(
    stream: DataFrame, root: str, key: str, mutable: Sequence[str], order_by: Sequence[str]
) -> None:
    """Merge changed rows into the newest version, one version per batch.

    `order_by` (event time, then sequence) decides which change of a key is the last one,
    within a batch and between batches: a change that arrives late undoes nothing newer.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counted = Observation()
        upsert_snapshot(
            spark, f"{root}/stream_customers", batch.observe(counted, F.count(F.lit(1)).alias("rows")),
            key, mutable, order_by, batch=batch_id + 1,
        )
        _batch_log(batch, root, "customers", batch_id, counted.get["rows"])

    run_available(stream, f"{root}/checkpoints/customers", handle)


def utc_instant(local: Column) -> Column:
    """A zone-less time read as UTC, as the event time a watermark needs."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), local).cast("timestamp")


def utc_wall_time(instant: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def windowed_revenue(events: DataFrame, width: str = "3 days", lateness: str = "1 day") -> DataFrame:
    """Revenue and events per tumbling window and event type.

    On a stream in append mode, a window is emitted once the watermark has passed its end;
    in update mode, whenever it changes.
    """
    return (
        events.withColumn("at", utc_instant(F.col("ts")))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.sum("value").alias("revenue"), F.count(F.lit(1)).alias("events"))
        .select(
            utc_wall_time(F.col("w.start")).alias("window_start"),
            utc_wall_time(F.col("w.end")).alias("window_end"),
            "event_type", "revenue", "events",
        )
    )


def write_window_updates(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Write every window that a batch changed, open ones too, keyed by the batch.

    latest_windows() reads each window's last state, so that after the stream has drained
    all its events are delivered.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        save_table(batch, f"{path}/batch={batch_id}")

    query = (
        windows.writeStream.outputMode("update").foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """One row per window and event type: the state after the last batch that changed it."""
    keys = ["window_start", "window_end", "event_type"]
    updates = spark.read.parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def write_windows(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Append closed windows to a parquet table, exactly once."""
    query = (
        windows.writeStream.format("parquet").outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def watch_drift(
    stream: DataFrame, baseline: DataFrame, root: str, numeric: Sequence[str],
    categorical: Sequence[str] = (), closed: bool = False,
) -> None:
    """Compare every micro-batch with a fixed baseline and log the decision.

    The baseline is measured once: its bin edges, and its counts per bin as a
    small table that each batch reads instead of the baseline itself.
    """
    spark = baseline.sparkSession
    edges = drift.baseline_edges(baseline, numeric)
    counts_path = save_table(
        drift.bin_counts(baseline, edges, categorical, closed), f"{root}/drift_baseline"
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        found = drift.psi_from_counts(
            session.read.parquet(counts_path),
            drift.bin_counts(batch, edges, categorical, closed),
        ).withColumn("flag", drift.psi_flag(F.col("psi")))
        # One row per feature; written first, so the batch is read only once.
        report = session.read.parquet(save_table(found, f"{root}/drift_reports/batch={batch_id}"))
        decision = drift.retrain_decision(report).select(
            F.struct("should_retrain", "reasons", "checked_at").alias("d")
        ).scalar()
        rows = report.withColumn("_d", decision).select(
            F.lit(batch_id).cast("long").alias("check_id"), "feature", "psi", "flag",
            F.col("_d.should_retrain").alias("should_retrain"),
            F.col("_d.reasons").alias("reasons"), F.col("_d.checked_at").alias("checked_at"),
        )
        save_table(
            rows.select(*[F.col(f.name).cast(f.dataType) for f in DRIFT_LOG]),
            f"{root}/drift_log/batch={batch_id}",
        )

    run_available(stream, f"{root}/checkpoints/drift", handle)


def drift_log(spark: SparkSession, root: str) -> DataFrame:
    log = spark.read.schema(DRIFT_LOG).parquet(f"{root}/drift_log")
    return log.select(*DRIFT_LOG.names).orderBy("check_id", "feature")
