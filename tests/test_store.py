"""The store and the incremental jobs."""

from datetime import timedelta
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ebbline.plans import ingestion
from ebbline.sources import bridge, keyed_table, store
from ebbline.streaming import jobs


@pytest.fixture
def root(spark):
    return store.scratch_path(spark, "store-test")


def test_upsert_changes_only_mutable_columns(spark):
    old = spark.createDataFrame([("a", "M", 10.0), ("b", "F", 5.0)], "id string, gender string, charge double")
    new = spark.createDataFrame([("a", "F", 11.0), ("c", "F", 7.0)], "id string, gender string, charge double")
    merged = store.merge_rows(old, new, "id", ["charge"])
    assert sorted(map(tuple, merged.collect())) == [("a", "M", 11.0), ("b", "F", 5.0), ("c", "F", 7.0)]


def test_upsert_takes_the_newest_copy(spark, root):
    staged = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0)], "id string, at int, v double")
    store.upsert_snapshot(spark, root, staged, "id", ["v"], ["at"])
    assert [tuple(r) for r in store.read_snapshot(spark, root, staged.schema).collect()] == [("a", 3, 3.0)]


def test_upsert_needs_an_order_and_keeps_what_is_newer(spark, root):
    kind = "id string, at int, v double"
    first = spark.createDataFrame([("a", 5, 900.0), ("a", 7, 100.0), ("b", 1, 1.0)], kind)
    with pytest.raises(ValueError):
        store.upsert_snapshot(spark, root, first, "id", ["v"], [])
    store.upsert_snapshot(spark, root, first, "id", ["v"], ["at"])
    late = spark.createDataFrame([("a", 6, 50.0), ("b", 1, 2.0), ("c", 0, 3.0)], kind)
    store.upsert_snapshot(spark, root, late, "id", ["v"], ["at"])
    rows = sorted(map(tuple, store.read_snapshot(spark, root, first.schema).collect()))
    assert rows == [("a", 7, 100.0), ("b", 1, 2.0), ("c", 0, 3.0)]


def test_long_counts_and_repeated_runs(spark, root):
    store.log_run(spark, root, "t", 3_000_000_000, "many", run="1")
    store.log_run(spark, root, "t", 3_000_000_000, "many", run="1")
    store.log_run(spark, root, "t", 5, "few")
    log = store.ingestion_history(spark, root).collect()
    assert [(r["ingestion_id"], r["rows_ingested"]) for r in log] == [(1, 5), (2, 3_000_000_000)] or [
        (r["ingestion_id"], r["rows_ingested"]) for r in log] == [(1, 3_000_000_000), (2, 5)]


def test_declared_tables_are_the_written_ones(spark, root):
    panel = spark.createDataFrame(
        [("a", 1, 5.0, "active"), ("a", 2, 7.0, "churn")], "customerID string, month int, mrr double, event string")
    database = "declared_" + root[-8:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/database'")
    store.declare_tables(spark, root, database)
    assert spark.table(f"{database}.customers").count() == spark.table(f"{database}.monthly_revenue").count() == 0
    store.ingest_month(spark, root, panel, 1)
    store.ingest_month(spark, root, panel, 2)
    store.declare_tables(spark, root, database)
    assert spark.table(f"{database}.monthly_revenue").count() == spark.table(f"{database}.ingestion_log").count() == 2


def test_late_events_update_their_window(spark, root):
    kind = jobs.EVENTS
    days = ["2024-01-02 00:00:00", "2024-01-03 12:00:00", "2024-01-03 06:00:00", "2024-01-05 00:00:00"]
    for i, day in enumerate(days):
        row = spark.range(1).select(*[
            {"ts": F.lit(day), "event_type": F.lit("buy"), "value": F.lit(1.0)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in kind])
        row.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.file_stream(spark, f"{root}/in", kind, files_per_batch=1)
        jobs.write_window_updates(jobs.windowed_revenue(stream), f"{root}/w", f"{root}/c")
    windows = sorted((str(r["window_start"]), r["events"]) for r in jobs.latest_windows(spark, f"{root}/w").collect())
    assert sum(n for _, n in windows) == 4 and len({w for w, _ in windows}) == len(windows)


def test_upsert_twice_is_upsert_once(spark, root):
    staged = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    store.upsert_snapshot(spark, root, staged, "id", ["v"], ["v"])
    once = sorted(store.read_snapshot(spark, root, staged.schema).collect())
    store.upsert_snapshot(spark, root, staged, "id", ["v"], ["v"])
    assert sorted(store.read_snapshot(spark, root, staged.schema).collect()) == once


def test_uncommitted_snapshot_is_not_read(spark, root):
    staged = spark.createDataFrame([("a", 1.0)], "id string, v double")
    store.upsert_snapshot(spark, root, staged, "id", ["v"], ["v"])
    staged.withColumn("v", F.lit(9.0)).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{root}/v=2")
    assert store.read_snapshot(spark, root, staged.schema).first()["v"] == 1.0


def test_month_appends_and_log(spark, root):
    panel = spark.createDataFrame(
        [("a", 1, 5.0, "active"), ("b", 1, 6.0, "active"), ("a", 2, 7.0, "churn")],
        "customerID string, month int, mrr double, event string",
    )
    assert store.ingest_month(spark, root, panel, 1) == 2
    assert store.ingest_month(spark, root, panel, 1) == 2
    assert store.monthly_revenue(spark, root).count() == 4  # plain appends double
    store.ingest_month(spark, root, panel, 1, replace=True)
    store.ingest_month(spark, root, panel, 2, replace=True)
    assert store.monthly_revenue(spark, root).count() == 3
    log = store.ingestion_history(spark, root).collect()
    assert [r["ingestion_id"] for r in log] == [1, 2, 3, 4]
    assert log[0]["detail"] == "month 1: 2 billing events"


def test_month_filter_prunes_partitions(spark, root):
    panel = spark.createDataFrame(
        [("a", m, 1.0, "active") for m in range(1, 6)],
        "customerID string, month int, mrr double, event string",
    )
    store.ingest_all_months(spark, root, panel)
    plan = store.monthly_revenue(spark, root).where("month = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_restarted_stream_adds_nothing(spark, root):
    stream = lambda: jobs.file_stream(spark, SMALL, jobs.EVENTS, "events.parquet")
    jobs.ingest_billing(stream(), root, F.lit(1))
    jobs.ingest_billing(stream(), root, F.lit(1))
    events = bridge.table(spark, SMALL, "events").count()
    assert spark.read.parquet(f"{root}/stream_revenue").count() == events


def test_windows_equal_the_batch_result(spark, root):
    stream = jobs.file_stream(spark, SMALL, jobs.EVENTS, "events.parquet")
    jobs.write_windows(jobs.windowed_revenue(stream), f"{root}/w", f"{root}/c")
    streamed = spark.read.parquet(f"{root}/w")
    batch = jobs.windowed_revenue(bridge.table(spark, SMALL, "events"))
    whole = {(r["window_start"], r["event_type"]): r["events"] for r in batch.collect()}
    closed = {(r["window_start"], r["event_type"]): r["events"] for r in streamed.collect()}
    newest = bridge.table(spark, SMALL, "events").agg(F.max("ts")).first()[0]
    # A window is out once its end is a day behind the newest event.
    due = {k: n for k, n in whole.items() if k[0] + timedelta(days=3) <= newest - timedelta(days=1)}
    assert closed == due and len(due) < len(whole)


def test_drift_is_logged_per_batch(spark, root):
    baseline = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    first = baseline.coalesce(1)
    second = baseline.withColumn("v", F.col("v") + 800).coalesce(1)
    first.write.parquet(f"{root}/in")
    second.write.mode("append").parquet(f"{root}/in")
    stream = jobs.file_stream(spark, f"{root}/in", baseline.schema, files_per_batch=1)
    jobs.watch_drift(stream, baseline, root, ["v"])
    flags = [r["flag"] for r in jobs.drift_log(spark, root).collect()]
    assert sorted(flags) == ["alert", "stable"]


def test_bucketed_tables_join_without_a_shuffle(spark, root):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    left = store.replace_table(rows, "bucketed_left", f"{root}/left", "id", 8)
    right = store.replace_table(rows, "bucketed_right", f"{root}/right", "id", 8)
    joined = left.join(right.hint("merge"), "id").groupBy("id").agg(F.sum(left["v"]).alias("v"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 1000
    # Creating it again replaces the rows.
    assert store.replace_table(rows.limit(10), "bucketed_left", f"{root}/left", "id", 8).count() == 10


def test_an_arrival_of_many_files_is_one_batch(spark, monkeypatch):
    whole, ingest, files, roots = store.stage, jobs.ingest_upserts, [], []
    monkeypatch.setattr(store, "stage", lambda df, name: whole(df.repartition(3), name))

    def counted(stream, root, *rest):
        folder = Path(root.removeprefix("file:"))
        files.append(len(list(folder.glob("arrivals/**/part-*.parquet"))))
        ingest(stream, root, *rest)
        roots.append(len(list(folder.glob("stream_log/table=customers/batch=*"))))

    monkeypatch.setattr(jobs, "ingest_upserts", counted)
    got = ingestion.stream_upserts(spark, SMALL)
    assert files == [3, 6, 9, 12] and roots == [1, 2, 3, 4]
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    assert got.count() == events.select("user_id").distinct().count()


ROWS = "id string, at int, v double"


def _plain(spark, root):
    return sorted(map(tuple, keyed_table.read(spark, root, spark.createDataFrame([], ROWS).schema).collect()))


def _upsert(spark, root, rows, **more):
    return store.upsert_snapshot(spark, root, spark.createDataFrame(rows, ROWS), "id", ["v"], ["at"], **more)


def test_upsert_leaves_untouched_buckets(spark, root):
    _upsert(spark, root, [(f"k{i}", 1, float(i)) for i in range(100)], buckets=8)
    before = keyed_table.manifest(spark, root)
    assert _upsert(spark, root, [("k7", 2, -7.0)]) == 2
    after = keyed_table.manifest(spark, root)
    changed = [b for b in after.live if after.live[b] != before.live.get(b)]
    assert len(changed) == 1 and after.buckets == 8 and len(after.live) == 8
    assert _plain(spark, root) == sorted(
        (f"k{i}", 2 if i == 7 else 1, -7.0 if i == 7 else float(i)) for i in range(100))


def test_writers_at_once_lose_nothing(spark, root):
    """The first commit of a writer finds its number taken: by a change of the same bucket,
    which is merged again, and by one of another bucket, which is kept as it is."""
    _upsert(spark, root, [("a", 1, 1.0)], buckets=4)
    whole, calls = keyed_table.commit, []
    others = [("a", 2, 2.0), ("b", 1, 5.0)]

    def raced(spark, path, new):
        if len(calls) < len(others):
            calls.append(new.version)
            keyed_table.commit, mine = whole, keyed_table.commit
            try:
                _upsert(spark, path, [others[len(calls) - 1]])
            finally:
                keyed_table.commit = mine
        return whole(spark, path, new)

    keyed_table.commit = raced
    try:
        _upsert(spark, root, [("a", 3, 3.0), ("c", 1, 9.0)])
    finally:
        keyed_table.commit = whole
    assert _plain(spark, root) == [("a", 3, 3.0), ("b", 1, 5.0), ("c", 1, 9.0)]
    assert keyed_table.versions(spark, root) == [1, 2, 3, 4]
    late = keyed_table.Manifest(4, 4, 0, {})
    assert not keyed_table.commit(spark, root, late) and len(_plain(spark, root)) == 3


def test_a_batch_is_merged_once_and_old_files_go(spark, root):
    assert _upsert(spark, root, [("a", 1, 1.0)], batch=1, buckets=2) == 1
    assert _upsert(spark, root, [("a", 1, 2.0)], batch=1) is None
    assert _upsert(spark, root, [("a", 2, 3.0)], batch=2) == 2
    assert keyed_table.remove_unreferenced(spark, root, keep=1) == 0  # too young
    assert keyed_table.remove_unreferenced(spark, root, keep=1, older_than_ms=-1) == 1
    assert keyed_table.versions(spark, root) == [2] and _plain(spark, root) == [("a", 2, 3.0)]
