"""The store and the incremental jobs, run over the input tables.

Each query works in a new folder below the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.scalars import round_columns, rounded
from ebbline.operators import drift, features, nrr
from ebbline.plans.judgement import CATEGORICAL, NUMERIC, psi_ctes
from ebbline.plans.registry import register
from ebbline.plans.sql_base import (
    PANEL_EVENTS3D,
    RAW_CUSTOMERS,
    big,
    query,
    r,
)
from ebbline.schemas import MONTHLY_REVENUE, RAW_CUSTOMERS as RAW_SCHEMA
from ebbline.sources import bridge, decision_log, month_publish, store
from ebbline.streaming import jobs



def _number():
    return F.substring("customerID", 6, 20).cast("long")


UPSERTED = """
base AS (SELECT * REPLACE (TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges")
  FROM raw_customers WHERE CAST(substr("customerID", 6) AS BIGINT) % 3 <> 0),
staged AS (SELECT * REPLACE (TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges",
    """ + r('"MonthlyCharges" * 1.1::DOUBLE', 2) + """ AS "MonthlyCharges", 'Other' AS gender)
  FROM raw_customers WHERE CAST(substr("customerID", 6) AS BIGINT) % 2 = 0
    OR CAST(substr("customerID", 6) AS BIGINT) % 3 = 0),
merged AS (
  SELECT coalesce(b."customerID", s."customerID") AS "customerID",
    CASE WHEN s."customerID" IS NULL THEN b.tenure ELSE s.tenure END AS tenure,
    CASE WHEN s."customerID" IS NULL THEN b."Churn" ELSE s."Churn" END AS "Churn",
    CASE WHEN s."customerID" IS NULL THEN b."MonthlyCharges" ELSE s."MonthlyCharges" END AS "MonthlyCharges",
    CASE WHEN s."customerID" IS NULL THEN b."TotalCharges" ELSE s."TotalCharges" END AS "TotalCharges",
    """ + ",\n    ".join(
    f'CASE WHEN b."customerID" IS NULL THEN s."{f.name}" ELSE b."{f.name}" END AS "{f.name}"'
    for f in RAW_SCHEMA
    if f.name not in {"customerID", "tenure", "Churn", "MonthlyCharges", "TotalCharges"}
) + """
  FROM base b FULL JOIN staged s ON b."customerID" = s."customerID")"""


def _upserted_store(spark, sf_dir):
    root = store.scratch_path(spark, "store")
    raw = store.stage(features.coerce_totals(bridge.raw_customers(spark, sf_dir)), "customers")
    # Some only in the store, some only staged, some in both; everyone is in one of them.
    staged = raw.where((_number() % 2 == 0) | (_number() % 3 == 0)).withColumns({
        "MonthlyCharges": rounded(F.col("MonthlyCharges") * 1.1, 2), "gender": F.lit("Other"),
    })
    store.ingest_customers(spark, root, raw.where(_number() % 3 != 0), ["tenure"])
    store.ingest_customers(spark, root, staged, ["tenure"])
    return root, staged


def _panel(spark, sf_dir):
    labelled = nrr.label_events(bridge.panel_events3d(spark, sf_dir))
    return labelled.select(
        F.col("customer_id").cast("string").alias("customerID"), "month", "mrr", "event"
    )


def _revenue_by_month(revenue):
    report = revenue.groupBy("month").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("mrr").alias("mrr")
    )
    return round_columns(report, {"mrr": 2})


REVENUE_BY_MONTH = f"SELECT month, {big('count(*)')} AS n_rows, {r('sum(mrr)', 2)} AS mrr FROM panel"


@register("store_upsert", query("SELECT * FROM merged", RAW_CUSTOMERS, UPSERTED))
def store_upsert(spark, sf_dir):
    root, _ = _upserted_store(spark, sf_dir)
    return store.customers(spark, root).drop("last_updated")


@register("store_reingest_check", query(f"""
SELECT {big('count(*)')} AS n_rows, {big('count(DISTINCT "customerID")')} AS distinct_keys,
  {r('sum("MonthlyCharges")', 2)} AS mrr FROM merged""", RAW_CUSTOMERS, UPSERTED))
def store_reingest_check(spark, sf_dir):
    """Upserting the same rows again changes nothing."""
    root, staged = _upserted_store(spark, sf_dir)
    store.ingest_customers(spark, root, staged, ["tenure"])
    return store.customers(spark, root).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("customerID").alias("distinct_keys"),
        rounded(F.sum("MonthlyCharges"), 2).alias("mrr"),
    )


@register("store_report", query(f"""
SELECT "Contract" AS contract, {big('count(*)')} AS customers, {r('avg("MonthlyCharges")', 2)} AS avg_mrr
FROM merged GROUP BY 1""", RAW_CUSTOMERS, UPSERTED))
def store_report(spark, sf_dir):
    root, _ = _upserted_store(spark, sf_dir)
    store.register_store(spark, root)
    return spark.sql(
        """SELECT Contract AS contract, count(*) AS customers,
                  round(round(avg(MonthlyCharges), 5), 2) AS avg_mrr
           FROM store_customers GROUP BY Contract"""
    )


@register("store_append_months", query(f"{REVENUE_BY_MONTH} GROUP BY month", PANEL_EVENTS3D))
def store_append_months(spark, sf_dir):
    """Months arrive one at a time; the second one is delivered twice."""
    root = store.scratch_path(spark, "store")
    panel = store.stage(_panel(spark, sf_dir), "panel", ["month"])
    for month in range(1, panel.agg(F.max("month")).first()[0] + 1):
        store.ingest_month(spark, root, panel, month)
    store.ingest_month(spark, root, panel, 2, replace=True)
    return _revenue_by_month(store.monthly_revenue(spark, root))


@register("store_replay_months", query(f"{REVENUE_BY_MONTH} GROUP BY month", PANEL_EVENTS3D))
def store_replay_months(spark, sf_dir):
    root = store.scratch_path(spark, "store")
    store.ingest_all_months(spark, root, _panel(spark, sf_dir))
    return _revenue_by_month(store.monthly_revenue(spark, root))


@register("published_months", query(f"{REVENUE_BY_MONTH} GROUP BY month", PANEL_EVENTS3D))
def published_months(spark, sf_dir):
    """Two equal runs leave one copy; a delivery with a customer twice is held back."""
    root = store.scratch_path(spark, "store")
    panel = store.stage(_panel(spark, sf_dir), "panel", ["month"])
    for _ in range(2):
        month_publish.publish_months(spark, root, panel)
    third = panel.where("month = 3")
    month_publish.publish_months(spark, root, third.unionByName(third))
    return _revenue_by_month(month_publish.published_months(spark, root))


FAULTY_PANEL = """
faulty AS (
  SELECT CASE WHEN month = 2 AND customer_id % 7 = 0 THEN NULL ELSE customer_id END AS customer_id, month,
    CASE WHEN month = 3 AND customer_id % 5 = 0 THEN -mrr ELSE mrr END AS mrr FROM panel
  UNION ALL SELECT customer_id, month, mrr FROM panel WHERE month = 4),
per_customer AS (
  SELECT month, customer_id, count(*) AS n, count(*) FILTER (WHERE mrr < 0) AS negative
  FROM faulty GROUP BY 1, 2),
audited AS (
  SELECT month, sum(n) AS n_rows, coalesce(sum(n) FILTER (WHERE customer_id IS NULL), 0) AS without_customer,
    coalesce(sum(n - 1) FILTER (WHERE customer_id IS NOT NULL), 0) AS repeated, sum(negative) AS unsound_amount
  FROM per_customer GROUP BY 1)"""


@register("month_audit", query(f"""
SELECT month, {big('n_rows')} AS n_rows, {big('without_customer')} AS without_customer,
  {big('repeated')} AS repeated, {big('unsound_amount')} AS unsound_amount,
  without_customer + repeated + unsound_amount = 0 AS fit,
  {big("CASE WHEN without_customer + repeated + unsound_amount = 0 THEN n_rows ELSE 0 END")} AS published_rows
FROM audited""", PANEL_EVENTS3D, FAULTY_PANEL))
def month_audit(spark, sf_dir):
    """A delivery with faults in some months: what the audit found and what became visible."""
    root = store.scratch_path(spark, "store")
    panel = store.stage(_panel(spark, sf_dir), "panel", ["month"])
    number = F.col("customerID").cast("long")
    faulty = panel.withColumns({
        "mrr": F.when((F.col("month") == 3) & (number % 5 == 0), -F.col("mrr")).otherwise(F.col("mrr")),
        "customerID": F.when((F.col("month") == 2) & (number % 7 == 0), None).otherwise(F.col("customerID")),
    })
    report = month_publish.publish_months(spark, root, faulty.unionByName(panel.where("month = 4")))
    visible = month_publish.published_months(spark, root).groupBy("month").agg(
        F.count(F.lit(1)).alias("published_rows"))
    return report.join(visible, "month", "left").fillna(0, ["published_rows"])


@register("ingestion_history", query(f"""
SELECT 1::BIGINT AS ingestion_id, 'customers' AS table_name, CAST(count(*) AS BIGINT) AS rows_ingested,
  'upserted ' || count(*) || ' customer records' AS detail FROM raw_customers
UNION ALL
SELECT CAST(1 + row_number() OVER (ORDER BY month) AS BIGINT), 'monthly_revenue', CAST(n AS BIGINT),
  'month ' || month || ': ' || n || ' billing events'
FROM (SELECT month, count(*) AS n FROM panel GROUP BY 1)""", RAW_CUSTOMERS, PANEL_EVENTS3D))
def ingestion_history(spark, sf_dir):
    root = store.scratch_path(spark, "store")
    raw = store.stage(features.coerce_totals(bridge.raw_customers(spark, sf_dir)), "customers")
    store.ingest_customers(spark, root, raw, ["tenure"])
    store.ingest_all_months(spark, root, _panel(spark, sf_dir))
    return store.ingestion_history(spark, root).drop("ingested_at")


@register("recreated_table", query(f"""
SELECT "Contract" AS contract, {big('count(*)')} AS customers, {r('sum("MonthlyCharges")', 2)} AS mrr
FROM raw_customers WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL GROUP BY 1""", RAW_CUSTOMERS))
def recreated_table(spark, sf_dir):
    """The typed customer table, created twice under the same name."""
    root = store.scratch_path(spark, "typed")
    raw = bridge.raw_customers(spark, sf_dir)
    typed = store.stage(features.typed_customers(raw, bridge.REFERENCE_DATE), "typed")
    name = "customers_" + root[-8:]
    for _ in range(2):
        table = store.replace_table(typed, name, f"{root}/table", key="customerID", buckets=8)
    return table.groupBy("contract").agg(
        F.count(F.lit(1)).alias("customers"), rounded(F.sum("monthly_charges"), 2).alias("mrr")
    )


@register("declared_tables", query(f"""
SELECT 'customers' AS table_name, {big('count(*)')} AS n_rows FROM raw_customers
UNION ALL SELECT 'monthly_revenue', {big('count(*)')} FROM panel
UNION ALL SELECT 'ingestion_log', {big('1 + count(DISTINCT month)')} FROM panel""", RAW_CUSTOMERS, PANEL_EVENTS3D))
def declared_tables(spark, sf_dir):
    root = store.scratch_path(spark, "tables")
    database = "store_" + root[-8:]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/database'")
    store.declare_tables(spark, root, database)
    raw = features.coerce_totals(bridge.raw_customers(spark, sf_dir))
    store.ingest_customers(spark, root, raw, ["tenure"])
    store.ingest_all_months(spark, root, _panel(spark, sf_dir))
    store.declare_tables(spark, root, database)  # again, now with rows
    counts = None
    for name in ("customers", "monthly_revenue", "ingestion_log"):
        one = spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@register("customers_from_csv", query("SELECT * FROM raw_customers", RAW_CUSTOMERS))
def customers_from_csv(spark, sf_dir):
    path = store.scratch_path(spark, "customers-csv")
    bridge.raw_customers(spark, sf_dir).write.option("header", True).option(
        "ignoreTrailingWhiteSpace", False
    ).option("ignoreLeadingWhiteSpace", False).csv(path)
    return store.read_customers_csv(spark, path)


@register("panel_from_csv", query(f"{REVENUE_BY_MONTH} GROUP BY month", PANEL_EVENTS3D))
def panel_from_csv(spark, sf_dir):
    path = store.scratch_path(spark, "panel-csv")
    _panel(spark, sf_dir).write.option("header", True).csv(path)
    return _revenue_by_month(store.read_panel_csv(spark, path, MONTHLY_REVENUE))


@register("saved_features", query(f"""
SELECT "Contract" AS contract, {big('count(*)')} AS customers, {r('avg("MonthlyCharges")', 2)} AS avg_monthly_charges
FROM raw_customers WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL GROUP BY 1""", RAW_CUSTOMERS))
def saved_features(spark, sf_dir):
    table = features.preprocess(bridge.raw_customers(spark, sf_dir), bridge.REFERENCE_DATE)
    path = store.save_table(table, store.scratch_path(spark, "features"))
    return spark.read.parquet(path).groupBy(F.col("Contract").alias("contract")).agg(
        F.count(F.lit(1)).alias("customers"),
        rounded(F.avg("MonthlyCharges"), 2).alias("avg_monthly_charges"),
    )


@register("saved_panel", query(f"{REVENUE_BY_MONTH} GROUP BY month", PANEL_EVENTS3D))
def saved_panel(spark, sf_dir):
    path = store.save_table(_panel(spark, sf_dir), store.scratch_path(spark, "panel"), ["month"])
    return _revenue_by_month(spark.read.parquet(path))


def _event_stream(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, jobs.EVENTS, "events.parquet")


def _block():
    return F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3) + 1


@register("stream_billing", f"""
SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 + 1 AS INTEGER) AS month,
  {big('count(*)')} AS n_rows, {r('sum(value)', 2)} AS mrr,
  {big('(SELECT count(*) FROM events)')} AS logged FROM events GROUP BY 1""")
def stream_billing(spark, sf_dir):
    root = store.scratch_path(spark, "stream")
    jobs.ingest_billing(_event_stream(spark, sf_dir), root, _block())
    logged = spark.read.parquet(f"{root}/stream_log").agg(F.sum("rows_ingested")).scalar()
    revenue = spark.read.parquet(f"{root}/stream_revenue")
    return _revenue_by_month(revenue).withColumn("logged", logged)


@register("stream_upserts", """
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
  arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id""")
def stream_upserts(spark, sf_dir):
    """The last event of every user. Four batches hold events of the same users, and times
    go back and forth between them; the stream is restarted for each. A batch is a folder of
    as many files as it has partitions."""
    root = store.scratch_path(spark, "stream")
    events = store.stage(
        bridge.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"),
        "events")
    arrivals = f"{root}/arrivals"
    for batch in (2, 0, 3, 1):
        part = events.where(F.pmod("event_id", F.lit(4)) == batch)
        part.write.parquet(f"{arrivals}/{batch}")
        stream = jobs.file_stream(spark, f"{arrivals}/*", events.schema)
        jobs.ingest_upserts(
            stream, root, "user_id", ["event_id", "ts", "event_type", "value"], ["ts", "event_id"])
    return store.read_snapshot(spark, f"{root}/stream_customers", events.schema)


@register("stream_windows", f"""
SELECT w AS window_start, w + INTERVAL 3 DAYS AS window_end, event_type, {r('sum(value)', 2)} AS revenue,
  {big('count(*)')} AS events
FROM (SELECT *, time_bucket(INTERVAL 3 DAYS, ts, TIMESTAMP '1970-01-01') AS w FROM events)
GROUP BY w, event_type""")
def stream_windows(spark, sf_dir):
    """Every event is in a window, those still open at the end included."""
    root = store.scratch_path(spark, "stream")
    windows = jobs.windowed_revenue(_event_stream(spark, sf_dir))
    jobs.write_window_updates(windows, f"{root}/windows", f"{root}/checkpoints/windows")
    return round_columns(jobs.latest_windows(spark, f"{root}/windows"), {"revenue": 2})


@register("stream_drift", query(f"""
SELECT 0::BIGINT AS check_id, feature, {r('psi', 6)} AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'alert' END AS flag,
  alerts > 0 AS should_retrain, CASE WHEN alerts = 0 THEN ''
    ELSE alerts || ' feature(s) with PSI > 0.25 (significant shift): [' || named || ']' END AS reasons
FROM drift, (SELECT count(*) FILTER (WHERE psi >= 0.25) AS alerts,
  string_agg(CASE WHEN psi >= 0.25 THEN '''' || feature || '''' END, ', ' ORDER BY psi DESC) AS named FROM drift)""",
    psi_ctes(False)))
def stream_drift(spark, sf_dir):
    """Later orders arrive as files and are checked against the earlier ones."""
    root = store.scratch_path(spark, "stream")
    baseline, recent = bridge.drift_sides(spark, sf_dir)
    arrivals = store.save_table(recent, f"{root}/arrivals")
    stream = jobs.file_stream(spark, arrivals, recent.schema)
    jobs.watch_drift(stream, baseline, root, NUMERIC, CATEGORICAL)
    return round_columns(jobs.drift_log(spark, root).drop("checked_at"), {"psi": 6})


CHECKED_YEARS = """
periods AS (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS period FROM orders WHERE o_orderdate >= DATE '1999-08-01'),
baseline AS (SELECT o_totalprice AS v, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate < DATE '1999-08-01'),
sides AS (
  SELECT period, 0 AS side, baseline.* FROM baseline, periods
  UNION ALL
  SELECT CAST(year(o_orderdate) AS VARCHAR), 1, o_totalprice * 1.25::DOUBLE, o_orderpriority, o_orderstatus
  FROM orders WHERE o_orderdate >= DATE '1999-08-01'),
cuts AS (
  SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
  FROM baseline),
binned AS (
  SELECT period, side, 'o_totalprice' AS feature,
    CAST(len(list_filter(edges[2:len(edges) - 1], lambda e: v > e)) AS VARCHAR) AS bin FROM sides, cuts
  UNION ALL SELECT period, side, 'o_orderpriority', o_orderpriority FROM sides
  UNION ALL SELECT period, side, 'o_orderstatus', o_orderstatus FROM sides),
shares AS (
  SELECT e.period, e.feature,
    greatest(e.n0 / CAST(sum(e.n0) OVER (PARTITION BY e.period, e.feature) AS DOUBLE), 0.0001) AS p0,
    greatest(e.n1 / CAST(sum(e.n1) OVER (PARTITION BY e.period, e.feature) AS DOUBLE), 0.0001) AS p1
  FROM (SELECT period, feature, bin, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1
        FROM binned WHERE bin IS NOT NULL GROUP BY 1, 2, 3) e),
drift AS (SELECT period, feature, sum((p1 - p0) * ln(p1 / p0)) AS psi FROM shares GROUP BY 1, 2),
decided AS (
  SELECT period, count(*) FILTER (WHERE psi >= 0.25) AS alerts,
    string_agg(CASE WHEN psi >= 0.25 THEN '''' || feature || '''' END, ', ' ORDER BY psi DESC) AS named
  FROM drift GROUP BY 1)"""


@register("drift_check_log", query(f"""
SELECT {big('dense_rank() OVER (ORDER BY period)')} AS check_id, period AS "check", feature, {r('psi', 6)} AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'alert' END AS flag,
  alerts > 0 AS should_retrain, CASE WHEN alerts = 0 THEN ''
    ELSE alerts || ' feature(s) with PSI > 0.25 (significant shift): [' || named || ']' END AS reasons
FROM drift JOIN decided USING (period)""", CHECKED_YEARS))
def drift_check_log(spark, sf_dir):
    """Later orders are checked year by year, the last year first and once more at the end."""
    root = store.scratch_path(spark, "checks")
    baseline, recent = bridge.drift_sides(spark, sf_dir)
    edges = drift.baseline_edges(baseline, NUMERIC)
    expected = store.stage(drift.bin_counts(baseline, edges, CATEGORICAL), "baseline")
    arrived = store.stage(
        recent.select(*NUMERIC, *CATEGORICAL, F.year("o_orderdate").alias("year")), "recent", ["year"])
    years = sorted(r[0] for r in arrived.select("year").distinct().collect())
    for year in [*years[-1:], *years]:
        counts = drift.bin_counts(arrived.where(F.col("year") == year), edges, CATEGORICAL)
        report = drift.psi_from_counts(expected, counts)
        decision_log.log_check(
            spark, root, str(year), report.withColumn("flag", drift.psi_flag(F.col("psi"))))
    return round_columns(decision_log.logged_checks(spark, root).drop("checked_at"), {"psi": 6})
