"""Cohort retention, MRR series and net revenue retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.scalars import round_columns
from ebbline.operators import cohort, mrr, nrr
from ebbline.plans.registry import register
from ebbline.plans.sql_base import (
    PANEL_EVENTS3D,
    PANEL_ORDERS12,
    SUBSCRIBERS,
    big,
    over_subscribers,
    query,
    r,
)
from ebbline.sources import bridge

OFFSETS = "offsets AS (SELECT unnest(range(0, 25)) AS month_offset)"

COHORTS = f"""
cohort_max AS (
  SELECT signup_month, count(*) AS cohort_size, max(tenure) AS longest FROM subscribers GROUP BY 1),
cohorts AS (
  SELECT strftime(s.signup_month, '%Y-%m') AS cohort, CAST(o.month_offset AS INTEGER) AS month_offset,
    {big('any_value(m.cohort_size)')} AS cohort_size,
    {big('count(*) FILTER (WHERE s.tenure >= o.month_offset)')} AS active_customers,
    count(*) FILTER (WHERE s.tenure >= o.month_offset) / CAST(any_value(m.cohort_size) AS DOUBLE) AS retention_rate
  FROM subscribers s JOIN cohort_max m USING (signup_month)
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(tenure) + 1 FROM subscribers))) AS month_offset) o
  WHERE o.month_offset <= m.longest GROUP BY 1, 2),
mature AS (
  SELECT * FROM cohorts WHERE month_offset <= 24 AND cohort IN (
    SELECT cohort FROM cohorts WHERE month_offset <= 24 GROUP BY 1 HAVING count(retention_rate) >= 12))"""


@register("cohort_sizes", over_subscribers(f"""
SELECT signup_month, {big('count(*)')} AS cohort_size, {r('avg(monthly_charges)', 2)} AS avg_arpu,
  {r('avg(churned) * 100', 2)} AS eventual_churn_rate_pct FROM subscribers GROUP BY 1"""))
def cohort_sizes(spark, sf_dir):
    return cohort.cohort_sizes(bridge.subscribers(spark, sf_dir))


@register("cohort_retention", over_subscribers(f"""
SELECT t.signup_month, CAST(t.month_offset AS INTEGER) AS month_offset, {big('b.cohort_size')} AS cohort_size,
  {big('t.still_active')} AS still_active, {r('t.still_active / CAST(b.cohort_size AS DOUBLE) * 100', 1)} AS retention_pct
FROM (SELECT s.signup_month, o.month_offset, count(*) AS still_active
      FROM subscribers s CROSS JOIN offsets o WHERE s.tenure >= o.month_offset GROUP BY 1, 2) t
JOIN (SELECT signup_month, count(*) AS cohort_size FROM subscribers GROUP BY 1) b USING (signup_month)""", OFFSETS))
def cohort_retention(spark, sf_dir):
    return cohort.cohort_retention(bridge.subscribers(spark, sf_dir))


@register("average_retention", over_subscribers(f"""
SELECT CAST(o.month_offset AS INTEGER) AS month_offset, {big('count(*)')} AS still_active,
  {r('count(*) / CAST((SELECT count(*) FROM subscribers) AS DOUBLE) * 100', 1)} AS avg_retention_pct
FROM subscribers s CROSS JOIN offsets o WHERE s.tenure >= o.month_offset GROUP BY 1""", OFFSETS))
def average_retention(spark, sf_dir):
    return cohort.average_retention(bridge.subscribers(spark, sf_dir))


@register("revenue_retention", over_subscribers(f"""
SELECT t.signup_month, CAST(t.month_offset AS INTEGER) AS month_offset, {r('b.cohort_mrr', 2)} AS cohort_mrr,
  {r('t.retained', 2)} AS retained_mrr, {r('t.retained / b.cohort_mrr * 100', 1)} AS revenue_retention_pct
FROM (SELECT s.signup_month, o.month_offset, sum(s.monthly_charges) AS retained
      FROM subscribers s CROSS JOIN offsets o WHERE s.tenure >= o.month_offset GROUP BY 1, 2) t
JOIN (SELECT signup_month, sum(monthly_charges) AS cohort_mrr FROM subscribers GROUP BY 1) b USING (signup_month)""", OFFSETS))
def revenue_retention(spark, sf_dir):
    return round_columns(
        cohort.revenue_retention(bridge.subscribers(spark, sf_dir)),
        {"cohort_mrr": 2, "retained_mrr": 2},
    )


@register("cohort_table", over_subscribers(f"""
SELECT cohort, month_offset, cohort_size, active_customers, {r('retention_rate', 6)} AS retention_rate FROM cohorts""", COHORTS))
def cohort_table(spark, sf_dir):
    return round_columns(
        cohort.cohort_table(bridge.subscribers(spark, sf_dir)), {"retention_rate": 6}
    )


@register("retention_matrix", over_subscribers(
    "SELECT cohort, " + ", ".join(
        r(f"max(CASE WHEN month_offset = {n} THEN retention_rate END)", 6) + f" AS m{n}" for n in range(25)
    ) + " FROM mature GROUP BY cohort", COHORTS))
def retention_matrix(spark, sf_dir):
    matrix = cohort.pivot_retention(cohort.cohort_table(bridge.subscribers(spark, sf_dir)))
    return round_columns(matrix, {f"m{n}": 6 for n in range(25)})


def milestones_sql(offsets: str) -> str:
    return over_subscribers(f"""
SELECT month_offset, {big('count(*)')} AS cohorts, {r('avg(retention_rate)', 6)} AS avg_retention
FROM mature WHERE month_offset IN ({offsets}) GROUP BY 1""", COHORTS)


@register("retention_milestones", milestones_sql("1, 3, 6, 12"))
def retention_milestones(spark, sf_dir):
    table = cohort.cohort_table(bridge.subscribers(spark, sf_dir))
    return round_columns(cohort.retention_milestones(table), {"avg_retention": 6})


@register("retention_decay", milestones_sql("0, 1, 2, 3, 6, 12"))
def retention_decay(spark, sf_dir):
    table = cohort.cohort_table(bridge.subscribers(spark, sf_dir))
    decay = cohort.retention_milestones(table, [0, 1, 2, 3, 6, 12])
    return round_columns(decay, {"avg_retention": 6})


@register("latest_cohort_curves", over_subscribers(f"""
SELECT cohort, month_offset, {r('retention_rate', 6)} AS retention_rate
FROM (SELECT *, dense_rank() OVER (ORDER BY cohort DESC) AS age FROM mature) WHERE age <= 8""", COHORTS))
def latest_cohort_curves(spark, sf_dir):
    table = cohort.cohort_table(bridge.subscribers(spark, sf_dir))
    return round_columns(cohort.latest_cohort_curves(table), {"retention_rate": 6})


LONG_MRR = """
starts AS (
  SELECT *, CAST(CASE WHEN day(signup_date) = 1 THEN signup_date
                 ELSE date_trunc('month', signup_date) + INTERVAL 1 MONTH END AS DATE) AS m1
  FROM subscribers),
long_mrr AS (
  SELECT CAST(m1 + to_months(CAST(k AS INTEGER)) AS DATE) AS month, customer_id, monthly_charges AS mrr,
         churned = 1 AND k = tenure - 1 AS churned, contract
  FROM starts CROSS JOIN (SELECT unnest(range(0, 200)) AS k)
  WHERE k < tenure AND m1 + to_months(CAST(k AS INTEGER)) <= DATE '2001-08-01')"""

MONTHLY = LONG_MRR + """,
monthly AS (
  SELECT month, sum(mrr) AS total_mrr, count(DISTINCT customer_id) AS active_customers,
         count(*) FILTER (WHERE churned) AS churned_customers,
         sum(mrr) / count(DISTINCT customer_id) AS avg_revenue_per_customer,
         count(*) FILTER (WHERE churned) / CAST(count(DISTINCT customer_id) AS DOUBLE) AS churn_rate
  FROM long_mrr GROUP BY month)"""

DECOMPOSED = MONTHLY + """,
changes AS (SELECT *, total_mrr - lag(total_mrr) OVER (ORDER BY month) AS mrr_change FROM monthly),
decomposed AS (
  SELECT *, churned_customers * avg_revenue_per_customer AS churned_mrr,
         greatest(mrr_change + churned_customers * avg_revenue_per_customer, 0) AS new_mrr
  FROM changes WHERE mrr_change IS NOT NULL)"""

MONTHLY_SELECT = f"""
SELECT month, {r('total_mrr', 2)} AS total_mrr, {big('active_customers')} AS active_customers,
  {big('churned_customers')} AS churned_customers, {r('avg_revenue_per_customer', 2)} AS avg_revenue_per_customer,
  {r('churn_rate', 6)} AS churn_rate, strftime(month, '%Y-%m') AS month_str"""
MONTHLY_DIGITS = {"total_mrr": 2, "avg_revenue_per_customer": 2, "churn_rate": 6}
CHANGES = f""", {r('mrr_change', 2)} AS mrr_change, {r('churned_mrr', 2)} AS churned_mrr, {r('new_mrr', 2)} AS new_mrr"""
CHANGE_DIGITS = MONTHLY_DIGITS | {"mrr_change": 2, "churned_mrr": 2, "new_mrr": 2}


def _monthly(spark, sf_dir):
    return mrr.monthly_totals(bridge.subscribers(spark, sf_dir), bridge.REFERENCE_DATE)


@register("customer_months", over_subscribers(
    "SELECT month, customer_id, mrr, churned, contract FROM long_mrr", LONG_MRR))
def customer_months(spark, sf_dir):
    return mrr.customer_months(bridge.subscribers(spark, sf_dir), bridge.REFERENCE_DATE)


@register("mrr_from_customer_months", over_subscribers(MONTHLY_SELECT + " FROM monthly", MONTHLY))
def mrr_from_customer_months(spark, sf_dir):
    long = mrr.customer_months(bridge.subscribers(spark, sf_dir), bridge.REFERENCE_DATE)
    return round_columns(mrr.aggregate_months(long), MONTHLY_DIGITS)


@register("monthly_mrr", over_subscribers(MONTHLY_SELECT + " FROM monthly", MONTHLY))
def monthly_mrr(spark, sf_dir):
    return round_columns(_monthly(spark, sf_dir), MONTHLY_DIGITS)


@register("mrr_decomposition", over_subscribers(MONTHLY_SELECT + CHANGES + " FROM decomposed", DECOMPOSED))
def mrr_decomposition(spark, sf_dir):
    return round_columns(mrr.mrr_decomposition(_monthly(spark, sf_dir)), CHANGE_DIGITS)


@register("mrr_latest_months", over_subscribers(
    MONTHLY_SELECT + CHANGES + " FROM decomposed ORDER BY month DESC LIMIT 24", DECOMPOSED))
def mrr_latest_months(spark, sf_dir):
    changes = mrr.mrr_decomposition(_monthly(spark, sf_dir))
    return round_columns(mrr.latest_months(changes), CHANGE_DIGITS)


@register("mrr_kpis", over_subscribers(f"""
SELECT month AS latest_month, {r('total_mrr', 2)} AS latest_total_mrr,
  {big('active_customers')} AS latest_active_customers,
  {r('avg_revenue_per_customer', 2)} AS latest_avg_revenue_per_customer,
  {r('churn_rate', 6)} AS latest_churn_rate,
  {r('(SELECT avg(churn_rate) FROM monthly)', 6)} AS avg_churn_rate
FROM monthly ORDER BY month DESC LIMIT 1""", MONTHLY))
def mrr_kpis(spark, sf_dir):
    return round_columns(mrr.mrr_kpis(_monthly(spark, sf_dir)), {
        "latest_total_mrr": 2, "latest_avg_revenue_per_customer": 2,
        "latest_churn_rate": 6, "avg_churn_rate": 6,
    })


def nrr_cte(segment: str | None = None, panel: str = "panel", ended: str = "false") -> str:
    """The self-join form: last month's customers against this month's.

    `ended` states for a row p without a successor c that only its observation ended.
    """
    key = f"{segment}, " if segment else ""
    same = f" AND p.{segment} = m.{segment}" if segment else ""
    firsts = (
        f"(SELECT min(month) FROM seg_panel f WHERE f.{segment} = m.{segment})" if segment
        else "(SELECT min(month) FROM seg_panel)"
    )
    picked = (
        f"SELECT p.*, s.{segment} FROM {panel} p JOIN subscribers s USING (customer_id)" if segment
        else f"SELECT * FROM {panel}"
    )
    pkey = f"p.{segment}, " if segment else ""
    group = ", ".join(str(i) for i in range(1, 3 if segment else 2))
    using = f"({segment}, month)" if segment else "(month)"
    return f"""
seg_panel AS ({picked}),
ending AS (SELECT {key}month, sum(mrr) AS ending_mrr FROM seg_panel GROUP BY {group}),
moves AS (
  SELECT {pkey}p.month + 1 AS month,
    sum(CASE WHEN c.customer_id IS NULL AND {ended} THEN 0 ELSE p.mrr END) AS start,
    sum(CASE WHEN c.mrr > p.mrr THEN c.mrr - p.mrr ELSE 0 END) AS up,
    sum(CASE WHEN c.mrr < p.mrr THEN p.mrr - c.mrr ELSE 0 END) AS down,
    sum(CASE WHEN c.customer_id IS NULL AND NOT ({ended}) THEN p.mrr ELSE 0 END) AS gone
  FROM seg_panel p LEFT JOIN seg_panel c ON c.customer_id = p.customer_id AND c.month = p.month + 1
  GROUP BY {group}),
parts AS (
  SELECT {key}m.month, ending_mrr,
    CASE WHEN m.month = {firsts} THEN ending_mrr ELSE coalesce(start, 0) END AS starting_mrr,
    coalesce(up, 0) AS expansion_mrr, coalesce(down, 0) AS contraction_mrr, coalesce(gone, 0) AS churned_mrr
  FROM ending m LEFT JOIN moves USING {using}),
nrr AS (
  SELECT *, CASE WHEN starting_mrr > 0 THEN
    (starting_mrr + expansion_mrr - contraction_mrr - churned_mrr) / starting_mrr END AS nrr
  FROM parts)"""


def nrr_select(key: str = "") -> str:
    money = ", ".join(f"{r(c, 2)} AS {c}" for c in nrr.MOVEMENTS[:-1])
    return f"SELECT {key}month, {money}, {r('nrr', 6)} AS nrr FROM nrr"


NRR_DIGITS = {c: 2 for c in nrr.MOVEMENTS[:-1]} | {"nrr": 6}


def nrr_summary_select(key: str = "", window: int = 12) -> str:
    part = f"PARTITION BY {key} " if key else ""
    comma, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""
SELECT {comma}{r('avg(nrr)', 6)} AS avg_nrr, {r('median(nrr)', 6)} AS median_nrr,
  {r('sum(expansion_mrr)', 2)} AS total_expansion_mrr, {r('sum(contraction_mrr)', 2)} AS total_contraction_mrr,
  {r('sum(churned_mrr)', 2)} AS total_churned_mrr, {big('count(*)')} AS months_in_window
FROM (SELECT *, row_number() OVER ({part}ORDER BY month DESC) AS age FROM nrr WHERE nrr IS NOT NULL)
WHERE age <= {window} {group}"""


SUMMARY_DIGITS = {
    "avg_nrr": 6, "median_nrr": 6, "total_expansion_mrr": 2, "total_contraction_mrr": 2,
    "total_churned_mrr": 2,
}


@register("nrr_orders", query(nrr_select(), PANEL_ORDERS12, nrr_cte()))
def nrr_orders(spark, sf_dir):
    return round_columns(nrr.nrr_by_month(bridge.panel_orders12(spark, sf_dir)), NRR_DIGITS)


@register("nrr_orders_observed", query(nrr_select(), SUBSCRIBERS, PANEL_ORDERS12, """
observed AS (
  SELECT p.*, (SELECT max(month) FROM panel o WHERE o.customer_id = p.customer_id) AS last_month,
    coalesce((SELECT churned FROM subscribers s WHERE s.customer_id = p.customer_id), 1) AS churned
  FROM panel p)""", nrr_cte(panel="observed", ended="p.churned = 0 AND p.month >= p.last_month")))
def nrr_orders_observed(spark, sf_dir):
    """Customers who are still active at the end of the data leave without churning."""
    panel = nrr.observed_panel(bridge.panel_orders12(spark, sf_dir), bridge.subscribers(spark, sf_dir))
    return round_columns(nrr.nrr_by_month(panel, observed_until="observed_until"), NRR_DIGITS)


@register("nrr_events", query(nrr_select(), PANEL_EVENTS3D, nrr_cte()))
def nrr_events(spark, sf_dir):
    return round_columns(nrr.nrr_by_month(bridge.panel_events3d(spark, sf_dir)), NRR_DIGITS)


def _segmented(spark, sf_dir):
    return nrr.nrr_by_segment(
        bridge.panel_orders12(spark, sf_dir), bridge.subscribers(spark, sf_dir), "contract"
    )


@register("nrr_by_contract", query(
    nrr_select("contract, "), SUBSCRIBERS, PANEL_ORDERS12, nrr_cte("contract")))
def nrr_by_contract(spark, sf_dir):
    return round_columns(_segmented(spark, sf_dir), NRR_DIGITS)


@register("nrr_summary", query(nrr_summary_select(), PANEL_ORDERS12, nrr_cte()))
def nrr_summary(spark, sf_dir):
    monthly = nrr.nrr_by_month(bridge.panel_orders12(spark, sf_dir))
    return round_columns(nrr.nrr_summary(monthly), SUMMARY_DIGITS)


@register("nrr_summary_trailing", query(nrr_summary_select(window=4), PANEL_EVENTS3D, nrr_cte()))
def nrr_summary_trailing(spark, sf_dir):
    monthly = nrr.nrr_by_month(bridge.panel_events3d(spark, sf_dir))
    return round_columns(nrr.nrr_summary(monthly, window=4), SUMMARY_DIGITS)


@register("nrr_summary_by_contract", query(
    nrr_summary_select("contract"), SUBSCRIBERS, PANEL_ORDERS12, nrr_cte("contract")))
def nrr_summary_by_contract(spark, sf_dir):
    return round_columns(
        nrr.nrr_summary(_segmented(spark, sf_dir), by=["contract"]), SUMMARY_DIGITS
    )


@register("mrr_bridge", query(f"""
SELECT month, step, component, {r('amount', 2)} AS amount FROM (
  SELECT month, unnest([1, 2, 3, 4, 5]) AS step,
    unnest(['Starting MRR', 'Expansion', 'Contraction', 'Churned', 'Ending MRR']) AS component,
    unnest([starting_mrr, expansion_mrr, -contraction_mrr, -churned_mrr,
            starting_mrr + expansion_mrr - contraction_mrr - churned_mrr]) AS amount
  FROM nrr WHERE month = (SELECT CAST(floor(median(month)) AS INTEGER) FROM nrr WHERE nrr IS NOT NULL))""",
    PANEL_EVENTS3D, nrr_cte()))
def mrr_bridge(spark, sf_dir):
    monthly = nrr.nrr_by_month(bridge.panel_events3d(spark, sf_dir))
    return round_columns(nrr.mrr_bridge(monthly), {"amount": 2})


@register("panel_events", query("""
SELECT p.customer_id, p.month, p.mrr,
  CASE WHEN n.customer_id IS NULL AND p.month < (SELECT max(month) FROM panel) THEN 'churn'
       WHEN p.mrr > b.mrr THEN 'expansion' WHEN p.mrr < b.mrr THEN 'contraction' ELSE 'active' END AS event
FROM panel p
LEFT JOIN panel n ON n.customer_id = p.customer_id AND n.month = p.month + 1
LEFT JOIN panel b ON b.customer_id = p.customer_id AND b.month =
  (SELECT max(q.month) FROM panel q WHERE q.customer_id = p.customer_id AND q.month < p.month)""", PANEL_EVENTS3D))
def panel_events(spark, sf_dir):
    return nrr.label_events(bridge.panel_events3d(spark, sf_dir))


@register("churned_between_blocks", query(f"""
SELECT p.month + 1 AS month, p.customer_id, p.mrr FROM panel p
WHERE NOT EXISTS (SELECT 1 FROM panel n WHERE n.customer_id = p.customer_id AND n.month = p.month + 1)
  AND p.month < (SELECT max(month) FROM panel)""", PANEL_ORDERS12))
def churned_between_blocks(spark, sf_dir):
    labelled = nrr.label_events(bridge.panel_orders12(spark, sf_dir))
    return labelled.where(F.col("event") == "churn").select(
        (F.col("month") + 1).alias("month"), "customer_id", "mrr"
    )
