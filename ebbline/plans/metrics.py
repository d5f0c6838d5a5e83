"""Churn, revenue, unit-economics and profiling reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.scalars import EARLY_LIFE_BANDS, FEATURE_BANDS, round_columns
from ebbline.operators import churn_metrics, profile, revenue, unit_economics
from ebbline.plans.registry import register
from ebbline.plans.sql_base import big, over_subscribers, r
from ebbline.sources import bridge, store

CHURN_COLUMNS = f"""
  {big('count(*)')} AS customers, {big('sum(churned)')} AS churned,
  {r('avg(churned) * 100', 2)} AS churn_rate_pct,
  {r('avg(monthly_charges)', 2)} AS avg_monthly_charges"""


def staged_subscribers(spark, sf_dir, *columns):
    """Some columns of the customers, written once for reports that re-read them."""
    return store.stage(bridge.subscribers(spark, sf_dir).select(*columns), "subscribers")


def churn_sql(*dims: str) -> str:
    keys = ", ".join(dims)
    return over_subscribers(f"SELECT {keys}, {CHURN_COLUMNS} FROM subscribers GROUP BY {keys}")


def banded_sql(cases: str) -> str:
    return over_subscribers(
        f"""SELECT tenure_band, {CHURN_COLUMNS}
        FROM (SELECT *, coalesce(CASE {cases} END, 'outside') AS tenure_band FROM subscribers)
        GROUP BY 1"""
    )


@register("overall_churn", over_subscribers(f"""
SELECT {big('count(*)')} AS total_customers, {big('sum(churned)')} AS churned_customers,
  {r('avg(churned) * 100', 2)} AS churn_rate_pct,
  {r('avg(monthly_charges)', 2)} AS avg_monthly_charges,
  {r('sum(monthly_charges)', 0)} AS total_mrr FROM subscribers"""))
def overall_churn(spark, sf_dir):
    return churn_metrics.overall_churn(bridge.subscribers(spark, sf_dir))


@register("churn_by_contract", churn_sql("contract"))
def churn_by_contract(spark, sf_dir):
    return churn_metrics.churn_by(bridge.subscribers(spark, sf_dir), ["contract"])


@register("churn_by_internet_service", churn_sql("internet_service"))
def churn_by_internet_service(spark, sf_dir):
    return churn_metrics.churn_by(bridge.subscribers(spark, sf_dir), ["internet_service"])


@register("churn_by_payment_method", churn_sql("payment_method"))
def churn_by_payment_method(spark, sf_dir):
    return churn_metrics.churn_by(bridge.subscribers(spark, sf_dir), ["payment_method"])


@register("churn_by_support_services", churn_sql("tech_support", "online_security"))
def churn_by_support_services(spark, sf_dir):
    return churn_metrics.churn_by(
        bridge.subscribers(spark, sf_dir), ["tech_support", "online_security"]
    )


@register("churn_by_tenure_band", banded_sql("""
  WHEN tenure BETWEEN 0 AND 12 THEN '00-12 months' WHEN tenure BETWEEN 13 AND 24 THEN '13-24 months'
  WHEN tenure BETWEEN 25 AND 36 THEN '25-36 months' WHEN tenure BETWEEN 37 AND 48 THEN '37-48 months'
  WHEN tenure BETWEEN 49 AND 60 THEN '49-60 months' ELSE '61+ months'"""))
def churn_by_tenure_band(spark, sf_dir):
    return churn_metrics.churn_by_band(bridge.subscribers(spark, sf_dir))


@register("churn_by_feature_band", banded_sql("""
  WHEN tenure > 0 AND tenure <= 12 THEN '0-12 mo' WHEN tenure > 12 AND tenure <= 24 THEN '13-24 mo'
  WHEN tenure > 24 AND tenure <= 36 THEN '25-36 mo' WHEN tenure > 36 AND tenure <= 48 THEN '37-48 mo'
  WHEN tenure > 48 AND tenure <= 60 THEN '49-60 mo' WHEN tenure > 60 AND tenure <= 72 THEN '61-72 mo'"""))
def churn_by_feature_band(spark, sf_dir):
    return churn_metrics.churn_by_band(bridge.subscribers(spark, sf_dir), FEATURE_BANDS)


@register("churn_by_early_life_band", over_subscribers(f"""
SELECT d.label AS tenure_band, {big('count(s.customer_id)')} AS customers,
  {big('coalesce(sum(churned), 0)')} AS churned,
  {r('avg(churned) * 100', 2)} AS churn_rate_pct,
  {r('avg(monthly_charges)', 2)} AS avg_monthly_charges
FROM (VALUES ('0–6 mo', 0, 6), ('7–12 mo', 6, 12), ('13–24 mo', 12, 24), ('25–36 mo', 24, 36),
             ('37–48 mo', 36, 48), ('49–72 mo', 48, 72), ('outside', NULL, NULL)) d(label, lo, hi)
LEFT JOIN subscribers s ON CASE WHEN d.lo IS NULL THEN (s.tenure > 0 AND s.tenure <= 72) IS NOT TRUE
  ELSE s.tenure > d.lo AND s.tenure <= d.hi END GROUP BY 1"""))
def churn_by_early_life_band(spark, sf_dir):
    return churn_metrics.churn_by_band(
        bridge.subscribers(spark, sf_dir), EARLY_LIFE_BANDS, keep_empty=True
    )


@register("churn_grouping_sets", over_subscribers(f"""
SELECT 'all' AS dimension, 'all' AS value, {CHURN_COLUMNS} FROM subscribers
UNION ALL SELECT 'contract', contract, {CHURN_COLUMNS} FROM subscribers GROUP BY contract
UNION ALL SELECT 'internet_service', internet_service, {CHURN_COLUMNS} FROM subscribers GROUP BY internet_service
UNION ALL SELECT 'tech_support', CAST(tech_support AS VARCHAR), {CHURN_COLUMNS} FROM subscribers GROUP BY tech_support"""))
def churn_grouping_sets(spark, sf_dir):
    return churn_metrics.churn_grouping_sets(
        bridge.subscribers(spark, sf_dir), ["contract", "internet_service", "tech_support"]
    )


@register("revenue_at_risk", over_subscribers(f"""
SELECT contract, {r('sum(CASE WHEN churned = 1 THEN monthly_charges ELSE 0 END)', 2)} AS churned_mrr,
  {r('sum(monthly_charges)', 2)} AS total_mrr,
  {r('sum(CASE WHEN churned = 1 THEN monthly_charges ELSE 0 END) / sum(monthly_charges) * 100', 2)} AS pct_mrr_at_risk
FROM subscribers GROUP BY contract"""))
def revenue_at_risk(spark, sf_dir):
    return round_columns(
        churn_metrics.revenue_at_risk(bridge.subscribers(spark, sf_dir)),
        {"churned_mrr": 2, "total_mrr": 2},
    )


@register("top_churned_customers", over_subscribers("""
SELECT customer_id, contract, tenure, monthly_charges, internet_service, tech_support, online_security
FROM subscribers WHERE churned = 1 ORDER BY monthly_charges DESC, customer_id LIMIT 20"""))
def top_churned_customers(spark, sf_dir):
    return churn_metrics.top_churned(bridge.subscribers(spark, sf_dir))


@register("active_customers", over_subscribers(
    "SELECT customer_id, contract, monthly_charges FROM subscribers WHERE churned = 0"))
def active_customers(spark, sf_dir):
    return churn_metrics.active(bridge.subscribers(spark, sf_dir)).select(
        "customer_id", "contract", "monthly_charges"
    )


@register("preview_customers", over_subscribers(
    "SELECT customer_id, contract, tenure, monthly_charges FROM subscribers ORDER BY customer_id LIMIT 5"))
def preview_customers(spark, sf_dir):
    subs = bridge.subscribers(spark, sf_dir)
    return profile.preview(
        subs.select("customer_id", "contract", "tenure", "monthly_charges"), ["customer_id"]
    )


@register("mrr_snapshot", over_subscribers(f"""
SELECT {r('sum(monthly_charges)', 0)} AS current_mrr, {big('count(*)')} AS active_customers,
  {r('avg(monthly_charges)', 2)} AS arpu, {r('median(monthly_charges)', 2)} AS median_arpu
FROM subscribers WHERE churned = 0"""))
def mrr_snapshot(spark, sf_dir):
    return revenue.mrr_snapshot(staged_subscribers(spark, sf_dir, "churned", "monthly_charges"))


def mrr_by_sql(segment: str) -> str:
    return over_subscribers(f"""
SELECT {segment}, {big('count(*)')} AS active_customers, {r('sum(monthly_charges)', 0)} AS mrr,
  {r('avg(monthly_charges)', 2)} AS arpu,
  {r('sum(monthly_charges) / (SELECT sum(monthly_charges) FROM subscribers WHERE churned = 0) * 100', 1)} AS pct_of_total_mrr
FROM subscribers WHERE churned = 0 GROUP BY {segment}""")


@register("mrr_by_contract", mrr_by_sql("contract"))
def mrr_by_contract(spark, sf_dir):
    return revenue.mrr_by(bridge.subscribers(spark, sf_dir), "contract")


@register("mrr_by_internet_service", mrr_by_sql("internet_service"))
def mrr_by_internet_service(spark, sf_dir):
    return revenue.mrr_by(bridge.subscribers(spark, sf_dir), "internet_service")


@register("mrr_series", over_subscribers(f"""
SELECT month, {big('count(DISTINCT customer_id)')} AS active_customers,
  {r('sum(monthly_charges)', 0)} AS mrr, {r('avg(monthly_charges)', 2)} AS arpu
FROM (SELECT customer_id, monthly_charges,
        CAST(signup_month + to_months(CAST(m.month_offset - 1 AS INTEGER)) AS DATE) AS month
      FROM subscribers CROSS JOIN (SELECT unnest(range(1, (SELECT max(tenure) + 1 FROM subscribers))) AS month_offset) m
      WHERE m.month_offset <= tenure)
WHERE month <= DATE '2001-08-01' GROUP BY month"""))
def mrr_series(spark, sf_dir):
    return revenue.mrr_series(bridge.subscribers(spark, sf_dir), bridge.REFERENCE_DATE)


@register("revenue_concentration", over_subscribers(f"""
SELECT CAST(decile AS INTEGER) AS decile, {big('count(*)')} AS customers,
  {r('sum(monthly_charges)', 0)} AS mrr,
  {r('sum(monthly_charges) / (SELECT sum(monthly_charges) FROM subscribers WHERE churned = 0) * 100', 1)} AS pct_of_total_mrr
FROM (SELECT monthly_charges, ntile(10) OVER (ORDER BY monthly_charges DESC, customer_id) AS decile
      FROM subscribers WHERE churned = 0) GROUP BY decile"""))
def revenue_concentration(spark, sf_dir):
    return revenue.revenue_concentration(bridge.subscribers(spark, sf_dir))


@register("naive_unit_economics", over_subscribers(f"""
SELECT contract, {r('rate * 100', 2)} AS churn_rate_pct,
  {r('1.0 / nullif(rate, 0)', 1)} AS expected_lifetime_months,
  {r('charge', 2)} AS avg_monthly_charges, {r('charge * 0.75 / nullif(rate, 0)', 0)} AS avg_clv,
  {r('250000.0 / (charge * 0.75)', 1)} AS payback_months,
  {r('charge * 0.75 / nullif(rate, 0) / 250000.0', 1)} AS ltv_cac_ratio
FROM (SELECT contract, avg(churned) AS rate, avg(monthly_charges) AS charge
      FROM subscribers GROUP BY contract)"""))
def naive_unit_economics(spark, sf_dir):
    return unit_economics.naive_unit_economics(bridge.subscribers(spark, sf_dir), bridge.CAC)


CONTRACT_CHURN = "contract_churn AS (SELECT contract, avg(churned) AS rate FROM subscribers GROUP BY contract)"


@register("naive_clv", over_subscribers(f"""
SELECT customer_id, contract, monthly_charges, tenure, churned,
  {r('rate', 6)} AS segment_churn_rate, {r('monthly_charges * 0.75 / nullif(rate, 0)', 0)} AS clv,
  {r('250000.0 / (monthly_charges * 0.75)', 1)} AS payback_months,
  {r('monthly_charges * 0.75 / nullif(rate, 0) / 250000.0', 2)} AS ltv_cac_ratio
FROM subscribers JOIN contract_churn USING (contract)""", CONTRACT_CHURN))
def naive_clv(spark, sf_dir):
    subs = staged_subscribers(
        spark, sf_dir, "customer_id", "contract", "monthly_charges", "tenure", "churned"
    )
    clv = unit_economics.naive_clv(subs, bridge.CAC)
    return round_columns(clv, {"segment_churn_rate": 6})


@register("naive_health", over_subscribers(f"""
SELECT {r('avg(v)', 2)} AS avg_ltv_cac, {r('avg(CASE WHEN v >= 3 THEN 1.0 ELSE 0 END) * 100', 1)} AS pct_healthy,
  {r('avg(CASE WHEN v < 1 THEN 1.0 ELSE 0 END) * 100', 1)} AS pct_underwater
FROM (SELECT monthly_charges * 0.75 / nullif(rate, 0) / 250000.0 AS v
      FROM subscribers JOIN contract_churn USING (contract))""", CONTRACT_CHURN))
def naive_health(spark, sf_dir):
    subs = staged_subscribers(spark, sf_dir, "contract", "monthly_charges", "churned")
    return unit_economics.naive_health(subs, bridge.CAC)


@register("naive_churn_reduction", over_subscribers(f"""
SELECT {r('rate * 100', 1)} AS current_churn_pct, {r('reduced * 100', 1)} AS reduced_churn_pct,
  {r('charge * 0.75 / nullif(rate, 0)', 0)} AS clv_before, {r('charge * 0.75 / reduced', 0)} AS clv_after,
  {r('n * charge * 0.75 * (1 / reduced - 1 / nullif(rate, 0))', 0)} AS total_incremental_clv
FROM (SELECT *, greatest(rate - 0.10, 0.01) AS reduced
      FROM (SELECT avg(churned) AS rate, avg(monthly_charges) AS charge, count(*) AS n
            FROM subscribers WHERE contract = 'BUILDING'))"""))
def naive_churn_reduction(spark, sf_dir):
    return unit_economics.naive_churn_reduction(
        bridge.subscribers(spark, sf_dir), bridge.SCENARIO_SEGMENT
    )


@register("value_distribution", over_subscribers(f"""
SELECT contract, {big('count(*)')} AS customers,
  {r('count(*) * 100.0 / (SELECT count(*) FROM subscribers)', 2)} AS pct
FROM subscribers GROUP BY contract"""))
def value_distribution(spark, sf_dir):
    return profile.value_distribution(bridge.subscribers(spark, sf_dir), "contract")


def describe_sql() -> str:
    nulls = "NULL::BIGINT AS n_unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq"
    numeric = [
        f"""SELECT '{c}' AS column_name, {big(f'count({c})')} AS n_values, {nulls},
        {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})', 4)} AS min,
        {r(f'quantile_cont({c}, 0.25)', 4)} AS p25, {r(f'quantile_cont({c}, 0.5)', 4)} AS p50,
        {r(f'quantile_cont({c}, 0.75)', 4)} AS p75, {r(f'max({c})', 4)} AS max FROM subscribers"""
        for c in ["tenure", "monthly_charges", "total_charges"]
    ]
    text = [
        f"""SELECT '{c}', {big(f'count({c})')}, {big(f'count(DISTINCT {c})')},
        (SELECT {c} FROM subscribers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        (SELECT {big('count(*)')} AS k FROM subscribers GROUP BY {c} ORDER BY k DESC LIMIT 1),
        NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM subscribers"""
        for c in ["contract", "internet_service", "payment_method"]
    ]
    return over_subscribers("\nUNION ALL ".join(numeric + text))


@register("describe_columns", describe_sql())
def describe_columns(spark, sf_dir):
    numeric = ["tenure", "monthly_charges", "total_charges"]
    text = ["contract", "internet_service", "payment_method"]
    subs = staged_subscribers(spark, sf_dir, *numeric, *text)
    report = profile.describe_columns(subs, numeric, text)
    return round_columns(report, {c: 4 for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]})


CORRELATED = ["tenure", "churned", "monthly_charges", "total_charges", "tech_support"]


@register("correlations", over_subscribers("\nUNION ALL ".join(
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, {r(f'corr({a}, {b})', 6)} AS correlation FROM subscribers"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:])))
def correlations(spark, sf_dir):
    return round_columns(
        profile.correlations(bridge.subscribers(spark, sf_dir), CORRELATED), {"correlation": 6}
    )


@register("charge_histogram", over_subscribers(f"""
SELECT CAST(bucket AS INTEGER) AS bucket, churned, {r('lo + bucket * w', 4)} AS bucket_from,
  {r('lo + (bucket + 1) * w', 4)} AS bucket_to, {big('count(*)')} AS customers
FROM (SELECT churned, lo, w, least(floor((monthly_charges - lo) / w), 39) AS bucket
      FROM subscribers, (SELECT min(monthly_charges) AS lo,
        (max(monthly_charges) - min(monthly_charges)) / 40 AS w FROM subscribers))
GROUP BY bucket, churned, lo, w"""))
def charge_histogram(spark, sf_dir):
    subs = staged_subscribers(spark, sf_dir, "monthly_charges", "churned")
    report = profile.histogram(subs, "monthly_charges", 40, "churned")
    return round_columns(report, {"bucket_from": 4, "bucket_to": 4})


@register("key_check", over_subscribers(f"""
SELECT {big('count(*)')} AS n_rows, {big('count(DISTINCT customer_id)')} AS distinct_keys FROM subscribers"""))
def key_check(spark, sf_dir):
    return profile.key_check(bridge.subscribers(spark, sf_dir), "customer_id")


@register("adhoc_sql", over_subscribers(f"""
SELECT contract, {big('count(*)')} AS customers, {r('avg(monthly_charges)', 2)} AS avg_mrr
FROM subscribers GROUP BY contract"""))
def adhoc_sql(spark, sf_dir):
    bridge.register_views(spark, sf_dir)
    return spark.sql(
        """SELECT contract, count(*) AS customers,
                  round(round(avg(monthly_charges), 5), 2) AS avg_mrr
           FROM subscribers GROUP BY contract"""
    )


@register("numeric_columns", over_subscribers("SELECT " + ", ".join(
    f"{big(f'count({c})')} AS {c}" for c in [
        "customer_id", "tech_support", "online_security", "senior_citizen", "tenure", "churned",
        "total_charges", "monthly_charges",
    ]) + " FROM subscribers"))
def numeric_columns(spark, sf_dir):
    subs = bridge.subscribers(spark, sf_dir)
    names = profile.numeric_columns(subs)
    return subs.agg(*[F.count(c).alias(c) for c in names])
