"""Survival curves, customer value and hazard regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.scalars import round_columns
from ebbline.operators import cox, survival
from ebbline.plans.registry import register
from ebbline.plans.sql_base import big, over_subscribers, r
from ebbline.sources import bridge, store

CURVES = """
grid AS (SELECT unnest(range(0, 73)) AS t),
hazards AS (
  SELECT c.contract, u.t,
    (SELECT count(*) FROM subscribers s WHERE s.contract = c.contract AND s.tenure >= u.t) AS n,
    (SELECT count(*) FROM subscribers s WHERE s.contract = c.contract AND s.tenure = u.t AND s.churned = 1) AS d
  FROM (SELECT DISTINCT contract FROM subscribers) c CROSS JOIN grid u),
curves AS (
  SELECT a.contract, a.t, any_value(a.n) AS at_risk, any_value(a.d) AS events,
    product(CASE WHEN b.n = 0 THEN 1 ELSE 1 - b.d / CAST(b.n AS DOUBLE) END) AS survival
  FROM hazards a JOIN hazards b ON b.contract = a.contract AND b.t <= a.t GROUP BY 1, 2),
lifetimes AS (
  SELECT a.contract, sum((a.survival + b.survival) / 2) AS lifetime
  FROM curves a JOIN curves b ON b.contract = a.contract AND b.t = a.t + 1 GROUP BY 1)"""

VALUED = CURVES + """,
valued AS (
  SELECT s.*, lifetime AS expected_lifetime_months, monthly_charges * 0.75 * lifetime AS clv,
    250000.0 AS cac, monthly_charges * 0.75 * lifetime / 250000.0 AS ltv_cac_ratio,
    250000.0 / (monthly_charges * 0.75) AS payback_months
  FROM subscribers s LEFT JOIN lifetimes USING (contract))"""


VALUE_COLUMNS = ["customer_id", "contract", "tenure", "churned", "monthly_charges"]


def _staged(spark, sf_dir):
    """The customers, written once: lifetimes, medians and values re-read them."""
    return store.stage(bridge.subscribers(spark, sf_dir).select(*VALUE_COLUMNS), "subscribers")


def _valued(spark, sf_dir):
    subs = _staged(spark, sf_dir)
    return survival.unit_economics(survival.customer_value(subs), bridge.CAC)


@register("survival_curves", over_subscribers(f"""
SELECT contract, CAST(t AS INTEGER) AS t, {big('at_risk')} AS at_risk, {big('events')} AS events,
  {r('survival', 6)} AS survival FROM curves""", CURVES))
def survival_curves(spark, sf_dir):
    curve = survival.survival_curve(bridge.subscribers(spark, sf_dir), ["contract"])
    return round_columns(curve, {"survival": 6})


@register("overall_lifetime", over_subscribers(f"""
SELECT {r('sum((a.s + b.s) / 2)', 4)} AS expected_lifetime_months FROM k a JOIN k b ON b.t = a.t + 1""", """
h AS (SELECT u.t, (SELECT count(*) FROM subscribers s WHERE s.tenure >= u.t) AS n,
        (SELECT count(*) FROM subscribers s WHERE s.tenure = u.t AND s.churned = 1) AS d
      FROM (SELECT unnest(range(0, 73)) AS t) u),
k AS (SELECT a.t, product(CASE WHEN b.n = 0 THEN 1 ELSE 1 - b.d / CAST(b.n AS DOUBLE) END) AS s
      FROM h a JOIN h b ON b.t <= a.t GROUP BY 1)"""))
def overall_lifetime(spark, sf_dir):
    curve = survival.survival_curve(bridge.subscribers(spark, sf_dir))
    return round_columns(survival.expected_lifetime(curve), {"expected_lifetime_months": 4})


@register("lifetime_by_contract", over_subscribers(
    f"SELECT contract, {r('lifetime', 4)} AS expected_lifetime_months FROM lifetimes", CURVES))
def lifetime_by_contract(spark, sf_dir):
    lifetimes = survival.lifetime_by_segment(bridge.subscribers(spark, sf_dir))
    return round_columns(lifetimes, {"expected_lifetime_months": 4})


@register("customer_value", over_subscribers(f"""
SELECT customer_id, contract, monthly_charges, {r('expected_lifetime_months', 4)} AS expected_lifetime_months,
  {r('clv', 2)} AS clv FROM valued""", VALUED))
def customer_value(spark, sf_dir):
    valued = survival.customer_value(_staged(spark, sf_dir)).select(
        "customer_id", "contract", "monthly_charges", "expected_lifetime_months", "clv"
    )
    return round_columns(valued, {"expected_lifetime_months": 4, "clv": 2})


@register("unit_economics", over_subscribers(f"""
SELECT customer_id, {r('clv', 2)} AS clv, cac::DOUBLE AS cac, {r('ltv_cac_ratio', 4)} AS ltv_cac_ratio,
  {r('payback_months', 4)} AS payback_months FROM valued""", VALUED))
def unit_economics(spark, sf_dir):
    report = _valued(spark, sf_dir).select(
        "customer_id", "clv", "cac", "ltv_cac_ratio", "payback_months"
    )
    return round_columns(report, {"clv": 2, "ltv_cac_ratio": 4, "payback_months": 4})


@register("value_tiers", over_subscribers(f"""
SELECT CASE WHEN clv <= q33 THEN 'Low Value' WHEN clv <= q66 THEN 'Medium Value' ELSE 'High Value' END AS clv_segment,
  {big('count(*)')} AS customers, {r('sum(clv)', 2)} AS clv
FROM valued, (SELECT quantile_cont(clv, 0.33) AS q33, quantile_cont(clv, 0.66) AS q66 FROM valued)
GROUP BY 1""", VALUED))
def value_tiers(spark, sf_dir):
    tiers = survival.value_tiers(_valued(spark, sf_dir)).groupBy("clv_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("clv").alias("clv")
    )
    return round_columns(tiers, {"clv": 2})


def scenario_sql(reductions: str) -> str:
    per_month = "total / n * 0.75"
    return over_subscribers(f"""
SELECT 'BUILDING' AS segment, CAST(reduction AS DOUBLE) AS reduction, {big('n')} AS n_customers,
  {r('1 - s_end', 6)} AS churn_incidence_old, {r('1 - target', 6)} AS churn_incidence_new,
  {r('old', 4)} AS expected_lifetime_old, {r('new', 4)} AS expected_lifetime_new,
  {r(f'{per_month} * old', 2)} AS clv_per_customer_old, {r(f'{per_month} * new', 2)} AS clv_per_customer_new,
  {r(f'{per_month} * old * n', 0)} AS portfolio_clv_old, {r(f'{per_month} * new * n', 0)} AS portfolio_clv_new,
  {r(f'({per_month} * new - {per_month} * old) * n', 0)} AS incremental_portfolio_clv,
  CAST(NULL AS VARCHAR) AS note
FROM (
  SELECT reduction, any_value(s_end) AS s_end, any_value(target) AS target,
    sum((a.survival + b.survival) / 2) AS old,
    sum((power(a.survival, ln(target) / ln(s_end)) + power(b.survival, ln(target) / ln(s_end))) / 2) AS new
  FROM curves a JOIN curves b ON b.contract = a.contract AND b.t = a.t + 1
  CROSS JOIN (SELECT reduction, s_end, 1 - greatest(1 - s_end - reduction, 0.001) AS target
              FROM (SELECT survival AS s_end FROM curves WHERE contract = 'BUILDING' AND t = 72),
                   (SELECT unnest([{reductions}]) AS reduction))
  WHERE a.contract = 'BUILDING' GROUP BY reduction),
  (SELECT count(*) AS n, sum(monthly_charges) AS total FROM subscribers WHERE contract = 'BUILDING')""", CURVES)


SCENARIO_DIGITS = {
    "churn_incidence_old": 6, "churn_incidence_new": 6, "expected_lifetime_old": 4,
    "expected_lifetime_new": 4, "clv_per_customer_old": 2, "clv_per_customer_new": 2,
    "portfolio_clv_old": 0, "portfolio_clv_new": 0, "incremental_portfolio_clv": 0,
}


@register("churn_reduction_scenario", scenario_sql("0.05::DOUBLE"))
def churn_reduction_scenario(spark, sf_dir):
    scenario = survival.churn_reduction_scenario(
        bridge.subscribers(spark, sf_dir), bridge.SCENARIO_SEGMENT
    )
    return round_columns(scenario, SCENARIO_DIGITS)


@register("churn_reduction_sensitivity", scenario_sql(
    ", ".join(f"{x}::DOUBLE" for x in (0.02, 0.05, 0.08, 0.10, 0.15))))
def churn_reduction_sensitivity(spark, sf_dir):
    scenario = survival.churn_reduction_scenario(
        bridge.subscribers(spark, sf_dir), bridge.SCENARIO_SEGMENT, [0.02, 0.05, 0.08, 0.10, 0.15]
    )
    return round_columns(scenario, SCENARIO_DIGITS)


def even(expr: str) -> str:
    return f"round_even(round({expr}, 5), 2)"


@register("value_summary", over_subscribers(f"""
SELECT contract, {big('count(clv)')} AS n_customers, {even('avg(clv)')} AS avg_clv, {even('median(clv)')} AS median_clv,
  {even('avg(monthly_charges)')} AS avg_monthly_charges, {even('avg(expected_lifetime_months)')} AS avg_lifetime_months,
  {even('avg(payback_months)')} AS avg_payback_months, {even('avg(ltv_cac_ratio)')} AS avg_ltv_cac
FROM valued GROUP BY contract""", VALUED))
def value_summary(spark, sf_dir):
    return survival.value_summary(_valued(spark, sf_dir))


@register("value_kpis", over_subscribers(f"""
SELECT {r('avg(clv)', 2)} AS avg_clv, {r('median(clv)', 2)} AS median_clv, {r('avg(ltv_cac_ratio)', 4)} AS avg_ltv_cac,
  {r('avg(payback_months)', 4)} AS avg_payback_months,
  {r('avg(CASE WHEN ltv_cac_ratio >= 3 THEN 1.0 ELSE 0 END)', 6)} AS pct_healthy_ltv_cac,
  {r('sum(clv)', 0)} AS total_portfolio_clv FROM valued""", VALUED))
def value_kpis(spark, sf_dir):
    return round_columns(survival.value_kpis(_valued(spark, sf_dir)), {
        "avg_clv": 2, "median_clv": 2, "avg_ltv_cac": 4, "avg_payback_months": 4,
        "pct_healthy_ltv_cac": 6, "total_portfolio_clv": 0,
    })


@register("fixed_sample", over_subscribers(f"""
SELECT customer_id, contract, monthly_charges, {r('clv', 2)} AS clv,
  {r('expected_lifetime_months', 4)} AS expected_lifetime_months
FROM valued ORDER BY md5(customer_id || '-42'), customer_id LIMIT 1500""", VALUED))
def fixed_sample(spark, sf_dir):
    valued = _valued(spark, sf_dir).select(
        "customer_id", "contract", "monthly_charges", "clv", "expected_lifetime_months"
    )
    chosen = survival.fixed_sample(valued, 1500)
    return round_columns(chosen, {"expected_lifetime_months": 4, "clv": 2})


def _cox_fit(spark, sf_dir):
    subs = bridge.subscribers(spark, sf_dir).select(
        "tenure", "churned", "monthly_charges", "senior_citizen", "contract", "internet_service"
    )
    design, names = cox.cox_design(
        store.stage(subs, "subscribers"), "tenure", "churned",
        ["monthly_charges", "senior_citizen"], ["contract", "internet_service"],
    )
    return cox.fit_cox(design, names)


@register("cox_hazard_ratios")
def cox_hazard_ratios(spark, sf_dir):
    return cox.hazard_ratios(spark, _cox_fit(spark, sf_dir))


@register("cox_proportionality_test")
def cox_proportionality_test(spark, sf_dir):
    return cox.proportionality_test(spark, _cox_fit(spark, sf_dir))
