"""Common table expressions from which the SQL counterparts are assembled.

They state the literal form of each derivation (cross joins, self joins), so
that comparing results also checks the scalable form used on Spark.
"""

from __future__ import annotations

SUBSCRIPTION = """
order_summary AS (
  SELECT o_custkey AS customer_id,
         CAST(min(o_orderdate) AS DATE) AS first_order,
         CAST(max(o_orderdate) AS DATE) AS last_order,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents,
         arg_min(o_orderpriority, o_orderkey) AS payment_method,
         max(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS online_security,
         max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS senior_citizen
  FROM orders GROUP BY o_custkey),
subscription AS (
  SELECT s.*, c.c_acctbal, c.c_nationkey,
         c.c_mktsegment AS contract, r.r_name AS internet_service,
         CASE WHEN c.c_acctbal > 5000 THEN 1 ELSE 0 END AS tech_support,
         first_order AS signup_date,
         CAST(date_trunc('month', first_order) AS DATE) AS signup_month,
         CAST(date_diff('month', first_order, last_order) + 1 AS INTEGER) AS tenure,
         CASE WHEN last_order < DATE '2001-02-01' THEN 1 ELSE 0 END AS churned,
         total_cents / 100.0::DOUBLE AS total_charges,
         round(total_cents / CAST(date_diff('month', first_order, last_order) + 1 AS DOUBLE))
           / 100.0::DOUBLE AS monthly_charges
  FROM order_summary s
  JOIN customer c ON c.c_custkey = s.customer_id
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey)"""

SUBSCRIBERS = SUBSCRIPTION + """,
subscribers AS (
  SELECT customer_id, contract, internet_service, payment_method, tech_support,
         online_security, senior_citizen, signup_date, signup_month, tenure,
         churned, total_charges, monthly_charges
  FROM subscription)"""


def _service(condition: str, available: str, missing: str) -> str:
    return (
        f"CASE WHEN NOT ({available}) THEN '{missing}' "
        f"WHEN {condition} THEN 'Yes' ELSE 'No' END"
    )


def _internet(condition: str) -> str:
    return _service(condition, "internet_service <> 'AFRICA'", "No internet service")


RAW_CUSTOMERS = SUBSCRIPTION + f""",
raw_customers AS (
  SELECT 'CUST-' || customer_id AS "customerID",
         CASE WHEN c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         senior_citizen AS "SeniorCitizen",
         CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS "Partner",
         CASE WHEN customer_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
         tenure,
         CASE WHEN customer_id % 10 <> 0 THEN 'Yes' ELSE 'No' END AS "PhoneService",
         {_service('customer_id % 2 = 0', 'customer_id % 10 <> 0', 'No phone service')} AS "MultipleLines",
         internet_service AS "InternetService",
         {_internet('online_security = 1')} AS "OnlineSecurity",
         {_internet('customer_id % 4 = 1')} AS "OnlineBackup",
         {_internet('customer_id % 5 = 2')} AS "DeviceProtection",
         {_internet('tech_support = 1')} AS "TechSupport",
         {_internet('customer_id % 7 < 3')} AS "StreamingTV",
         {_internet('customer_id % 11 < 5')} AS "StreamingMovies",
         contract AS "Contract",
         CASE WHEN customer_id % 5 < 3 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
         payment_method AS "PaymentMethod",
         monthly_charges AS "MonthlyCharges",
         CASE WHEN customer_id % 97 = 0 THEN ' '
              ELSE (total_cents // 100) || '.' || lpad(CAST(total_cents % 100 AS VARCHAR), 2, '0')
         END AS "TotalCharges",
         CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END AS "Churn"
  FROM subscription)"""

PANEL_ORDERS12 = """
first_month AS (
  SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS m0 FROM orders GROUP BY 1),
panel AS (
  SELECT o.o_custkey AS customer_id,
         CAST(date_diff('month', f.m0, o.o_orderdate) // 12 + 1 AS INTEGER) AS month,
         CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS mrr
  FROM orders o JOIN first_month f USING (o_custkey) GROUP BY 1, 2)"""

PANEL_EVENTS3D = """
panel AS (
  SELECT user_id AS customer_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 + 1 AS INTEGER) AS month,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS mrr
  FROM events GROUP BY 1, 2)"""

SCORED = """
scored AS (
  SELECT *, CAST(ROUND(CAST(avg(churned) OVER (PARTITION BY contract, internet_service)
                            AS DECIMAL(28,9)), 6) AS DOUBLE) AS score
  FROM subscribers)"""


def r(expr: str, digits: int) -> str:
    """Round in decimal arithmetic, half away from zero."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,{digits + 3})), {digits}) AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def query(body: str, *ctes: str) -> str:
    """A statement over the given common table expressions."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def over_subscribers(body: str, *more: str) -> str:
    return query(body, SUBSCRIBERS, *more)


def over_scored(body: str, *more: str) -> str:
    return query(body, SUBSCRIBERS, SCORED, *more)
