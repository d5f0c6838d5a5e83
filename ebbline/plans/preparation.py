"""Cleaning, feature derivation and scalar expressions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbline.functions.scalars import (
    EARLY_LIFE_BANDS,
    FEATURE_BANDS,
    REPORT_BANDS,
    band,
    churn_flag,
    clip,
    month_label,
    round_columns,
)
from ebbline.operators import features, profile
from ebbline.plans.registry import register
from ebbline.plans.sql_base import RAW_CUSTOMERS, big, over_subscribers, query, r
from ebbline.schemas import BINARY_COLUMNS, SERVICE_COLUMNS
from ebbline.sources import bridge, store


def over_raw(body: str, *more: str) -> str:
    return query(body, RAW_CUSTOMERS, *more)


def flag(column: str) -> str:
    return f"""CASE WHEN "{column}" = 'Yes' THEN 1 ELSE 0 END"""


SIGNUP = "(DATE '2001-08-01' - to_months(tenure))"
TYPED = [
    ("partner", "Partner"), ("dependents", "Dependents"), ("phone_service", "PhoneService"),
    ("multiple_lines", "MultipleLines"), ("online_security", "OnlineSecurity"),
    ("online_backup", "OnlineBackup"), ("device_protection", "DeviceProtection"),
    ("tech_support", "TechSupport"), ("streaming_tv", "StreamingTV"),
    ("streaming_movies", "StreamingMovies"), ("paperless_billing", "PaperlessBilling"),
    ("churned", "Churn"),
]


@register("raw_customers", over_raw("SELECT * FROM raw_customers"))
def raw_customers(spark, sf_dir):
    return bridge.raw_customers(spark, sf_dir)


@register("typed_customers", over_raw(f"""
SELECT "customerID", gender, "SeniorCitizen" AS senior_citizen, tenure, "InternetService" AS internet_service,
  "Contract" AS contract, "PaymentMethod" AS payment_method, "MonthlyCharges" AS monthly_charges,
  TRY_CAST("TotalCharges" AS DOUBLE) AS total_charges,
  {", ".join(f"{flag(c)} AS {n}" for n, c in TYPED)},
  CAST({SIGNUP} AS DATE) AS signup_date, CAST(date_trunc('month', {SIGNUP}) AS DATE) AS signup_month
FROM raw_customers WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL"""))
def typed_customers(spark, sf_dir):
    return features.typed_customers(bridge.raw_customers(spark, sf_dir), bridge.REFERENCE_DATE)


@register("coerced_totals", over_raw("""
SELECT "customerID", TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges" FROM raw_customers"""))
def coerced_totals(spark, sf_dir):
    return features.coerce_totals(bridge.raw_customers(spark, sf_dir)).select(
        "customerID", "TotalCharges"
    )


@register("dropped_rows", over_raw(f"""
SELECT {big('count(*)')} AS rows_before, {big('count(TRY_CAST("TotalCharges" AS DOUBLE))')} AS rows_after,
  {big('count(*) - count(TRY_CAST("TotalCharges" AS DOUBLE))')} AS rows_dropped FROM raw_customers"""))
def dropped_rows(spark, sf_dir):
    raw = features.coerce_totals(bridge.raw_customers(spark, sf_dir))
    return features.dropped_rows(raw, ["TotalCharges"])


CLEANED = f"""
cleaned AS (
  SELECT * EXCLUDE ("SeniorCitizen") REPLACE (
    {", ".join(f'{flag(c)} AS "{c}"' for c in BINARY_COLUMNS + SERVICE_COLUMNS)},
    TRY_CAST("TotalCharges" AS DOUBLE) AS "TotalCharges"), "SeniorCitizen" AS senior_citizen
  FROM raw_customers WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL)"""


@register("clean_customers", over_raw("SELECT * FROM cleaned", CLEANED))
def clean_customers(spark, sf_dir):
    return bridge.raw_customers(spark, sf_dir).transform(features.coerce_totals).transform(
        features.clean
    )


@register("missing_values", over_raw(f"""
SELECT 'TotalCharges' AS column_name, {big('count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NULL)')} AS missing_count,
  {r('count(*) FILTER (WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NULL) * 100.0 / count(*)', 2)} AS missing_pct
FROM raw_customers"""))
def missing_values(spark, sf_dir):
    return profile.missing_values(features.coerce_totals(bridge.raw_customers(spark, sf_dir)))


@register("churn_flags", over_raw("""
SELECT "customerID", CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS from_text,
  CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END AS from_flag FROM raw_customers"""))
def churn_flags(spark, sf_dir):
    raw = bridge.raw_customers(spark, sf_dir)
    both = raw.withColumn("flag", F.col("Churn") == "Yes")
    return both.select(
        "customerID", churn_flag(both, "Churn").alias("from_text"),
        churn_flag(both, "flag").alias("from_flag"),
    )


@register("tenure_bands", over_subscribers("""
SELECT customer_id, tenure,
  CASE WHEN tenure > 72 OR tenure <= 0 THEN NULL WHEN tenure <= 12 THEN '0-12 mo' WHEN tenure <= 24 THEN '13-24 mo'
    WHEN tenure <= 36 THEN '25-36 mo' WHEN tenure <= 48 THEN '37-48 mo' WHEN tenure <= 60 THEN '49-60 mo' ELSE '61-72 mo' END AS feature_band,
  CASE WHEN tenure BETWEEN 0 AND 12 THEN '00-12 months' WHEN tenure BETWEEN 13 AND 24 THEN '13-24 months'
    WHEN tenure BETWEEN 25 AND 36 THEN '25-36 months' WHEN tenure BETWEEN 37 AND 48 THEN '37-48 months'
    WHEN tenure BETWEEN 49 AND 60 THEN '49-60 months' ELSE '61+ months' END AS report_band,
  CASE WHEN tenure > 72 OR tenure <= 0 THEN NULL WHEN tenure <= 6 THEN '0–6 mo' WHEN tenure <= 12 THEN '7–12 mo'
    WHEN tenure <= 24 THEN '13–24 mo' WHEN tenure <= 36 THEN '25–36 mo' WHEN tenure <= 48 THEN '37–48 mo' ELSE '49–72 mo' END AS early_life_band
FROM subscribers"""))
def tenure_bands(spark, sf_dir):
    return bridge.subscribers(spark, sf_dir).select(
        "customer_id", "tenure",
        band("tenure", **FEATURE_BANDS).alias("feature_band"),
        band("tenure", **REPORT_BANDS).alias("report_band"),
        band("tenure", **EARLY_LIFE_BANDS).alias("early_life_band"),
    )


def _services(spark, sf_dir):
    """Staged, because finding the levels reads the column a first time."""
    subs = bridge.subscribers(spark, sf_dir).select("customer_id", "internet_service")
    return store.stage(subs, "subscribers")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register("one_hot_reference", over_subscribers(
    "SELECT customer_id, " + ", ".join(
        f"""CASE WHEN internet_service = '{x}' THEN 1 ELSE 0 END AS "internet_service_{x}\""""
        for x in REGIONS[1:]) + " FROM subscribers"))
def one_hot_reference(spark, sf_dir):
    encoded = features.one_hot(_services(spark, sf_dir), ["internet_service"], drop_first=True)
    return encoded.drop("internet_service")


@register("recovered_segment", over_subscribers("SELECT customer_id, internet_service FROM subscribers"))
def recovered_segment(spark, sf_dir):
    encoded = features.one_hot(_services(spark, sf_dir), ["internet_service"]).drop(
        "internet_service"
    )
    label = features.segment_label(encoded, "internet_service")
    return encoded.select("customer_id", label.alias("internet_service"))


ADDONS = " + ".join(f'"{c}"' for c in SERVICE_COLUMNS)


@register("feature_table", over_raw(f"""
SELECT "customerID", CAST({SIGNUP} AS DATE) AS signup_date, CAST(date_trunc('month', {SIGNUP}) AS DATE) AS signup_month,
  CASE WHEN tenure > 72 OR tenure <= 0 THEN NULL WHEN tenure <= 12 THEN '0-12 mo' WHEN tenure <= 24 THEN '13-24 mo'
    WHEN tenure <= 36 THEN '25-36 mo' WHEN tenure <= 48 THEN '37-48 mo' WHEN tenure <= 60 THEN '49-60 mo' ELSE '61-72 mo' END AS tenure_band,
  {ADDONS} AS num_addons, {r('ln(1 + "MonthlyCharges")', 6)} AS log_monthly_charges,
  CASE WHEN gender = 'Female' THEN 1 ELSE 0 END AS "gender_Female", CASE WHEN gender = 'Male' THEN 1 ELSE 0 END AS "gender_Male",
  {", ".join(f'''CASE WHEN "InternetService" = '{x}' THEN 1 ELSE 0 END AS "InternetService_{x}"''' for x in REGIONS)}
FROM cleaned""", CLEANED))
def feature_table(spark, sf_dir):
    raw = store.stage(bridge.raw_customers(spark, sf_dir), "customers")
    table = features.preprocess(raw, bridge.REFERENCE_DATE)
    shown = table.select(
        "customerID", "signup_date", "signup_month", "tenure_band", "num_addons",
        "log_monthly_charges", "gender_Female", "gender_Male",
        *[f"`InternetService_{x}`" for x in REGIONS],
    )
    return round_columns(shown, {"log_monthly_charges": 6})


def _is(column: str, values: list[str]) -> list[str]:
    return [f"""CASE WHEN "{column}" = '{x}' THEN 1 ELSE 0 END""" for x in values]


#: The features in the order of the table's columns: numbers first, then the levels.
FEATURES = [
    "senior_citizen", '"Partner"', '"Dependents"', "tenure", '"PhoneService"',
    *[f'"{c}"' for c in SERVICE_COLUMNS], '"PaperlessBilling"', '"MonthlyCharges"', f"({ADDONS})",
    'ln(1 + "MonthlyCharges")', *_is("gender", ["Female", "Male"]), *_is("InternetService", REGIONS),
    *_is("Contract", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    *_is("PaymentMethod", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
]


@register("model_features", over_raw(f"""
SELECT "customerID", "Churn"::DOUBLE AS label, md5(concat_ws(',', {", ".join(
    f"CAST(round(({x})::DOUBLE * 1000) AS BIGINT)" for x in FEATURES)})) AS features_md5,
  {big(str(len(FEATURES)))} AS n_features FROM cleaned""", CLEANED))
def model_features(spark, sf_dir):
    """The vector of each customer, as a digest of its entries in thousandths."""
    table = features.preprocess(bridge.raw_customers(spark, sf_dir), bridge.REFERENCE_DATE)
    entries = vector_to_array("features")
    text = F.array_join(F.transform(entries, lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    return features.model_features(table).select(
        "customerID", "label", F.md5(text.cast("binary")).alias("features_md5"),
        F.size(entries).cast("long").alias("n_features"),
    )


@register("shifted_charges", over_subscribers(f"""
SELECT customer_id, {r('monthly_charges * 1.25::DOUBLE', 4)} AS monthly_charges,
  {r('ln(1 + monthly_charges * 1.25::DOUBLE)', 6)} AS log_monthly_charges FROM subscribers"""))
def shifted_charges(spark, sf_dir):
    shifted = features.shift_column(bridge.subscribers(spark, sf_dir), "monthly_charges", 1.25)
    report = shifted.select(
        "customer_id", "monthly_charges", F.log1p("monthly_charges").alias("log_monthly_charges")
    )
    return round_columns(report, {"monthly_charges": 4, "log_monthly_charges": 6})


@register("scalar_math", over_subscribers(f"""
SELECT customer_id, greatest(tenure, 12) AS floored, least(greatest(tenure, 12), 60) AS clipped,
  {r('ln(monthly_charges)', 6)} AS log_charge, {r('sqrt(monthly_charges)', 6)} AS root_charge,
  {r('exp(-tenure / 12.0::DOUBLE)', 6)} AS decay, {r('power(tenure, 1.5)', 4)} AS powered,
  {big('ceil(monthly_charges / 1000)')} AS thousands, abs(tenure - 36) AS distance,
  strftime(signup_month, '%Y-%m') AS signup_label, coalesce(payment_method, 'none') AS payment_method
FROM subscribers"""))
def scalar_math(spark, sf_dir):
    report = bridge.subscribers(spark, sf_dir).select(
        "customer_id",
        clip("tenure", lower=12).alias("floored"),
        clip("tenure", lower=12, upper=60).alias("clipped"),
        F.log("monthly_charges").alias("log_charge"),
        F.sqrt("monthly_charges").alias("root_charge"),
        F.exp(-F.col("tenure") / 12).alias("decay"),
        F.pow("tenure", F.lit(1.5)).alias("powered"),
        F.ceil(F.col("monthly_charges") / 1000).alias("thousands"),
        F.abs(F.col("tenure") - 36).alias("distance"),
        month_label("signup_month").alias("signup_label"),
        F.coalesce("payment_method", F.lit("none")).alias("payment_method"),
    )
    return round_columns(report, {"log_charge": 6, "root_charge": 6, "decay": 6, "powered": 4})
