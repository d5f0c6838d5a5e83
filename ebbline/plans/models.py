"""Churn classifiers trained on the derived customer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.scalars import round_columns
from ebbline.operators import churn_model, customer_scores, drift, features, scoring, splits, tree_attribution
from ebbline.plans.registry import register
from ebbline.plans.sql_base import RAW_CUSTOMERS, query
from ebbline.schemas import CATEGORICAL_COLUMNS
from ebbline.sources import bridge, store

#: What is watched for drift before a model is retrained.
DRIFT_NUMERIC = ["MonthlyCharges", "tenure", "SeniorCitizen"]
DRIFT_CATEGORICAL = ["Contract", "InternetService"]


def _table(spark, sf_dir):
    """The feature table. Customers are written once: their levels are looked up before the rows are read."""
    raw = store.stage(bridge.raw_customers(spark, sf_dir), "customers")
    return features.preprocess(raw, bridge.REFERENCE_DATE)


def _features(table):
    """Model features, written once because fitting and splitting re-read them."""
    return store.stage(features.model_features(table), "features")


def _prepared(spark, sf_dir):
    return _features(_table(spark, sf_dir))


def _fitted_on_everyone(spark, prepared):
    """The boosted model of all customers: fitted, saved and loaded again, with its folder."""
    path = store.scratch_path(spark, "model")
    churn_model.save_model(churn_model.train_boosted(prepared), path)
    return churn_model.load_boosted(path), path


def _split(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    return splits.stratified_split(prepared, id_column="customerID")


@register("stratified_split", query("""
SELECT part, label, CAST(sum(CASE WHEN part = 'test' THEN held ELSE n - held END) AS BIGINT) AS customers
FROM (SELECT CASE WHEN "Churn" = 'Yes' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, count(*) AS n,
        least(ceil(count(*) * 0.2::DOUBLE), count(*) - 1) AS held
      FROM raw_customers WHERE TRY_CAST("TotalCharges" AS DOUBLE) IS NOT NULL GROUP BY 1),
     (SELECT unnest(['train', 'test']) AS part)
GROUP BY part, label""", RAW_CUSTOMERS))
def stratified_split(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    both = train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )
    return both.groupBy("part", "label").agg(F.count(F.lit(1)).alias("customers"))


@register("logistic_model")
def logistic_model(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = churn_model.train_logistic(train)
    return churn_model.evaluate_model(model, test, "logistic")


@register("boosted_model")
def boosted_model(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = churn_model.train_boosted(train)
    return churn_model.evaluate_model(model, test, "boosted")


@register("feature_importance")
def feature_importance(spark, sf_dir):
    table = _table(spark, sf_dir)
    model, _ = _fitted_on_everyone(spark, _features(table))
    return churn_model.feature_importance(model, features.feature_names(table))


@register("tree_contribution_ranking")
def tree_contribution_ranking(spark, sf_dir):
    table = _table(spark, sf_dir)
    prepared = _features(table)
    model, path = _fitted_on_everyone(spark, prepared)
    parts = tree_attribution.tree_contributions(model, path, prepared)
    return tree_attribution.contribution_ranking(parts, features.feature_names(table))


@register("cross_validation")
def cross_validation(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    return churn_model.cross_validate(churn_model.train_boosted, prepared)


@register("scored_customers")
def scored_customers(spark, sf_dir):
    """Fit, save, load again and score everyone."""
    prepared = _prepared(spark, sf_dir)
    model, _ = _fitted_on_everyone(spark, prepared)
    return churn_model.score(model, prepared, "churn_probability").select(
        "customerID", "label", "churn_probability"
    )


def _subscribers(spark, sf_dir):
    """Customers under the id that the models use."""
    return bridge.subscribers(spark, sf_dir).select(
        "customer_id", F.concat(F.lit("CUST-"), F.col("customer_id").cast("string")).alias("customerID"),
        "contract", "tenure", "monthly_charges", "churned",
    )


@register("customer_scorecard")
def customer_scorecard(spark, sf_dir):
    """Model score, lifetime value, unit economics and value tier of every customer."""
    model, _ = _fitted_on_everyone(spark, prepared := _prepared(spark, sf_dir))
    scores = churn_model.score(model, prepared, "churn_probability").select("customerID", "churn_probability")
    # Curves and values read the customers in turn.
    known = store.stage(_subscribers(spark, sf_dir), "subscribers")
    card = customer_scores.scorecard(known, scores, "customerID", bridge.CAC)
    return round_columns(card.drop("customerID"), {
        "expected_lifetime_months": 4, "clv": 2, "ltv_cac_ratio": 4, "payback_months": 4,
    })


@register("model_risk_report")
def model_risk_report(spark, sf_dir):
    """Confusion, thresholds, sanity and the riskiest customers, on customers not trained on."""
    train, test = _split(spark, sf_dir)
    scores = churn_model.score(churn_model.train_boosted(train), test).select("customerID", "score")
    scored = _subscribers(spark, sf_dir).join(scores, "customerID")
    return scoring.risk_report(store.stage(scored, "scored"))


@register("explain_held_out_customer")
def explain_held_out_customer(spark, sf_dir):
    """Tree contributions of the riskiest customer among those not trained on."""
    table = _table(spark, sf_dir)
    train, test = splits.stratified_split(_features(table), id_column="customerID")
    path = churn_model.save_model(churn_model.train_boosted(train), store.scratch_path(spark, "model"))
    parts = tree_attribution.tree_contributions(churn_model.load_boosted(path), path, test)
    return tree_attribution.explain_top_customer(
        store.stage(parts, "contributions"), features.feature_names(table)
    )


@register("retrain_and_compare")
def retrain_and_compare(spark, sf_dir):
    """Earlier customers train the old model; later, dearer ones join for the new one.

    The old model is judged on earlier customers held out from its training, then on the
    later ones. Only what features and performance have drifted leads to a new model.
    """
    raw = store.stage(bridge.raw_customers(spark, sf_dir), "customers")
    earlier, later = splits.split_by_fraction(raw, ["customerID"], 0.7)
    # The shift is applied before features are derived from the charge.
    later = features.shift_column(later, "MonthlyCharges", 1.25)
    prepare = lambda part, name: store.stage(
        features.model_features(features.add_features(
            features.clean(features.coerce_totals(part)), bridge.REFERENCE_DATE, domains=domains
        )), name,
    )
    # Both parts are encoded with the same levels, so that their vectors agree.
    domains = features.levels(raw, CATEGORICAL_COLUMNS)
    old_train, arrivals = prepare(earlier, "earlier"), prepare(later, "later")
    new_train, test = splits.stratified_split(arrivals, 0.5, id_column="customerID")
    seen, held_out = splits.stratified_split(old_train, id_column="customerID")
    old_model = churn_model.train_boosted(seen)
    baseline_auc = scoring.roc_auc(churn_model.score(old_model, held_out), "label")
    performance = drift.performance_drift(
        F.lit(baseline_auc), churn_model.evaluate_model(old_model, arrivals)
    )
    shifts = drift.feature_drift(earlier, later, DRIFT_NUMERIC, DRIFT_CATEGORICAL)
    return churn_model.retrain_if_needed(
        churn_model.train_boosted, old_train.unionByName(new_train), test, old_model,
        drift.retrain_decision(shifts, performance),
    ).drop("retrained_at")
