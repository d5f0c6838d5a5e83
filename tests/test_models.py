"""Splits and classifiers."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from ebbline.operators import attribution, churn_model, drift, features, scoring, splits
from ebbline.plans import catalog, models
from ebbline.sources import bridge, store


@pytest.fixture(scope="module")
def table(spark):
    return features.preprocess(bridge.raw_customers(spark, SMALL), bridge.REFERENCE_DATE)


@pytest.fixture(scope="module")
def prepared(table):
    frame = features.model_features(table).persist()
    yield frame
    frame.unpersist()


def test_features_leave_out_identifiers_and_outcome(table):
    names = features.feature_names(table)
    assert not {"customerID", "Churn", "TotalCharges", "signup_date"} & set(names)
    assert {"tenure", "num_addons", "Contract_BUILDING", "senior_citizen"} <= set(names)
    # Categories stay available next to their encoding.
    assert "Contract" in table.columns


def test_split_is_stratified_and_repeatable(prepared):
    train, test = splits.stratified_split(prepared, 0.2, id_column="customerID")
    again, _ = splits.stratified_split(prepared.repartition(3), 0.2, id_column="customerID")
    assert {r[0] for r in train.select("customerID").collect()} == {
        r[0] for r in again.select("customerID").collect()
    }
    for label in (0.0, 1.0):
        n = prepared.where(F.col("label") == label).count()
        held = test.where(F.col("label") == label).count()
        assert held == -(-n * 2 // 10)
        assert held + train.where(F.col("label") == label).count() == n


def test_folds_are_even_per_label(prepared):
    folds = splits.stratified_folds(prepared, 5, id_column="customerID")
    counts = folds.groupBy("label", "fold").count().collect()
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in counts if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_order_split_is_exact(spark, subs):
    first, rest = splits.split_by_fraction(
        subs.select("customer_id", "signup_date"), ["signup_date", "customer_id"], 0.7
    )
    n = subs.count()
    assert (first.count(), rest.count()) == (int(n * 0.7), n - int(n * 0.7))
    edge = first.agg(F.max(F.struct("signup_date", "customer_id"))).first()[0]
    assert edge < rest.agg(F.min(F.struct("signup_date", "customer_id"))).first()[0]


def test_logistic_round_trip_beats_chance(spark, prepared):
    model = churn_model.train_logistic(prepared)
    path = churn_model.save_model(model, store.scratch_path(spark, "model"))
    scored = churn_model.score(churn_model.load_logistic(path), prepared)
    assert scoring.roc_auc(scored, "label") > 0.6
    direct = churn_model.score(model, prepared)
    assert direct.exceptAll(scored).count() == 0


def test_logistic_model_scores_after_an_ingestion(spark, prepared):
    """An Observation keeps the session from being sent to tasks; a model must not hold it."""
    panel = spark.createDataFrame([("a", 1, 5.0, "active")], "customerID string, month int, mrr double, event string")
    store.ingest_month(spark, store.scratch_path(spark, "store"), panel, 1)
    model = churn_model.train_logistic(prepared)
    assert not model.hasSummary
    assert churn_model.score(model, prepared).where("score BETWEEN 0 AND 1").count() == prepared.count()


def test_folds_side_by_side_equal_one_after_another(prepared):
    train = lambda rows: churn_model.train_boosted(rows, trees=3)
    fold = lambda n: sorted(map(tuple, churn_model.cross_validate(train, prepared, 3, side_by_side=n).collect()))
    assert fold(None) == fold(1)


def test_boosted_trees_and_importance(spark, table, prepared):
    model = churn_model.train_boosted(prepared, trees=5)
    names = features.feature_names(table)
    report = churn_model.feature_importance(model, names, top=len(names)).collect()
    assert sum(r["importance"] for r in report) == pytest.approx(1)
    assert scoring.roc_auc(churn_model.score(model, prepared), "label") > 0.6
    path = churn_model.save_model(model, store.scratch_path(spark, "trees"))
    assert churn_model.load_boosted(path).getNumTrees == 5


def test_cross_validation_and_retraining(prepared):
    folds = churn_model.cross_validate(churn_model.train_logistic, prepared, folds=3).collect()
    assert len(folds) == 3
    assert folds[0]["mean_auc"] == pytest.approx(sum(r["roc_auc"] for r in folds) / 3)
    train, test = splits.stratified_split(prepared, id_column="customerID")
    old = churn_model.train_logistic(train)
    _, report = churn_model.retrain_and_compare(churn_model.train_logistic, train, test, old)
    row = report.first()
    assert row["delta"] == pytest.approx(0) and not row["improved"]


def test_training_partitions_fill_the_cores():
    mb = 1 << 20
    assert churn_model._partition_count(3 * mb, 12) == 1
    assert churn_model._partition_count(23 * mb, 12) == 6
    # One more than the cores would double the length of every pass.
    assert churn_model._partition_count(200 * mb, 12) == 12
    assert churn_model._partition_count(1400 * mb, 12) == 12
    assert churn_model._partition_count(4000 * mb, 12) == 24


def test_training_rows_are_dealt_evenly(spark, prepared, monkeypatch):
    """A small file is one task to a reader, and a boosted fit passes over it 1,200 times."""
    monkeypatch.setattr(churn_model, "PARTITION_BYTES", 10_000)
    one = store.stage(prepared.coalesce(1), "one")
    with churn_model._balanced(one, lambda neg, pos: (1.0, neg / pos)) as rows:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) - min(sizes) <= 1 and sum(sizes) == one.count()
        assert rows.select("weight").distinct().count() == 2


def test_customers_are_derived_once_for_levels_and_features(spark, fits, monkeypatch):
    """Looking up levels reads the written customers, not the orders again."""
    derived, whole = [], store.stage

    def staged(frame, name="stage", *more):
        derived.extend([name] if "o_totalprice" in frame._jdf.queryExecution().optimizedPlan().toString() else [])
        return whole(frame, name, *more)

    monkeypatch.setattr(store, "stage", staged)
    for query in (models.tree_contribution_ranking, models.explain_held_out_customer):
        derived.clear()
        query(spark, SMALL)
        assert derived == ["customers"]


@pytest.fixture
def fits(monkeypatch):
    """Rows of each boosted fit of a query, with few trees; any other fit fails."""
    rows, whole = [], churn_model.train_boosted

    def few(train):
        rows.append(train.count())
        return whole(train, trees=2)

    monkeypatch.setattr(churn_model, "train_boosted", few)
    monkeypatch.setattr(churn_model, "train_logistic", lambda train: pytest.fail("logistic"))
    return rows


def test_query_cross_validates_the_boosted_model(spark, prepared, fits):
    assert models.cross_validation(spark, SMALL).count() == 5
    assert len(fits) == 5 and sum(fits) == 4 * prepared.count()


def test_query_retrains_on_drift_only(spark, fits, monkeypatch):
    row = models.retrain_and_compare(spark, SMALL).first()
    assert row["should_retrain"] and "'MonthlyCharges'" in row["reasons"]
    assert len(fits) == 2 and row["delta"] == pytest.approx(row["new_model_auc"] - row["old_model_auc"])
    asked = []

    def calm(shifts, performance):
        asked.append((shifts.count(), performance.first()["baseline_auc"]))
        return spark.createDataFrame([(False, "")], "should_retrain boolean, reasons string")

    monkeypatch.setattr(drift, "retrain_decision", calm)
    row = models.retrain_and_compare(spark, SMALL).first()
    assert len(fits) == 3 and asked[0][0] == 5 and 0.5 < asked[0][1] < 1 and asked[0][1] != 0.9
    assert row["new_model_auc"] is None and row["improved"] is None and row["old_model_auc"] > 0


def test_every_query_of_the_whole_model_fits_it(spark, prepared, fits):
    for query in (models.scored_customers, models.feature_importance, models.tree_contribution_ranking):
        assert query(spark, SMALL).count() > 0
    assert fits == [prepared.count()] * 3


def test_scorecard_joins_what_single_queries_report(spark, prepared, fits):
    card = models.customer_scorecard(spark, SMALL).toPandas().set_index("customer_id").sort_index()
    assert fits == [prepared.count()] and card.index.is_unique
    economics = catalog.QUERIES["unit_economics"](spark, SMALL).toPandas().set_index("customer_id").sort_index()
    assert card.index.equals(economics.index)
    for column in ("clv", "ltv_cac_ratio", "payback_months"):
        assert card[column].to_numpy() == pytest.approx(economics[column].to_numpy(), abs=1e-3)
    tiers = catalog.QUERIES["value_tiers"](spark, SMALL).toPandas().set_index("clv_segment")["customers"]
    assert card["clv_segment"].value_counts().to_dict() == tiers.to_dict()
    # Customers without a total have no features, so no score either.
    assert card["churn_probability"].notna().sum() == prepared.count()
    assert card["churn_probability"].dropna().between(0, 1).all()


def test_risk_report_by_brute_force(spark):
    rows = [(i, "a", i, 10.0 * i, int(i % 3 == 0), (i * 37 % 100) / 100) for i in range(1, 90)]
    scored = spark.createDataFrame(
        rows, "customer_id long, contract string, tenure int, monthly_charges double, churned int, score double")
    report = scoring.risk_report(scored, thresholds=[0.3, 0.7])
    got = {(r["section"], r["item"], r["measure"]): r["value"] for r in report.collect()}
    count = lambda cond: sum(1 for r in rows if cond(r))
    assert got["confusion", "1", "predicted_0"] == count(lambda r: r[4] == 1 and r[5] < 0.5)
    assert got["confusion", "0", "predicted_1"] == count(lambda r: r[4] == 0 and r[5] >= 0.5)
    assert got["sweep", "0.7", "flagged"] == count(lambda r: r[5] >= 0.7)
    assert got["sweep", "0.3", "true_churners"] == count(lambda r: r[5] >= 0.3 and r[4])
    over = [r for r in rows if r[5] > 0.5]
    assert got["sanity", "true", "churn_rate"] == pytest.approx(sum(r[4] for r in over) / len(over))
    assert got["kpis", "all", "mrr_at_risk"] == pytest.approx(sum(r[3] for r in rows if r[5] >= 0.5))
    pos, neg = [r[5] for r in rows if r[4]], [r[5] for r in rows if not r[4]]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["quality", "all", "roc_auc"] == pytest.approx(auc)
    best = sorted((r for r in rows if r[5] >= 0.5), key=lambda r: (-r[5], r[0]))[:50]
    assert {k[1] for k in got if k[0] == "high_risk"} == {str(r[0]) for r in best}
    # Without rows there are no customers, and counts are zero.
    empty = {(r["section"], r["measure"]): r["value"] for r in scoring.risk_report(scored.limit(0)).collect()}
    assert empty["kpis", "high_risk_customers"] == 0 and ("high_risk", "score") not in empty


def test_held_out_explanation_and_report(spark, prepared, fits):
    train, test = splits.stratified_split(prepared, id_column="customerID")
    parts = models.explain_held_out_customer(spark, SMALL).collect()
    assert fits == [train.count()]
    held_out = {r[0] for r in test.select("customerID").collect()}
    assert {r["customerID"] for r in parts} <= held_out
    assert sum(r["contribution"] for r in parts) + parts[0]["base"] == pytest.approx(parts[0]["margin"])
    report = models.model_risk_report(spark, SMALL).where("section = 'confusion'")
    assert report.agg(F.sum("value")).first()[0] == test.count()


def test_contributions_add_up(subs):
    parts = attribution.linear_contributions(subs, {"tenure": -0.1, "tech_support": 0.4}, 1.0)
    gap = parts.select(
        F.max(F.abs(F.col("base") + F.col("phi_tenure") + F.col("phi_tech_support") - F.col("margin")))
    ).first()[0]
    assert gap < 1e-9
    direct = subs.select((1.0 - 0.1 * F.col("tenure") + 0.4 * F.col("tech_support")).alias("m"))
    assert parts.agg(F.sum("margin")).first()[0] == pytest.approx(direct.agg(F.sum("m")).first()[0])
