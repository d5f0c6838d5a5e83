"""Small inputs with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ebbline.functions.scalars import EARLY_LIFE_BANDS, FEATURE_BANDS, REPORT_BANDS, band
from ebbline.functions.stats import normal_cdf, two_sided_p
from ebbline.operators import (
    churn_metrics,
    cohort,
    drift,
    experiment,
    features,
    mrr,
    nrr,
    revenue,
    scoring,
    survival,
)


def test_kaplan_meier_with_ties_and_censoring(spark):
    rows = [(1, 1), (2, 1), (2, 0), (3, 1), (4, 0)]
    df = spark.createDataFrame(rows, "tenure int, churned int")
    curve = survival.survival_curve(df, tmax=6)
    s = {r["t"]: r["survival"] for r in curve.collect()}
    assert [s[t] for t in range(7)] == pytest.approx([1, 0.8, 0.6, 0.3, 0.3, 0.3, 0.3])
    area = survival.expected_lifetime(survival.survival_curve(df, tmax=4)).first()[0]
    assert area == pytest.approx(2.35)


def test_curve_that_reaches_zero_stays_there(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "tenure int, churned int")
    s = {r["t"]: r["survival"] for r in survival.survival_curve(df, tmax=4).collect()}
    assert [s[t] for t in range(5)] == [1, 0.5, 0, 0, 0]


def test_scenario_without_a_power_says_so(spark):
    df = spark.createDataFrame(
        [("A", 1, 1, 10.0), ("A", 2, 1, 10.0), ("B", 3, 0, 10.0)],
        "contract string, tenure int, churned int, monthly_charges double",
    )
    for segment in "AB":
        row = survival.churn_reduction_scenario(df, segment, [0.05], tmax=4).first()
        assert row["expected_lifetime_new"] is None and row["note"]


def test_segments_without_label_are_left_out(spark):
    df = spark.createDataFrame(
        [("A", 2, 1), (None, 3, 1)], "contract string, tenure int, churned int"
    )
    segments = survival.survival_curve(df, ["contract"]).select("contract").distinct().collect()
    assert [r[0] for r in segments] == ["A"]


NRR_ROWS = [("c1", 1, 100.0), ("c1", 2, 120.0), ("c1", 3, 90.0), ("c2", 1, 50.0),
            ("c2", 3, 60.0), ("c3", 2, 10.0)]


def test_nrr_with_gap_and_return(spark):
    panel = spark.createDataFrame(NRR_ROWS, "customer_id string, month int, mrr double")
    m1, m2, m3 = nrr.nrr_by_month(panel).orderBy("month").collect()
    assert (m1["starting_mrr"], m1["nrr"]) == (150, 1.0)
    assert (m2["starting_mrr"], m2["expansion_mrr"], m2["churned_mrr"], m2["ending_mrr"]) == (150, 20, 50, 130)
    assert m2["nrr"] == pytest.approx(0.8)
    assert (m3["contraction_mrr"], m3["churned_mrr"], m3["ending_mrr"]) == (30, 10, 150)
    assert m3["nrr"] == pytest.approx(90 / 130)


def test_nrr_ignores_split_rows(spark):
    """Two billing rows of one customer and month count as one."""
    split = [(c, m, v / 2) for c, m, v in NRR_ROWS for _ in range(2)]
    panel = spark.createDataFrame(split, "customer_id string, month int, mrr double")
    whole = spark.createDataFrame(NRR_ROWS, "customer_id string, month int, mrr double")
    assert sorted(nrr.nrr_by_month(panel).collect()) == sorted(nrr.nrr_by_month(whole).collect())


def test_nrr_leaves_censored_customers_out(spark):
    rows = [("a", 1, 10.0, 1), ("b", 1, 20.0, 2), ("b", 2, 20.0, 2)]
    panel = spark.createDataFrame(rows, "customer_id string, month int, mrr double, seen int")
    second = nrr.nrr_by_month(panel, observed_until="seen").where("month = 2").first()
    assert (second["starting_mrr"], second["churned_mrr"], second["nrr"]) == (20, 0, 1.0)


def test_observed_panel_ends_for_active_customers_only(spark):
    panel = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 5.0), ("a", 2, 5.0), ("b", 1, 7.0), ("c", 1, 1.0)],
        "customer_id string, month int, mrr double",
    )
    people = spark.createDataFrame([("a", 0), ("b", 1)], "customer_id string, churned int")
    got = {(r["customer_id"], r["month"]): (r["mrr"], r["observed_until"])
           for r in nrr.observed_panel(panel, people).collect()}
    assert got == {("a", 1): (10, 2), ("a", 2): (10, 2), ("b", 1): (7, None), ("c", 1): (1, None)}


def test_nrr_month_after_a_gap_has_no_rate(spark):
    panel = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 3, 10.0)], "customer_id string, month int, mrr double"
    )
    third = nrr.nrr_by_month(panel).where("month = 3").first()
    assert third["starting_mrr"] == 0 and third["nrr"] is None


def test_psi_of_two_bins(spark):
    base = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5, "f string")
    new = spark.createDataFrame([("x",)] * 8 + [("y",)] * 2, "f string")
    value = drift.psi(base, new, [], ["f"]).first()["psi"]
    assert value == pytest.approx(0.3 * math.log(1.6) - 0.3 * math.log(0.4))


def test_psi_of_constant_baseline_is_zero(spark):
    base = spark.createDataFrame([(7.0,)] * 9, "f double")
    new = spark.createDataFrame([(7.0,), (9.0,)], "f double")
    assert drift.psi(base, new, ["f"]).first()["psi"] == 0


def test_psi_out_of_range_values(spark):
    base = spark.range(100).select(F.col("id").cast("double").alias("f"))
    new = base.withColumn("f", F.col("f") + 50)
    closed = drift.psi(base, new, ["f"], closed=True).first()["psi"]
    opened = drift.psi(base, new, ["f"], closed=False).first()["psi"]
    assert opened > closed > 0.25


def test_unseen_category_counts_with_a_tiny_share(spark):
    base = spark.createDataFrame([("x",)] * 10, "f string")
    new = spark.createDataFrame([("x",)] * 5 + [("z",)] * 5, "f string")
    value = drift.psi(base, new, [], ["f"]).first()["psi"]
    assert value == pytest.approx(-0.5 * math.log(0.5) + (0.5 - 1e-4) * math.log(0.5 / 1e-4))


def test_price_shift_raises_the_alert(spark, subs):
    shifted = features.shift_column(subs, "monthly_charges", 3.0)
    report = drift.feature_drift(subs, shifted, ["monthly_charges", "tenure"], ["contract"], closed=False)
    flags = {r["feature"]: r["flag"] for r in report.collect()}
    assert flags == {"monthly_charges": "alert", "tenure": "stable", "contract": "stable"}
    decision = drift.retrain_decision(report).first()
    assert decision["should_retrain"] and "'monthly_charges'" in decision["reasons"]
    assert not drift.retrain_decision(report.where("flag = 'stable'")).first()["should_retrain"]


def test_two_proportions(spark):
    rows = [("control", int(i < 60)) for i in range(100)] + [("treatment", int(i < 45)) for i in range(100)]
    result = experiment.analyze_experiment(
        spark.createDataFrame(rows, "arm string, churned int"), true_effect=0.15
    ).first()
    assert result["absolute_effect"] == pytest.approx(0.15)
    assert result["z_stat"] == pytest.approx(2.124, abs=1e-3)
    assert result["p_value"] == pytest.approx(math.erfc(result["z_stat"] / math.sqrt(2)), rel=1e-6)
    assert result["significant"] and result["covers_true_effect"]


def test_identical_arms_have_no_effect(spark):
    rows = [("control", 0)] * 5 + [("treatment", 0)] * 5
    result = experiment.analyze_experiment(spark.createDataFrame(rows, "arm string, churned int")).first()
    assert result["z_stat"] == 0 and result["p_value"] == pytest.approx(1, abs=1e-6)
    assert result["relative_effect"] is None and not result["significant"]


def test_underpowered_sample_is_flagged(spark):
    rows = [("control", int(i < 18)) for i in range(30)] + [("treatment", int(i < 16)) for i in range(30)]
    result = experiment.analyze_experiment(spark.createDataFrame(rows, "arm string, churned int"))
    needed = experiment.sample_size(F.col("churn_rate_control"), F.lit(0.08))
    row = experiment.power_warning(result, needed).first()
    assert row["underpowered"] and row["n_needed_per_arm"] > 500


def test_normal_distribution_in_the_tails(spark):
    points = [0.0, 0.5, 1.96, 3.0, 6.0, 9.0]
    df = spark.createDataFrame([(z,) for z in points], "z double").select(
        "z", two_sided_p(F.col("z")).alias("p"), normal_cdf(-F.col("z")).alias("below")
    )
    for r in df.collect():
        exact = math.erfc(r["z"] / math.sqrt(2))
        assert r["p"] == pytest.approx(exact, rel=2e-7)
        assert r["below"] == pytest.approx(exact / 2, rel=2e-7)


def test_band_edges(spark):
    df = spark.createDataFrame([(0,), (12,), (13,), (72,), (73,), (None,)], "tenure int")
    got = df.select(
        band("tenure", **FEATURE_BANDS).alias("f"), band("tenure", **REPORT_BANDS).alias("r"),
        band("tenure", **EARLY_LIFE_BANDS).alias("e"),
    ).collect()
    assert [r["f"] for r in got] == [None, "0-12 mo", "13-24 mo", "61-72 mo", None, None]
    assert [r["r"] for r in got[:5]] == ["00-12 months", "00-12 months", "13-24 months", "61+ months", "61+ months"]
    assert [r["e"] for r in got] == [None, "7–12 mo", "13–24 mo", "49–72 mo", None, None]


CUSTOMERS = "customer_id int, signup_date date, tenure int, churned int, monthly_charges double, contract string"


def months_frame(spark, rows):
    text = CUSTOMERS.replace("signup_date date", "signup_date string")
    return spark.createDataFrame(rows, text).withColumn("signup_date", F.col("signup_date").cast("date"))


def test_tenure_zero_has_no_months(spark):
    df = months_frame(spark, [(1, "2020-01-01", 0, 1, 10.0, "A")])
    assert mrr.customer_months(df, "2024-01-01").count() == 0
    assert mrr.monthly_totals(df, "2024-01-01").count() == 0


def test_mid_month_signup_starts_next_month(spark):
    df = months_frame(spark, [(1, "2020-01-15", 2, 1, 10.0, "A"), (2, "2020-01-01", 3, 0, 5.0, "A")])
    got = [(str(r["month"]), r["customer_id"], r["churned"]) for r in mrr.customer_months(df, "2020-02-20").collect()]
    assert sorted(got) == [
        ("2020-01-01", 2, False), ("2020-02-01", 1, False), ("2020-02-01", 2, False)
    ]


def test_totals_equal_the_expansion(spark, subs):
    reference = "2001-08-01"
    direct = mrr.monthly_totals(subs, reference).collect()
    expanded = mrr.aggregate_months(mrr.customer_months(subs, reference)).collect()
    assert len(direct) == len(expanded)
    for a, b in zip(direct, expanded):
        assert a["month"] == b["month"]
        assert a["active_customers"] == b["active_customers"]
        assert a["churned_customers"] == b["churned_customers"]
        assert a["total_mrr"] == pytest.approx(b["total_mrr"])


def test_revenue_tiles_split_a_hot_charge(spark):
    rows = [(i, 0, 10.0) for i in range(9)] + [(9, 0, 30.0), (10, 0, 20.0), (11, 0, 5.0), (12, 0, 1.0)]
    df = spark.createDataFrame(rows, "customer_id int, churned int, monthly_charges double")
    got = {r["decile"]: (r["customers"], r["mrr"]) for r in revenue.revenue_concentration(df).collect()}
    assert [got[d][0] for d in range(1, 11)] == [2, 2, 2] + [1] * 7
    assert got[1][1] == 50 and got[2][1] == 20 and got[10][1] == 1


def test_retention_falls_from_one(spark, subs):
    rows = cohort.cohort_table(subs).orderBy("cohort", "month_offset").collect()
    last = {}
    for r in rows:
        if r["month_offset"] == 0:
            assert r["retention_rate"] == 1
        else:
            assert r["retention_rate"] <= last[r["cohort"]]
        last[r["cohort"]] = r["retention_rate"]
    longest = subs.agg({"tenure": "max"}).first()[0]
    assert max(r["month_offset"] for r in rows) == longest
    capped = cohort.cohort_table(subs, 12).agg({"month_offset": "max"}).first()[0]
    assert capped == min(longest, 12)


def test_long_tenures_are_neither_cut_nor_left_out(spark):
    rows = [(1, "1990-01-01", 100, 0, 10.0), (2, "1990-01-01", 2, 1, 10.0)]
    df = spark.createDataFrame(rows, "customer_id int, d string, tenure int, churned int, monthly_charges double")
    df = df.withColumn("signup_month", F.to_date("d"))
    series = revenue.mrr_series(df, "2005-01-01").collect()
    assert len(series) == 100 and series[-1]["mrr"] == 10
    assert len(revenue.mrr_series(df, "2005-01-01", 72).collect()) == 72
    bands = {r["tenure_band"]: r["customers"] for r in churn_metrics.churn_by_band(df, FEATURE_BANDS).collect()}
    assert bands == {"0-12 mo": 1, "outside": 1}


def test_unknown_tenure_counts_in_the_cohort_size(spark):
    df = months_frame(spark, [(1, "2020-01-01", 2, 1, 1.0, "A"), (2, "2020-01-09", None, 0, 1.0, "A")])
    rows = cohort.cohort_table(df).orderBy("month_offset").collect()
    assert [(r["cohort_size"], r["active_customers"]) for r in rows] == [(2, 1)] * 3


def test_auc_counts_ties_as_half(spark):
    rows = [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0), (0.7, 0)]
    df = spark.createDataFrame(rows, "score double, churned int")
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z]
    report = scoring.evaluate(df).first()
    assert report["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert report["precision_1"] == pytest.approx(0.5) and report["recall_1"] == 1.0


def test_recovered_label_defaults_to_the_first(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (1, 1)], "s_a int, s_b int")
    got = df.select(features.segment_label(df, "s").alias("s")).collect()
    assert [r["s"] for r in got] == ["b", "a", "a"]
    with pytest.raises(KeyError):
        features.segment_label(df, "other")


def test_customer_months_never_outlive_the_panel(spark):
    panel = spark.createDataFrame(NRR_ROWS, "customer_id string, month int, mrr double")
    got = {(r["customer_id"], r["month"]): r["event"] for r in nrr.label_events(panel).collect()}
    assert got == {
        ("c1", 1): "active", ("c1", 2): "expansion", ("c1", 3): "contraction",
        ("c2", 1): "churn", ("c2", 3): "expansion", ("c3", 2): "churn",
    }
