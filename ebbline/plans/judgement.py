"""Scores and their evaluation, drift reports and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbline.functions.ordering import exact_quantiles
from ebbline.functions.scalars import round_columns
from ebbline.operators import attribution, drift, experiment, profile, scoring, splits
from ebbline.operators.survival import fixed_sample
from ebbline.plans.registry import register
from ebbline.plans.sql_base import big, over_scored, over_subscribers, query, r
from ebbline.sources import bridge, store

SCORE_KEYS = ["contract", "internet_service"]


def scored_subscribers(spark, sf_dir, *extra):
    """Customers with the churn rate of their segment, read from a staged copy."""
    columns = ["customer_id", *SCORE_KEYS, "churned", *extra]
    subs = store.stage(bridge.subscribers(spark, sf_dir).select(*columns), "subscribers")
    return scoring.segment_score(subs, SCORE_KEYS, digits=6)


@register("segment_score", over_scored("SELECT customer_id, contract, internet_service, churned, score FROM scored"))
def segment_score(spark, sf_dir):
    return scored_subscribers(spark, sf_dir).select(
        "customer_id", "contract", "internet_service", "churned", "score"
    )


@register("evaluate_score", over_scored(f"""
SELECT 'segment' AS name, {r('auc', 6)} AS roc_auc, {r('ap', 6)} AS avg_precision,
  {r('coalesce(tp / nullif(flagged, 0), 0)', 6)} AS precision_1, {r('tp / p', 6)} AS recall_1,
  {r('2 * tp / (flagged + p)', 6)} AS f1_1
FROM (
  SELECT (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.n * b.n)
          FROM (SELECT score, count(*) AS n FROM scored WHERE churned = 1 GROUP BY 1) a,
               (SELECT score, count(*) AS n FROM scored WHERE churned = 0 GROUP BY 1) b)
         / (CAST(count(*) FILTER (WHERE churned = 1) AS DOUBLE) * count(*) FILTER (WHERE churned = 0)) AS auc,
    (SELECT sum(pos * prec) / sum(pos) FROM (
       SELECT s.score, count(*) FILTER (WHERE churned = 1) AS pos,
         (SELECT count(*) FILTER (WHERE churned = 1) / CAST(count(*) AS DOUBLE) FROM scored u WHERE u.score >= s.score) AS prec
       FROM scored s GROUP BY s.score)) AS ap,
    CAST(count(*) FILTER (WHERE score >= 0.5 AND churned = 1) AS DOUBLE) AS tp,
    count(*) FILTER (WHERE score >= 0.5) AS flagged, count(*) FILTER (WHERE churned = 1) AS p
  FROM scored)"""))
def evaluate_score(spark, sf_dir):
    report = scoring.evaluate(scored_subscribers(spark, sf_dir), name="segment")
    return round_columns(report, {c: 6 for c in report.columns if c != "name"})


@register("curve_points", over_scored(f"""
SELECT t.score AS threshold, {big('tp')} AS true_positives, {big('fp')} AS false_positives,
  {r('tp / CAST(p AS DOUBLE)', 6)} AS tpr, {r('fp / CAST(n AS DOUBLE)', 6)} AS fpr,
  {r('tp / CAST(tp + fp AS DOUBLE)', 6)} AS precision, {r('tp / CAST(p AS DOUBLE)', 6)} AS recall
FROM (SELECT t.score, count(*) FILTER (WHERE s.churned = 1) AS tp, count(*) FILTER (WHERE s.churned = 0) AS fp
      FROM (SELECT DISTINCT score FROM scored) t JOIN scored s ON s.score >= t.score GROUP BY 1) t,
     (SELECT count(*) FILTER (WHERE churned = 1) AS p, count(*) FILTER (WHERE churned = 0) AS n FROM scored)"""))
def curve_points(spark, sf_dir):
    points = scoring.curve_points(scored_subscribers(spark, sf_dir))
    return round_columns(points, {"tpr": 6, "fpr": 6, "precision": 6, "recall": 6})


@register("confusion_matrix", over_scored(f"""
SELECT churned AS actual, {big('count(*) FILTER (WHERE score < 0.5)')} AS predicted_0,
  {big('count(*) FILTER (WHERE score >= 0.5)')} AS predicted_1 FROM scored GROUP BY 1"""))
def confusion_matrix(spark, sf_dir):
    return scoring.confusion_matrix(scored_subscribers(spark, sf_dir))


@register("threshold_sweep", over_scored(f"""
SELECT threshold, {big('flagged')} AS flagged, {big('hits')} AS true_churners,
  {r('coalesce(hits / nullif(CAST(flagged AS DOUBLE), 0), 0)', 6)} AS precision,
  {r('hits / CAST((SELECT sum(churned) FROM scored) AS DOUBLE)', 6)} AS recall
FROM (SELECT t.threshold, count(*) FILTER (WHERE score >= threshold) AS flagged,
        count(*) FILTER (WHERE score >= threshold AND churned = 1) AS hits
      FROM scored CROSS JOIN (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE]) AS threshold) t
      GROUP BY 1)"""))
def threshold_sweep(spark, sf_dir):
    sweep = scoring.threshold_sweep(scored_subscribers(spark, sf_dir))
    return round_columns(sweep, {"precision": 6, "recall": 6})


@register("class_balance", over_subscribers(f"""
SELECT {big('sum(churned)')} AS churned, {big('count(*) - sum(churned)')} AS retained,
  {r('avg(churned)', 6)} AS churn_rate, {r('(count(*) - sum(churned)) / sum(churned)', 6)} AS scale_pos_weight
FROM subscribers"""))
def class_balance(spark, sf_dir):
    balance = scoring.class_balance(bridge.subscribers(spark, sf_dir))
    return round_columns(balance, {"churn_rate": 6, "scale_pos_weight": 6})


@register("score_sanity", over_scored(f"""
SELECT score > 0.5 AS high_score, {big('count(*)')} AS customers, {r('avg(churned)', 6)} AS churn_rate
FROM scored GROUP BY 1"""))
def score_sanity(spark, sf_dir):
    return round_columns(
        scoring.score_sanity(scored_subscribers(spark, sf_dir)), {"churn_rate": 6}
    )


@register("high_risk_customers", over_scored("""
SELECT customer_id, contract, tenure, monthly_charges, score FROM scored
WHERE score >= 0.5 ORDER BY score DESC, customer_id LIMIT 50"""))
def high_risk_customers(spark, sf_dir):
    return scoring.high_risk_customers(
        scored_subscribers(spark, sf_dir, "tenure", "monthly_charges")
    )


@register("risk_kpis", over_scored(f"""
SELECT {big('count(*)')} AS high_risk_customers, {r('sum(monthly_charges)', 2)} AS mrr_at_risk
FROM scored WHERE score >= 0.5"""))
def risk_kpis(spark, sf_dir):
    scored = scored_subscribers(spark, sf_dir, "monthly_charges")
    return round_columns(scoring.risk_kpis(scored), {"mrr_at_risk": 2})


@register("risk_by_payment_method", over_scored(f"""
SELECT payment_method, {big('count(*)')} AS customers, {r('avg(score)', 6)} AS avg_score
FROM scored GROUP BY 1"""))
def risk_by_payment_method(spark, sf_dir):
    return round_columns(
        profile.segment_average(
            scored_subscribers(spark, sf_dir, "payment_method"), "payment_method", "score"
        ),
        {"avg_score": 6},
    )


# Given coefficients stand for a fitted model, so that SQL can state the result.
COEFFICIENTS = {"tenure": -0.03, "monthly_charges": 0.00001, "tech_support": -0.2, "senior_citizen": 0.15}
PHI = ", ".join(f"{b!r} * ({c} - avg({c}) OVER ()) AS phi_{c}" for c, b in COEFFICIENTS.items())
CONTRIBUTIONS = f"""
parts AS (SELECT customer_id, {PHI},
  0.5 + {" + ".join(f"{b!r} * avg({c}) OVER ()" for c, b in COEFFICIENTS.items())} AS base FROM subscribers),
contributions AS (
  SELECT *, base + {" + ".join(f"phi_{c}" for c in COEFFICIENTS)} AS margin FROM parts)"""


def _contributions(spark, sf_dir):
    subs = bridge.subscribers(spark, sf_dir).select("customer_id", *COEFFICIENTS)
    return attribution.linear_contributions(
        store.stage(subs, "subscribers"), COEFFICIENTS, intercept=0.5
    )


@register("linear_contributions", over_subscribers(
    "SELECT customer_id, " + ", ".join(f"{r(f'phi_{c}', 6)} AS phi_{c}" for c in COEFFICIENTS)
    + f", {r('base', 6)} AS base, {r('margin', 6)} AS margin FROM contributions", CONTRIBUTIONS))
def linear_contributions(spark, sf_dir):
    parts = _contributions(spark, sf_dir)
    return round_columns(parts, {c: 6 for c in parts.columns if c != "customer_id"})


@register("contribution_ranking", over_subscribers("\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'avg(abs(phi_{c}))', 6)} AS mean_abs FROM contributions" for c in COEFFICIENTS
), CONTRIBUTIONS))
def contribution_ranking(spark, sf_dir):
    return round_columns(attribution.mean_absolute(_contributions(spark, sf_dir)), {"mean_abs": 6})


@register("explain_top_customer", over_subscribers(f"""
SELECT customer_id, {r('base', 6)} AS base, {r('margin', 6)} AS margin,
  unnest([{", ".join(f"'{c}'" for c in COEFFICIENTS)}]) AS feature,
  unnest([{", ".join(r(f'phi_{c}', 6) for c in COEFFICIENTS)}]) AS contribution
FROM (SELECT * FROM contributions ORDER BY margin DESC, customer_id LIMIT 1)""", CONTRIBUTIONS))
def explain_top_customer(spark, sf_dir):
    return round_columns(
        attribution.explain_top_customer(_contributions(spark, sf_dir)),
        {"base": 6, "margin": 6, "contribution": 6},
    )


def psi_ctes(closed: bool) -> str:
    outside = "v < edges[1] OR v > edges[len(edges)]" if closed else "false"
    return f"""
sides AS (
  SELECT 0 AS side, o_totalprice AS v, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate < DATE '1999-08-01'
  UNION ALL
  SELECT 1, o_totalprice * 1.25::DOUBLE, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate >= DATE '1999-08-01'),
cuts AS (
  SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges
  FROM sides WHERE side = 0),
binned AS (
  SELECT side, 'o_totalprice' AS feature,
    CASE WHEN {outside} THEN NULL ELSE CAST(len(list_filter(edges[2:len(edges) - 1], lambda e: v > e)) AS VARCHAR) END AS bin
  FROM sides, cuts
  UNION ALL SELECT side, 'o_orderpriority', o_orderpriority FROM sides
  UNION ALL SELECT side, 'o_orderstatus', o_orderstatus FROM sides),
shares AS (
  SELECT e.feature, e.bin,
    greatest(e.n0 / CAST(sum(e.n0) OVER (PARTITION BY e.feature) AS DOUBLE), 0.0001) AS p0,
    greatest(e.n1 / CAST(sum(e.n1) OVER (PARTITION BY e.feature) AS DOUBLE), 0.0001) AS p1
  FROM (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1
        FROM binned WHERE bin IS NOT NULL GROUP BY 1, 2) e),
drift AS (
  SELECT feature, sum((p1 - p0) * ln(p1 / p0)) AS psi FROM shares GROUP BY 1)"""


DRIFT_SELECT = f"""
SELECT feature, {r('psi', 6)} AS psi,
  CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'watch' ELSE 'alert' END AS flag FROM drift"""
NUMERIC, CATEGORICAL = ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]


def _drift(spark, sf_dir, closed, extra=()):
    baseline, recent = bridge.drift_sides(spark, sf_dir)
    return drift.feature_drift(baseline, recent, NUMERIC, [*CATEGORICAL, *extra], closed=closed)


@register("feature_drift_closed", query(DRIFT_SELECT, psi_ctes(True)))
def feature_drift_closed(spark, sf_dir):
    return round_columns(_drift(spark, sf_dir, closed=True), {"psi": 6})


@register("feature_drift_open", query(
    DRIFT_SELECT + " UNION ALL SELECT 'not_a_column', NULL, 'skipped'", psi_ctes(False)))
def feature_drift_open(spark, sf_dir):
    report = _drift(spark, sf_dir, closed=False, extra=["not_a_column"])
    return round_columns(report, {"psi": 6})


AUC_CTE = """
measured AS (
  SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.n * b.n)
         / sum(a.n * b.n) AS auc
  FROM (SELECT score, count(*)::DOUBLE AS n FROM scored WHERE churned = 1 GROUP BY 1) a,
       (SELECT score, count(*)::DOUBLE AS n FROM scored WHERE churned = 0 GROUP BY 1) b)"""


def _performance(spark, sf_dir):
    evaluation = scoring.evaluate(scored_subscribers(spark, sf_dir))
    return drift.performance_drift(F.lit(0.9), evaluation)


@register("performance_drift", over_scored(f"""
SELECT 0.9::DOUBLE AS baseline_auc, {r('auc', 6)} AS new_data_auc, {r('0.9 - auc', 6)} AS auc_drop,
  CASE WHEN 0.9 - auc > 0.03 THEN 'alert' ELSE 'stable' END AS flag FROM measured""", AUC_CTE))
def performance_drift(spark, sf_dir):
    return round_columns(_performance(spark, sf_dir), {"new_data_auc": 6, "auc_drop": 6})


@register("retrain_decision", over_scored(f"""
SELECT true AS should_retrain,
  CASE WHEN count(*) FILTER (WHERE psi >= 0.25) > 0 THEN
    count(*) FILTER (WHERE psi >= 0.25) || ' feature(s) with PSI > 0.25 (significant shift): [' ||
    string_agg(CASE WHEN psi >= 0.25 THEN '''' || feature || '''' END, ', ' ORDER BY psi DESC) || ']; ' ELSE '' END
  || any_value(printf('AUC dropped %.3f on new labeled data (0.900 -> %.3f)', 0.9::DOUBLE - auc, auc)) AS reasons,
  {big('count(*) FILTER (WHERE psi >= 0.25)')} AS n_alert_features,
  {big('count(*) FILTER (WHERE psi >= 0.10 AND psi < 0.25)')} AS n_watch_features
FROM drift, measured""", AUC_CTE, psi_ctes(False)))
def retrain_decision(spark, sf_dir):
    report = _drift(spark, sf_dir, closed=False)
    return drift.retrain_decision(report, _performance(spark, sf_dir)).drop("checked_at")


@register("split_by_order", over_subscribers(f"""
SELECT part, {big('count(*)')} AS customers, {r('sum(monthly_charges)', 2)} AS mrr, max(signup_date) AS last_signup
FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY signup_date, customer_id)
        <= floor((SELECT count(*) FROM subscribers) * 0.7) THEN 'baseline' ELSE 'new' END AS part FROM subscribers)
GROUP BY 1"""))
def split_by_order(spark, sf_dir):
    subs = store.stage(bridge.subscribers(spark, sf_dir).select(
        "customer_id", "signup_date", "monthly_charges"), "subscribers")
    marked = splits.mark_first_share(subs, ["signup_date", "customer_id"], 0.7)
    part = F.when(F.col("in_first"), "baseline").otherwise("new")
    report = marked.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monthly_charges").alias("mrr"),
        F.max("signup_date").alias("last_signup"),
    )
    return round_columns(report, {"mrr": 2})


# Φ by Simpson's rule, independent of the polynomial used on Spark.
P_VALUE = """1 - 2 * 0.3989422804014327 * (abs(z) / 2000) / 3 *
  list_sum(list_transform(range(0, 2001), lambda k:
    (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-((k * abs(z) / 2000) ** 2) / 2)))"""
TEST_DIGITS = {
    "churn_rate_control": 6, "churn_rate_treatment": 6, "absolute_effect": 6, "relative_effect": 6,
    "z_stat": 5, "p_value": 5, "ci_low": 6, "ci_high": 6,
}


ODD_EVEN = """
arms AS (SELECT *, CASE WHEN customer_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm FROM subscribers)"""


def tested_cte(by: str = "", arms: str = ODD_EVEN) -> str:
    comma, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""{arms},
rates AS (
  SELECT {comma}count(*) FILTER (WHERE arm = 'control') AS nc, count(*) FILTER (WHERE arm = 'treatment') AS nt,
    avg(churned) FILTER (WHERE arm = 'control') AS pc, avg(churned) FILTER (WHERE arm = 'treatment') AS pt,
    avg(churned) AS pp FROM arms {group}),
z_scores AS (SELECT *, (pc - pt) / sqrt(pp * (1 - pp) * (1.0 / nc + 1.0 / nt)) AS z,
  1.959963984540054 * sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt) AS half FROM rates),
tested AS (SELECT *, {P_VALUE} AS p FROM z_scores)"""


def tested_select(by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""
SELECT {comma}{big('nc')} AS n_control, {big('nt')} AS n_treatment, {r('pc', 6)} AS churn_rate_control,
  {r('pt', 6)} AS churn_rate_treatment, {r('pc - pt', 6)} AS absolute_effect, {r('(pc - pt) / pc', 6)} AS relative_effect,
  {r('z', 5)} AS z_stat, {r('p', 5)} AS p_value, {r('pc - pt - half', 6)} AS ci_low, {r('pc - pt + half', 6)} AS ci_high,
  p < 0.05 AS significant, 0.05::DOUBLE AS alpha, 0.0 BETWEEN pc - pt - half AND pc - pt + half AS covers_true_effect
FROM tested"""


def _arms(spark, sf_dir):
    even = F.col("customer_id") % 2 == 0
    return bridge.subscribers(spark, sf_dir).withColumn(
        "arm", F.when(even, "control").otherwise("treatment")
    )


@register("analyze_experiment", over_subscribers(tested_select(), tested_cte()))
def analyze_experiment(spark, sf_dir):
    result = experiment.analyze_experiment(_arms(spark, sf_dir), true_effect=0.0)
    return round_columns(result, TEST_DIGITS)


@register("analyze_experiment_by_contract", over_subscribers(tested_select("contract"), tested_cte("contract")))
def analyze_experiment_by_contract(spark, sf_dir):
    result = experiment.analyze_experiment(
        _arms(spark, sf_dir), by=["contract"], true_effect=0.0
    )
    return round_columns(result, TEST_DIGITS)


def pct_sql(expr: str, sign: str = "") -> str:
    return f"printf('%{sign}.1f%%', {r(f'({expr}) * 100', 1)})"


@register("experiment_summary", over_subscribers(f"""
SELECT 'The intervention showed ' || CASE WHEN p < 0.05 THEN 'a' ELSE 'not a' END
  || ' statistically significant effect on churn (p = ' || printf('%.4f', p) || ', alpha = 0.05). Control arm churn rate: '
  || {pct_sql('pc')} || ' (n=' || nc || '). Treatment arm churn rate: ' || {pct_sql('pt')} || ' (n=' || nt
  || '). The intervention ' || CASE WHEN pc > pt THEN 'reduced' ELSE 'increased' END || ' churn by '
  || {pct_sql('abs(pc - pt)')} || ' percentage points (' || {pct_sql('(pc - pt) / pc', '+')}
  || ' relative change), 95% CI: [' || {pct_sql('pc - pt - half')} || ', ' || {pct_sql('pc - pt + half')} || '].' AS summary
FROM tested""", tested_cte()))
def experiment_summary(spark, sf_dir):
    result = experiment.analyze_experiment(_arms(spark, sf_dir))
    return experiment.summarize_result(result).select("summary")


@register("assigned_arms", over_subscribers(f"""
SELECT CASE WHEN substr(md5(customer_id || '-42'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')
    THEN 'control' ELSE 'treatment' END AS arm,
  {big('count(*)')} AS customers, {r('avg(churned)', 6)} AS churn_rate FROM subscribers GROUP BY 1"""))
def assigned_arms(spark, sf_dir):
    assigned = experiment.assign_arms(bridge.subscribers(spark, sf_dir))
    arms = assigned.groupBy("arm").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("churned").alias("churn_rate")
    )
    return round_columns(arms, {"churn_rate": 6})


@register("experiment_population", over_scored("""
SELECT customer_id, score, churned FROM scored
WHERE score >= (SELECT quantile_cont(score, 0.7) FROM scored)"""))
def experiment_population(spark, sf_dir):
    chosen = experiment.experiment_population(scored_subscribers(spark, sf_dir))
    return chosen.select("customer_id", "score", "churned")


EFFECTS = [0.03, 0.05, 0.08, 0.10]


@register("sample_size_sweep", over_scored(f"""
SELECT {r('p1', 6)} AS baseline_rate, mde AS minimum_detectable_effect, {big('n')} AS n_per_arm, {big('n * 2')} AS n_total
FROM (SELECT p1, mde, ceil((1.959963984540054 * sqrt(2 * (p1 - mde / 2) * (1 - p1 + mde / 2))
        + 0.8416212335729143 * sqrt(p1 * (1 - p1) + (p1 - mde) * (1 - p1 + mde))) ** 2 / mde ** 2) AS n
      FROM (SELECT quantile_cont(score, 0.7) AS p1 FROM scored),
           (SELECT unnest([{", ".join(f"{e}::DOUBLE" for e in EFFECTS)}]) AS mde))"""))
def sample_size_sweep(spark, sf_dir):
    baseline = exact_quantiles(scored_subscribers(spark, sf_dir), "score", [0.7]).select(
        F.col("quantiles")[0].alias("baseline_rate")
    )
    return round_columns(experiment.sample_size_sweep(baseline, EFFECTS), {"baseline_rate": 6})


FEW = """
population AS (SELECT * FROM scored WHERE score >= (SELECT quantile_cont(score, 0.7) FROM scored)),
arms AS (
  SELECT *, CASE WHEN substr(md5(customer_id || '-42'), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')
    THEN 'control' ELSE 'treatment' END AS arm
  FROM (SELECT * FROM population ORDER BY md5(customer_id || '-1'), customer_id LIMIT 60))"""


@register("underpowered_experiment", over_scored(f"""
SELECT {big('nc')} AS n_control, {big('nt')} AS n_treatment, {r('pc', 6)} AS churn_rate_control,
  {r('pt', 6)} AS churn_rate_treatment, {r('pc - pt', 6)} AS absolute_effect, {r('(pc - pt) / pc', 6)} AS relative_effect,
  {r('z', 5)} AS z_stat, {r('p', 5)} AS p_value, {r('pc - pt - half', 6)} AS ci_low, {r('pc - pt + half', 6)} AS ci_high,
  p < 0.05 AS significant, 0.05::DOUBLE AS alpha, {big('n')} AS n_needed_per_arm,
  n > (nc + nt) / 2 AND NOT p < 0.05 AS underpowered
FROM tested, (SELECT ceil((1.959963984540054 * sqrt(2 * (p1 - 0.04) * (1 - p1 + 0.04))
        + 0.8416212335729143 * sqrt(p1 * (1 - p1) + (p1 - 0.08) * (1 - p1 + 0.08))) ** 2 / 0.08 ** 2) AS n
      FROM (SELECT avg(score) AS p1 FROM population))""", tested_cte(arms=FEW)))
def underpowered_experiment(spark, sf_dir):
    population = store.stage(
        experiment.experiment_population(scored_subscribers(spark, sf_dir)), "population")
    few = experiment.assign_arms(fixed_sample(population, 60, seed=1))
    result = experiment.analyze_experiment(few)
    # The base rate is that of everyone at risk, not of the few in the experiment.
    base_rate = population.agg(F.avg("score")).scalar()
    result = result.withColumn("_base", base_rate)
    needed = experiment.sample_size(F.col("_base"), F.lit(0.08))
    return round_columns(experiment.power_warning(result, needed).drop("_base"), TEST_DIGITS)
