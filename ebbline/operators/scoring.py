"""Scoring customers and judging scores against known outcomes.

Every measure starts from the counts of churned and kept customers per
distinct score, so tied scores cost nothing and row data is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import running_sums
from ebbline.functions.scalars import ratio, rounded


def segment_score(
    subs: DataFrame, keys: Sequence[str], label: str = "churned", name: str = "score",
    digits: int | None = None,
) -> DataFrame:
    """Score every customer with the churn rate of their segment."""
    rates = subs.groupBy(*keys).agg(F.avg(label).alias(name))
    if digits is not None:
        rates = rates.withColumn(name, rounded(name, digits))
    return attach_lookup(subs, rates, keys, "left")


def score_counts(scored: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def curve_points(scored: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """ROC and precision-recall points, one per distinct score as threshold."""
    counts = score_counts(scored, label, score)
    running = running_sums(counts, [F.desc("score")], ["pos", "neg"])
    totals = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    return running.withColumn("_all", totals).select(
        F.col("score").alias("threshold"),
        F.col("cum_pos").alias("true_positives"),
        F.col("cum_neg").alias("false_positives"),
        ratio("cum_pos", "_all.pos").alias("tpr"),
        ratio("cum_neg", "_all.neg").alias("fpr"),
        ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio("cum_pos", "_all.pos").alias("recall"),
    )


def evaluate(
    scored: DataFrame, label: str = "churned", score: str = "score", threshold: float = 0.5,
    name: str = "",
) -> DataFrame:
    """ROC AUC, average precision, and precision, recall, F1 at a threshold.

    AUC is the exact rank-sum value: ties between a churned and a kept
    customer count one half.
    """
    running = running_sums(
        score_counts(scored, label, score), [F.desc("score")], ["pos", "neg"]
    )
    flagged = F.col("score") >= threshold
    tp = F.sum(F.when(flagged, F.col("pos")).otherwise(0))
    fp = F.sum(F.when(flagged, F.col("neg")).otherwise(0))
    positives, negatives = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    beaten = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    precision_gain = F.sum(
        F.col("pos") * ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    )
    zero = F.lit(0.0)
    return running.agg(
        F.lit(name).alias("name"),
        ratio(beaten, positives * negatives).alias("roc_auc"),
        ratio(precision_gain, positives).alias("avg_precision"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision_1"),
        F.coalesce(ratio(tp, positives), zero).alias("recall_1"),
        F.coalesce(ratio(2 * tp, tp + fp + positives), zero).alias("f1_1"),
    )


def roc_auc(scored: DataFrame, label: str = "churned", score: str = "score") -> float | None:
    """The AUC as a number, for decisions on the driver."""
    return evaluate(scored, label, score).first()["roc_auc"]


def confusion_matrix(
    scored: DataFrame, label: str = "churned", score: str = "score", threshold: float = 0.5
) -> DataFrame:
    """Customers per actual outcome (rows) and predicted outcome (columns)."""
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    return (
        scored.groupBy(F.col(label).alias("actual"))
        .agg(
            F.count_if(predicted == 0).alias("predicted_0"),
            F.count_if(predicted == 1).alias("predicted_1"),
        )
        .orderBy("actual")
    )


def threshold_sweep(
    scored: DataFrame, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7),
    label: str = "churned", score: str = "score",
) -> DataFrame:
    """Flagged customers, churners among them, precision and recall per threshold."""
    over = [F.col(score) >= t for t in thresholds]
    sums = scored.agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        *[F.count_if(o).alias(f"_f{i}") for i, o in enumerate(over)],
        *[F.count_if(o & (F.col(label) == 1)).alias(f"_c{i}") for i, o in enumerate(over)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_f{i}").alias("flagged"),
            F.col(f"_c{i}").alias("true_churners"),
        )
        for i, t in enumerate(thresholds)
    ])
    zero = F.lit(0.0)
    return sums.select("_pos", F.inline(rows)).select(
        "threshold", "flagged", "true_churners",
        F.coalesce(ratio("true_churners", "flagged"), zero).alias("precision"),
        F.coalesce(ratio("true_churners", "_pos"), zero).alias("recall"),
    )


def risk_report(
    scored: DataFrame, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7), threshold: float = 0.5,
    label: str = "churned", score: str = "score",
) -> DataFrame:
    """All reports on one score as rows of section, item, measure and value.

    Sections are `quality`, `confusion` (items: actual outcomes), `sweep` (items: thresholds),
    `sanity` (items: over the threshold or not), `kpis` and `high_risk` (items: customers).
    `scored` is read once per section: stage it first.
    """

    def long(section: str, item: str, table: DataFrame) -> DataFrame:
        measures = [c for c in table.columns if c != item]
        return table.select(
            F.lit(section).alias("section"), F.col(item).cast("string").alias("item"),
            *[F.col(c).cast("double") for c in measures],
        ).unpivot(["section", "item"], measures, "measure", "value")

    whole = lambda table: table.withColumn("_all", F.lit("all"))
    quality = evaluate(scored, label, score)
    numbers = [f.name for f in quality.schema if isinstance(f.dataType, T.NumericType)]
    parts = [
        long("quality", "_all", whole(quality.select(*numbers))),
        long("confusion", "actual", confusion_matrix(scored, label, score, threshold)),
        long("sweep", "threshold", threshold_sweep(scored, thresholds, label, score)),
        long("sanity", "high_score", score_sanity(scored, threshold, label, score)),
        long("kpis", "_all", whole(risk_kpis(scored, threshold, score))),
        long("high_risk", "customer_id", high_risk_customers(scored, threshold, score=score).select(
            "customer_id", score)),
    ]
    return reduce(DataFrame.unionByName, parts)


def class_balance(df: DataFrame, label: str = "churned") -> DataFrame:
    """Churned and kept customers, churn rate and weight of the churned class."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("churned"), neg.alias("retained"),
        ratio(pos, pos + neg).alias("churn_rate"), ratio(neg, pos).alias("scale_pos_weight"),
    )


def score_sanity(
    scored: DataFrame, threshold: float = 0.5, label: str = "churned", score: str = "score"
) -> DataFrame:
    """Observed churn rate above and below a score threshold."""
    return scored.groupBy((F.col(score) > threshold).alias("high_score")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(label).alias("churn_rate")
    )


def high_risk_customers(
    scored: DataFrame, threshold: float = 0.5, limit: int = 50, score: str = "score"
) -> DataFrame:
    """The customers most likely to churn among those at or over a threshold."""
    return (
        scored.where(F.col(score) >= threshold)
        .select("customer_id", "contract", "tenure", "monthly_charges", score)
        .orderBy(F.desc(score), "customer_id")
        .limit(limit)
    )


def risk_kpis(scored: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    """High-risk customers and the MRR they stand for."""
    return scored.where(F.col(score) >= threshold).agg(
        F.count(F.lit(1)).alias("high_risk_customers"),
        F.sum("monthly_charges").alias("mrr_at_risk"),
    )
