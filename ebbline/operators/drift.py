"""Feature drift by population stability index, performance drift, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import exact_quantiles
from ebbline.functions.staging import ensure_checkpoint_dir
from ebbline.functions.scalars import bin_number, ratio

# Bands of the stability index and the tolerated drop in AUC.
WATCH_PSI = 0.10
ALERT_PSI = 0.25
AUC_DROP_ALERT = 0.03
EMPTY_SHARE = 1e-4


def baseline_edges(baseline: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list]:
    """Distinct quantile edges of each numeric feature: `bins` + 1 at most."""
    if not features:
        return {}
    long = baseline.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [], list(features), "feature", "value"
    )
    cuts = exact_quantiles(long, "value", [i / bins for i in range(bins + 1)], ["feature"])
    return {row["feature"]: sorted(set(row["quantiles"])) for row in cuts.collect()}


def _numeric_bin(feature: str, edges: Sequence[float], closed: bool) -> Column:
    if len(edges) < 2:
        # A constant baseline has no distribution to compare with.
        return F.lit("all")
    return bin_number(F.col(feature).cast("double"), edges, closed).cast("string")


def bin_counts(
    df: DataFrame, edges: dict[str, list], categorical: Sequence[str] = (), closed: bool = False
) -> DataFrame:
    """Rows per feature and bin, all features in one pass.

    Numeric features are binned on the given edges. `closed` leaves out values
    beyond the outer edges; open-ended bins count them. Categorical features
    are their own bins.
    """
    labels = {f: _numeric_bin(f, cuts, closed) for f, cuts in edges.items()}
    labels |= {f: F.col(f).cast("string") for f in categorical}
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), label.alias("bin")) for f, label in labels.items()
    ])
    return (
        df.select(*labels)
        .select(F.inline(entries))
        .where(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def psi_from_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Stability index per feature from two tables of bin counts."""
    ensure_checkpoint_dir(expected.sparkSession)
    aligned = expected.withColumnRenamed("n", "_e").join(
        actual.withColumnRenamed("n", "_a"), ["feature", "bin"], "full_outer"
    )
    # Needed for the totals and the shares: both sides are read only once.
    aligned = aligned.checkpoint()
    totals = aligned.groupBy("feature").agg(F.sum("_e").alias("_te"), F.sum("_a").alias("_ta"))
    share = lambda part, whole: F.greatest(
        F.coalesce(ratio(part, whole), F.lit(0.0)), F.lit(EMPTY_SHARE)
    )
    p_expected, p_actual = share("_e", "_te"), share("_a", "_ta")
    return (
        attach_lookup(aligned, totals, ["feature"])
        .groupBy("feature")
        .agg(F.sum((p_actual - p_expected) * F.log(p_actual / p_expected)).alias("psi"))
    )


def psi(
    baseline: DataFrame, new: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
    bins: int = 10, closed: bool = False,
) -> DataFrame:
    """Stability index per feature, binned on the baseline's quantiles."""
    edges = baseline_edges(baseline, numeric, bins)
    return psi_from_counts(
        bin_counts(baseline, edges, categorical, closed), bin_counts(new, edges, categorical, closed)
    )


def psi_flag(value: Column) -> Column:
    return (
        F.when(value < WATCH_PSI, "stable").when(value < ALERT_PSI, "watch").otherwise("alert")
    )


def feature_drift(
    baseline: DataFrame, new: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
    bins: int = 10, closed: bool = False,
) -> DataFrame:
    """Stability index and flag per feature, largest first.

    A feature missing on either side is listed as `skipped`.
    """
    common = set(baseline.columns) & set(new.columns)
    present = lambda names: [n for n in names if n in common]
    skipped = [n for n in [*numeric, *categorical] if n not in common]
    report = psi(baseline, new, present(numeric), present(categorical), bins, closed)
    report = report.withColumn("flag", psi_flag(F.col("psi")))
    if skipped:
        rows = [(name, None, "skipped") for name in skipped]
        report = report.unionByName(
            baseline.sparkSession.createDataFrame(rows, "feature string, psi double, flag string")
        )
    return report.orderBy(F.desc_nulls_last("psi"))


def performance_drift(baseline_auc: Column, evaluation: DataFrame) -> DataFrame:
    """Drop in AUC on newly labelled data, given its `evaluate` row."""
    drop = F.col("baseline_auc") - F.col("new_data_auc")
    return (
        evaluation.select(baseline_auc.alias("baseline_auc"), F.col("roc_auc").alias("new_data_auc"))
        .withColumn("auc_drop", drop)
        .withColumn("flag", F.when(drop > AUC_DROP_ALERT, "alert").otherwise("stable"))
    )


def retrain_decision(drift: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Whether to retrain, and every reason for it, in one row."""
    alert = F.col("flag") == "alert"
    summary = drift.agg(
        F.count_if(alert).alias("n_alert_features"),
        F.count_if(F.col("flag") == "watch").alias("n_watch_features"),
        F.array_sort(
            F.collect_list(F.when(alert, F.struct((-F.col("psi")).alias("o"), F.col("feature"))))
        ).alias("_alerts"),
    )
    quoted = F.transform("_alerts", lambda x: F.format_string("'%s'", x["feature"]))
    # Wording of the reasons.
    shift = F.when(
        F.col("n_alert_features") > 0,
        F.format_string(
            f"%d feature(s) with PSI > {ALERT_PSI} (significant shift): [%s]",
            F.col("n_alert_features"), F.array_join(quoted, ", "),
        ),
    )
    drop = F.lit(None).cast("string")
    if performance is not None:
        p = performance.agg(
            F.first(F.struct("baseline_auc", "new_data_auc", "auc_drop", "flag"))
        ).scalar()
        summary = summary.withColumn("_p", p)
        drop = F.when(
            F.col("_p.flag") == "alert",
            F.format_string(
                "AUC dropped %.3f on new labeled data (%.3f -> %.3f)",
                F.col("_p.auc_drop"), F.col("_p.baseline_auc"), F.col("_p.new_data_auc"),
            ),
        )
    return (
        summary.withColumn("reasons", F.array_compact(F.array(shift, drop)))
        .select(
            (F.size("reasons") > 0).alias("should_retrain"),
            F.array_join("reasons", "; ").alias("reasons"),
            "n_alert_features", "n_watch_features",
            F.current_timestamp().alias("checked_at"),
        )
    )
