"""Retention experiments: assignment, significance, and sample size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.ordering import exact_quantiles
from ebbline.functions.scalars import percent_text, portable_key, ratio
from ebbline.functions.stats import normal_quantile, two_sided_p


def experiment_population(
    scored: DataFrame, quantile: float = 0.70, score: str = "score"
) -> DataFrame:
    """Customers at or over a quantile of the score."""
    cut = exact_quantiles(scored, score, [quantile]).select(F.col("quantiles")[0]).scalar()
    return scored.withColumn("_cut", cut).where(F.col(score) >= F.col("_cut")).drop("_cut")


def assign_arms(df: DataFrame, id_column: str = "customer_id", seed: int = 42) -> DataFrame:
    """Even split into control and treatment, the same on every run."""
    digit = F.substring(portable_key(id_column, seed), 1, 1)
    return df.withColumn("arm", F.when(digit.isin(*"02468ace"), "control").otherwise("treatment"))


def analyze_experiment(
    df: DataFrame, arm: str = "arm", outcome: str = "churned", alpha: float = 0.05,
    by: Sequence[str] = (), true_effect: float | None = None,
) -> DataFrame:
    """Two-proportion z-test with a Wald interval on the absolute effect.

    One row, or one per group of `by`. A positive effect means that treatment
    reduced churn. With `true_effect`, `covers_true_effect` tells whether the
    interval contains it.
    """
    happened = F.col(outcome).cast("int")
    arm_sums = []
    for short, value in (("c", "control"), ("t", "treatment")):
        inside = F.col(arm) == value
        arm_sums += [
            F.count_if(inside).alias(f"n_{short}"),
            F.sum(F.when(inside, happened)).alias(f"x_{short}"),
        ]
    n_c, n_t, x_c, x_t = (F.col(c) for c in ["n_c", "n_t", "x_c", "x_t"])
    p_c, p_t = ratio(x_c, n_c), ratio(x_t, n_t)
    pooled = ratio(x_c + x_t, n_c + n_t)
    se_pooled = F.sqrt(pooled * (1 - pooled) * (ratio(F.lit(1), n_c) + ratio(F.lit(1), n_t)))
    se_apart = F.sqrt(ratio(p_c * (1 - p_c), n_c) + ratio(p_t * (1 - p_t), n_t))
    effect = F.col("absolute_effect")
    critical = normal_quantile(1 - alpha / 2)
    result = (
        df.groupBy(*by)
        .agg(*arm_sums)
        .select(
            *by,
            n_c.alias("n_control"),
            n_t.alias("n_treatment"),
            p_c.alias("churn_rate_control"),
            p_t.alias("churn_rate_treatment"),
            (p_c - p_t).alias("absolute_effect"),
            ratio(p_c - p_t, p_c).alias("relative_effect"),
            F.when(se_pooled > 0, (p_c - p_t) / se_pooled)
            .when(se_pooled == 0, 0.0).alias("z_stat"),
            se_apart.alias("_se"),
        )
        .withColumn("p_value", two_sided_p(F.col("z_stat")))
        .withColumn("ci_low", effect - critical * F.col("_se"))
        .withColumn("ci_high", effect + critical * F.col("_se"))
        .withColumn("significant", F.col("p_value") < alpha)
        .withColumn("alpha", F.lit(float(alpha)))
        .drop("_se")
    )
    if true_effect is not None:
        result = result.withColumn(
            "covers_true_effect", F.lit(true_effect).between(F.col("ci_low"), F.col("ci_high"))
        )
    return result


def sample_size(
    baseline_rate: Column, effect: Column, alpha: float = 0.05, power: float = 0.80
) -> Column:
    """Customers needed per arm to detect an absolute drop in churn."""
    p1, p2 = baseline_rate, baseline_rate - effect
    middle = (p1 + p2) / 2
    spread = (
        normal_quantile(1 - alpha / 2) * F.sqrt(2 * middle * (1 - middle))
        + normal_quantile(power) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    )
    return F.ceil(ratio(spread * spread, effect * effect)).cast("long")


def sample_size_sweep(
    baseline: DataFrame, effects: Sequence[float], rate: str = "baseline_rate",
    alpha: float = 0.05, power: float = 0.80,
) -> DataFrame:
    """Sample sizes for several effects, given a one-row baseline rate."""
    options = F.array(*[F.lit(float(e)) for e in effects])
    per_arm = sample_size(F.col(rate), F.col("minimum_detectable_effect"), alpha, power)
    return (
        baseline.select(rate, F.explode(options).alias("minimum_detectable_effect"))
        .withColumn("n_per_arm", per_arm)
        .withColumn("n_total", F.col("n_per_arm") * 2)
    )


def summarize_result(result: DataFrame) -> DataFrame:
    """The result in a sentence or two for readers who know no statistics."""
    # Wording of the summary.
    verdict = F.when(
        F.col("significant"), "a statistically significant"
    ).otherwise("not a statistically significant")
    direction = F.when(F.col("absolute_effect") > 0, "reduced").otherwise("increased")
    text = F.format_string(
        "The intervention showed %s effect on churn (p = %.4f, alpha = %s). "
        "Control arm churn rate: %s (n=%d). Treatment arm churn rate: %s (n=%d). "
        "The intervention %s churn by %s percentage points (%s relative change), "
        "95%% CI: [%s, %s].",
        verdict, "p_value", F.col("alpha").cast("string"),
        percent_text("churn_rate_control"), "n_control",
        percent_text("churn_rate_treatment"), "n_treatment",
        direction, percent_text(F.abs("absolute_effect")),
        percent_text("relative_effect", signed=True),
        percent_text("ci_low"), percent_text("ci_high"),
    )
    return result.withColumn("summary", text)


def power_warning(result: DataFrame, needed_per_arm: Column) -> DataFrame:
    """Flag a non-significant result whose arms were smaller than needed."""
    total = F.col("n_control") + F.col("n_treatment")
    return result.withColumn("n_needed_per_arm", needed_per_arm).withColumn(
        "underpowered",
        (F.col("n_needed_per_arm") > total / 2) & ~F.col("significant"),
    )
