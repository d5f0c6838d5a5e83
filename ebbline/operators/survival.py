"""Kaplan-Meier lifetimes and the customer value derived from them.

Only counts per segment and duration leave the customer table. The curves are
then windows over at most `tmax` rows per segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions.grids import add_zero_rows
from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import exact_quantiles
from ebbline.functions.scalars import churn_flag, portable_key, ratio, rounded_even

MAX_TENURE_MONTHS = 72
CLV_TIERS = ["Low Value", "Medium Value", "High Value"]


def survival_curve(
    df: DataFrame, by: Sequence[str] = (), duration: str = "tenure", event: str = "churned",
    tmax: int = MAX_TENURE_MONTHS, value: str | None = None,
) -> DataFrame:
    """Survival at 0..tmax per segment, with customers at risk and events.

    After the last observation the curve stays flat. With `value`, the number
    of customers and their summed value are added as `n_total`, `value_total`.
    """
    known = df.where(F.col(duration).isNotNull())
    for name in by:
        known = known.where(F.col(name).isNotNull())
    amount = F.col(value).cast("double") if value else F.lit(0.0)
    stopped = known.groupBy(*by, F.col(duration).cast("double").alias("t")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(churn_flag(df, event)).alias("_d"),
        F.sum(amount).alias("_v"),
    )
    # Small from here on: one row per segment and duration.
    dense = add_zero_rows(stopped, by, "t", F.lit(tmax), ["_n", "_d", "_v"])
    whole = Window.partitionBy(*by)
    later = whole.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = [F.sum("_n").over(whole).alias("n_total"), F.sum("_v").over(whole).alias("value_total")]
    return (
        dense.select(*by, "t", F.sum("_n").over(later).alias("at_risk"), F.col("_d").alias("events"), *totals)
        .withColumn("_stay", F.coalesce(1 - ratio("events", "at_risk"), F.lit(1.0)))
        # A product, not a sum of logs: the curve may reach zero.
        .withColumn("survival", F.product("_stay").over(so_far))
        .where((F.col("t") <= tmax) & (F.col("t") == F.floor("t")))
        .withColumn("t", F.col("t").cast("int"))
        .select(
            *by, "t", "at_risk", "events", "survival",
            *(["n_total", "value_total"] if value else []),
        )
    )


def _trapezoids(curve: DataFrame, by: Sequence[str], survival: str = "survival") -> DataFrame:
    before = F.lag(survival).over(Window.partitionBy(*by).orderBy("t"))
    return curve.withColumn("_area", (F.col(survival) + before) / 2)


def expected_lifetime(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Restricted mean lifetime: trapezoid area under the curve."""
    return _trapezoids(curve, by).groupBy(*by).agg(
        F.sum("_area").alias("expected_lifetime_months")
    )


def lifetime_by_segment(
    df: DataFrame, segment: str = "contract", duration: str = "tenure", event: str = "churned",
    tmax: int = MAX_TENURE_MONTHS,
) -> DataFrame:
    return expected_lifetime(survival_curve(df, [segment], duration, event, tmax), [segment])


def customer_value(
    df: DataFrame, segment: str = "contract", duration: str = "tenure", event: str = "churned",
    charge: str = "monthly_charges", margin: float = 0.75, tmax: int = MAX_TENURE_MONTHS,
) -> DataFrame:
    """Add `expected_lifetime_months` and `clv` to every customer."""
    lifetimes = lifetime_by_segment(df, segment, duration, event, tmax)
    return attach_lookup(df, lifetimes, [segment], "left").withColumn(
        "clv", F.col(charge) * margin * F.col("expected_lifetime_months")
    )


def unit_economics(
    df: DataFrame, cac: float = 250.0, margin: float = 0.75, charge: str = "monthly_charges"
) -> DataFrame:
    """Add `cac`, `ltv_cac_ratio` and `payback_months`."""
    return df.withColumns(
        {
            "cac": F.lit(float(cac)),
            "ltv_cac_ratio": ratio("clv", F.lit(float(cac))),
            "payback_months": ratio(F.lit(float(cac)), F.col(charge) * margin),
        }
    )


def value_tiers(df: DataFrame) -> DataFrame:
    """Add `clv_segment` from the exact 33rd and 66th percentiles of `clv`."""
    cuts = exact_quantiles(df, "clv", [0.33, 0.66]).select("quantiles").scalar()
    low, medium, high = CLV_TIERS
    return (
        df.withColumn("_cuts", cuts)
        .withColumn(
            "clv_segment",
            F.when(F.col("clv") <= F.col("_cuts")[0], low)
            .when(F.col("clv") <= F.col("_cuts")[1], medium)
            .when(F.col("clv").isNotNull(), high),
        )
        .drop("_cuts")
    )


def churn_reduction_scenario(
    df: DataFrame, segment_value: str, reductions: Sequence[float] = (0.05,),
    segment: str = "contract", duration: str = "tenure", event: str = "churned",
    charge: str = "monthly_charges", margin: float = 0.75, tmax: int = MAX_TENURE_MONTHS,
) -> DataFrame:
    """CLV if a segment's churn incidence by `tmax` fell, one row per reduction.

    The segment's curve is raised to the power that brings the incidence to
    its target (proportional hazards). A curve that ends at 0 or 1 has no such
    power; the new figures are then null and `note` says so.
    """
    members = df.where(F.col(segment) == segment_value)
    curve = survival_curve(members, [], duration, event, tmax, value=charge)
    # `tmax` + 1 rows from here on.
    end = F.max_by("survival", "t").over(Window.partitionBy())
    target = 1 - F.greatest(1 - F.col("_end") - F.col("reduction"), F.lit(0.001))
    usable = (F.col("_end") > 0) & (F.col("_end") < 1)
    power = F.when(usable, F.try_divide(F.log(target), F.log("_end")))
    scaled = (
        curve.withColumn("_end", end)
        .withColumn("reduction", F.explode(F.array(*[F.lit(float(x)) for x in reductions])))
        .withColumn("_new", F.pow(F.col("survival"), power))
    )
    by_reduction = Window.partitionBy("reduction").orderBy("t")
    area = lambda c: F.sum((F.col(c) + F.col(f"_before{c}")) / 2)
    areas = (
        scaled.withColumn("_beforesurvival", F.lag("survival").over(by_reduction))
        .withColumn("_before_new", F.lag("_new").over(by_reduction))
        .groupBy("reduction", "_end", "n_total", "value_total")
        .agg(area("survival").alias("old"), area("_new").alias("new"))
    )
    per_month = ratio("value_total", "n_total") * margin
    n = F.col("n_total")
    old, new = per_month * F.col("old"), per_month * F.col("new")
    return areas.select(
        F.lit(segment_value).alias("segment"),
        "reduction",
        n.alias("n_customers"),
        (1 - F.col("_end")).alias("churn_incidence_old"),
        F.when(usable, 1 - target).alias("churn_incidence_new"),
        F.col("old").alias("expected_lifetime_old"),
        F.col("new").alias("expected_lifetime_new"),
        old.alias("clv_per_customer_old"),
        new.alias("clv_per_customer_new"),
        (old * n).alias("portfolio_clv_old"),
        (new * n).alias("portfolio_clv_new"),
        ((new - old) * n).alias("incremental_portfolio_clv"),
        F.when(~usable, "survival at the horizon is 0 or 1").alias("note"),
    ).orderBy("reduction")


def value_summary(df: DataFrame, segment: str = "contract") -> DataFrame:
    """Customers, mean and median CLV and average unit economics per segment."""
    medians = exact_quantiles(
        df.where(F.col(segment).isNotNull()), "clv", [0.5], [segment]
    ).select(segment, F.col("quantiles")[0].alias("_median"))
    means = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.count("clv").alias("n_customers"),
        F.avg("clv").alias("avg_clv"),
        F.avg("monthly_charges").alias("avg_monthly_charges"),
        F.avg("expected_lifetime_months").alias("avg_lifetime_months"),
        F.avg("payback_months").alias("avg_payback_months"),
        F.avg("ltv_cac_ratio").alias("avg_ltv_cac"),
    )
    return means.join(medians, segment, "left").select(
        segment, "n_customers",
        rounded_even("avg_clv", 2).alias("avg_clv"),
        rounded_even("_median", 2).alias("median_clv"),
        *[
            rounded_even(c, 2).alias(c)
            for c in ["avg_monthly_charges", "avg_lifetime_months", "avg_payback_months", "avg_ltv_cac"]
        ],
    ).orderBy(segment)


def value_kpis(df: DataFrame) -> DataFrame:
    """Portfolio averages, median, healthy share and total CLV."""
    median = exact_quantiles(df, "clv", [0.5]).select(F.col("quantiles")[0]).scalar()
    healthy = F.when(F.col("ltv_cac_ratio") >= 3, 1.0).otherwise(0.0)
    return df.agg(
        F.avg("clv").alias("avg_clv"),
        F.avg("ltv_cac_ratio").alias("avg_ltv_cac"),
        F.avg("payback_months").alias("avg_payback_months"),
        F.avg(healthy).alias("pct_healthy_ltv_cac"),
        F.sum("clv").alias("total_portfolio_clv"),
    ).withColumn("median_clv", median)


def fixed_sample(df: DataFrame, n: int, id_column: str = "customer_id", seed: int = 42) -> DataFrame:
    """The same `n` rows every time, whatever the partitioning."""
    return df.orderBy(portable_key(id_column, seed), id_column).limit(n)
