"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extra decimal places kept before the final rounding. Sums of doubles differ in
# their last bits with the order in which partitions are merged; settling them
# first makes reported ties independent of the cluster's shape.
SETTLE_EXTRA = 3


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded(value: Column | str, digits: int) -> Column:
    """Round half away from zero, without letting float noise decide ties."""
    return F.round(F.round(as_column(value), digits + SETTLE_EXTRA), digits)


def rounded_even(value: Column | str, digits: int) -> Column:
    """Round half to even."""
    return F.bround(F.round(as_column(value), digits + SETTLE_EXTRA), digits)


def round_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named columns of a report, leaving the others untouched."""
    return df.withColumns({name: rounded(name, d) for name, d in digits.items()})


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields null for a zero denominator."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    return ratio(numerator, denominator) * 100


def yes_flag(value: Column | str) -> Column:
    """1 for 'Yes', 0 for everything else including null."""
    return F.when(as_column(value) == "Yes", 1).otherwise(0)


def safe_double(value: Column | str) -> Column:
    """Number, or null where the text is not a number."""
    return as_column(value).try_cast("double")


def churn_flag(df: DataFrame, name: str) -> Column:
    """0/1 churn event from a Yes/No text column or a numeric/boolean one."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return yes_flag(name)
    return F.col(name).cast("int")


def portable_key(id_column: Column | str, seed: int) -> Column:
    """A hash of an id and a seed that any SQL engine can state: md5 of `id-seed`."""
    return F.md5(F.concat(as_column(id_column).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def cents(value: Column | str) -> Column:
    """Money as whole cents, so that sums are exact whatever their order."""
    return F.round(as_column(value) * 100).cast("long")


def month_start(value: Column | str) -> Column:
    return F.trunc(as_column(value), "month")


def month_index(value: Column | str) -> Column:
    """Months since year 0, for differences between calendar months."""
    value = as_column(value)
    return F.year(value) * 12 + F.month(value)


def months_before(reference: str, months: Column | str) -> Column:
    """The day `months` before a reference date, clipped to the month's end."""
    return F.add_months(F.to_date(F.lit(reference)), -as_column(months).cast("int"))


def add_flags(names: Sequence[str]) -> Column:
    """Row-wise sum of flag columns; nulls count as 0."""
    return reduce(add, [F.coalesce(F.col(n), F.lit(0)) for n in names])


def clip(value: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    value = as_column(value)
    bounded = value
    if lower is not None:
        bounded = F.greatest(bounded, F.lit(lower))
    if upper is not None:
        bounded = F.least(bounded, F.lit(upper))
    return F.when(value.isNotNull(), bounded)


# Tenure bands. Edges are inclusive upper bounds of each label; the first
# number is the exclusive (or, for the report bands, inclusive) lower limit.
FEATURE_BANDS = dict(
    edges=[0, 12, 24, 36, 48, 60, 72],
    labels=["0-12 mo", "13-24 mo", "25-36 mo", "37-48 mo", "49-60 mo", "61-72 mo"],
)
REPORT_BANDS = dict(
    edges=[0, 12, 24, 36, 48, 60],
    labels=["00-12 months", "13-24 months", "25-36 months", "37-48 months", "49-60 months"],
    include_lowest=True,
    else_label="61+ months",
)
EARLY_LIFE_BANDS = dict(
    edges=[0, 6, 12, 24, 36, 48, 72],
    labels=["0–6 mo", "7–12 mo", "13–24 mo", "25–36 mo", "37–48 mo", "49–72 mo"],
)


def band(
    value: Column | str,
    edges: Sequence[float],
    labels: Sequence[str],
    include_lowest: bool = False,
    else_label: str | None = None,
) -> Column:
    """Label of the right-closed interval a value falls in.

    Values outside every interval get `else_label` (null by default).
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    value = as_column(value)
    above_lowest = value >= edges[0] if include_lowest else value > edges[0]
    expr = F.when(above_lowest & (value <= edges[1]), labels[0])
    for lower, upper, label in zip(edges[1:], edges[2:], labels[1:]):
        expr = expr.when((value > lower) & (value <= upper), label)
    return expr.otherwise(F.lit(else_label))


def bin_number(value: Column | str, edges: Sequence[float], closed: bool = True) -> Column:
    """Index of the right-closed interval, the lowest edge included.

    With `closed` values beyond the outer edges get null; otherwise the outer
    intervals are open-ended.
    """
    value = as_column(value)
    inner = edges[1:-1]
    number = reduce(add, [(value > e).cast("int") for e in inner], F.lit(0))
    usable = value.isNotNull()
    if closed:
        usable = usable & (value >= edges[0]) & (value <= edges[-1])
    return F.when(usable, number)


def month_label(value: Column | str) -> Column:
    return F.date_format(as_column(value), "yyyy-MM")


def percent_text(value: Column | str, digits: int = 1, signed: bool = False) -> Column:
    sign = "+" if signed else ""
    return F.format_string(f"%{sign}.{digits}f%%", rounded(as_column(value) * 100, digits))
