"""Cleaning the raw customer snapshot and deriving model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.scalars import (
    FEATURE_BANDS,
    add_flags,
    band,
    churn_flag,
    month_start,
    months_before,
    safe_double,
    yes_flag,
)
from ebbline.schemas import BINARY_COLUMNS, CATEGORICAL_COLUMNS, SERVICE_COLUMNS

MAX_LEVELS = 1000


def typed_customers(raw: DataFrame, reference_date: str) -> DataFrame:
    """Typed snake_case customer table; rows without a total charge are dropped."""
    flags = dict(
        partner="Partner", dependents="Dependents", phone_service="PhoneService",
        multiple_lines="MultipleLines", online_security="OnlineSecurity",
        online_backup="OnlineBackup", device_protection="DeviceProtection",
        tech_support="TechSupport", streaming_tv="StreamingTV",
        streaming_movies="StreamingMovies", paperless_billing="PaperlessBilling",
        churned="Churn",
    )
    signup = months_before(reference_date, "tenure")
    return raw.select(
        "customerID",
        "gender",
        F.col("SeniorCitizen").cast("int").alias("senior_citizen"),
        F.col("tenure").cast("int").alias("tenure"),
        F.col("InternetService").alias("internet_service"),
        F.col("Contract").alias("contract"),
        F.col("PaymentMethod").alias("payment_method"),
        F.col("MonthlyCharges").cast("double").alias("monthly_charges"),
        safe_double("TotalCharges").alias("total_charges"),
        *[yes_flag(source).alias(name) for name, source in flags.items()],
        signup.alias("signup_date"),
        month_start(signup).alias("signup_month"),
    ).where(F.col("total_charges").isNotNull())


def dropped_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """How many rows lack a required column, counted in one pass."""
    incomplete = F.lit(False)
    for name in required:
        incomplete = incomplete | F.col(name).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~incomplete).alias("rows_after"),
        F.count_if(incomplete).alias("rows_dropped"),
    )


def coerce_totals(raw: DataFrame) -> DataFrame:
    return raw.withColumn("TotalCharges", safe_double("TotalCharges"))


def clean(df: DataFrame) -> DataFrame:
    """Drop rows without a total, turn Yes/No columns into 0/1 flags."""
    flags = {name: yes_flag(name) for name in BINARY_COLUMNS + SERVICE_COLUMNS}
    return (
        df.na.drop(subset=["TotalCharges"])
        .withColumns(flags)
        .withColumnRenamed("SeniorCitizen", "senior_citizen")
    )


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of categorical columns, found in one pass.

    The number of values is bounded: a column with more is no category.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns
    ])
    found = (
        df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct()
        .limit(MAX_LEVELS * len(columns) + 1).collect()
    )
    known = {c: sorted(row["level"] for row in found if row["name"] == c) for c in columns}
    for column, values in known.items():
        if len(values) > MAX_LEVELS or len(found) > MAX_LEVELS * len(columns):
            raise ValueError(f"more than {MAX_LEVELS} levels, e.g. in {column}")
    return known


def one_hot(
    df: DataFrame, columns: Sequence[str], drop_first: bool = False,
    domains: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Add a 0/1 column `<column>_<level>` per level; nulls get zeros.

    The source columns stay. `drop_first` leaves out the first level as the
    reference. `domains` supplies known levels and saves looking them up.
    """
    known = dict(domains or {})
    unknown = [c for c in columns if c not in known]
    if unknown:
        known |= levels(df, unknown)
    added = {}
    for column in columns:
        for level in known[column][1 if drop_first else 0:]:
            is_level = F.col(column).cast("string") == level
            added[f"{column}_{level}"] = F.when(is_level, 1).otherwise(0)
    return df.withColumns(added)


def segment_label(df: DataFrame, column: str):
    """The segment column itself, or its value recovered from one-hot columns.

    Ties and all-zero rows resolve to the first one-hot column.
    """
    if column in df.columns:
        return F.col(column)
    prefix = f"{column}_"
    hot = [c for c in df.columns if c.startswith(prefix)]
    if not hot:
        raise KeyError(f"neither {column} nor one-hot columns {prefix}* are present")
    quoted = [F.col(f"`{c}`").cast("int") for c in hot]
    top = F.greatest(*quoted) if len(quoted) > 1 else quoted[0]
    label = F.lit(hot[0][len(prefix):])
    for value, name in reversed(list(zip(quoted, hot))):
        label = F.when(value == top, name[len(prefix):]).otherwise(label)
    return label


def add_features(
    df: DataFrame, reference_date: str, categorical: Sequence[str] = tuple(CATEGORICAL_COLUMNS),
    domains: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Sign-up date, tenure band, add-on count, log charge and one-hot columns."""
    signup = months_before(reference_date, "tenure")
    derived = df.withColumns(
        {
            "signup_date": signup,
            "signup_month": month_start(signup),
            "tenure_band": band("tenure", **FEATURE_BANDS),
            "num_addons": add_flags(SERVICE_COLUMNS),
            "log_monthly_charges": F.log1p("MonthlyCharges"),
        }
    )
    return one_hot(derived, categorical, domains=domains)


def preprocess(raw: DataFrame, reference_date: str) -> DataFrame:
    """Raw snapshot to feature table: coerce, clean, derive."""
    cleaned = raw.transform(coerce_totals).transform(clean)
    return add_features(cleaned, reference_date)


# Columns that identify a row, are dates, or would leak the outcome.
NOT_FEATURES = [
    "customerID", "customer_id", "Churn", "churned", "signup_date", "signup_month",
    "tenure_band", "TotalCharges", "total_charges",
]


def feature_names(df: DataFrame) -> list[str]:
    numeric = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema
        if f.name not in NOT_FEATURES and isinstance(f.dataType, numeric)
    ]


def model_features(df: DataFrame, id_column: str = "customerID", label: str = "Churn") -> DataFrame:
    """Id, `label` and the assembled `features` vector."""
    names = feature_names(df)
    safe = {name: f"f{i}" for i, name in enumerate(names)}
    numbers = df.select(
        id_column,
        churn_flag(df, label).cast("double").alias("label"),
        *[F.col(f"`{n}`").cast("double").alias(a) for n, a in safe.items()],
    )
    assembler = VectorAssembler(
        inputCols=list(safe.values()), outputCol="features", handleInvalid="keep"
    )
    return assembler.transform(numbers).select(id_column, "label", "features")


def shift_column(df: DataFrame, column: str, factor: float) -> DataFrame:
    """What-if multiplication of a raw column; apply it before deriving features."""
    return df.withColumn(column, F.col(column) * factor)
