"""The log of drift checks and retraining decisions, for jobs that run without a stream.

A check has a name, such as the period it looked at. Its rows lie in a folder of that name,
so a check that is repeated after a failure, or run again on corrected data, replaces its
own rows. Checks at once write different folders.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.operators import drift
from ebbline.schemas import DRIFT_LOG
from ebbline.sources.store import path_exists, save_table

LOGGED = T.StructType(
    [f for f in DRIFT_LOG if f.name != "check_id"] + [T.StructField("check", T.StringType())])


def log_check(
    spark: SparkSession, root: str, check: str, report: DataFrame, performance: DataFrame | None = None
) -> DataFrame:
    """Decide on a drift report and log it: one row per feature. The decision, in one row.

    `report` has `feature`, `psi` and `flag`; it is written first, so it is derived once. A
    report without features logs nothing and decides by `performance` alone.
    """
    if not re.fullmatch(r"\w[\w.-]*", check):
        raise ValueError(f"a check's name becomes a folder: {check!r}")
    report = spark.read.schema("feature string, psi double, flag string").parquet(
        save_table(report.select("feature", "psi", "flag"), f"{root}/drift_checks/reports/{check}"))
    # One row, so that the log and the caller have the same time of the check.
    decided = drift.retrain_decision(report, performance)
    decision = spark.createDataFrame(decided.collect(), decided.schema)
    found = decision.select(F.struct("should_retrain", "reasons", "checked_at")).scalar()
    rows = report.withColumn("_d", found).select(
        "feature", "psi", "flag", *[F.col(f"_d.{c}").alias(c) for c in ("should_retrain", "reasons", "checked_at")])
    save_table(
        rows.select(*[F.col(f.name).cast(f.dataType) for f in LOGGED if f.name != "check"]),
        f"{root}/drift_checks/log/check={check}")
    return decision


def logged_checks(spark: SparkSession, root: str) -> DataFrame:
    """Every logged check, numbered from 1 in the order of their names."""
    path = f"{root}/drift_checks/log"
    columns = ["check_id", "check", *[n for n in DRIFT_LOG.names if n != "check_id"]]
    if not path_exists(spark, path):
        empty = T.StructType([DRIFT_LOG["check_id"], LOGGED["check"], *[DRIFT_LOG[c] for c in columns[2:]]])
        return spark.createDataFrame([], empty)
    log = spark.read.schema(LOGGED).parquet(path)
    # One row per check.
    numbers = log.select("check").distinct().withColumn(
        "check_id", F.row_number().over(Window.partitionBy().orderBy("check")).cast("long"))
    return log.join(numbers, "check").select(*columns)
