"""Churn classifiers on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ebbline.functions.staging import scratch_path
from ebbline.operators import boosting
from ebbline.operators.scoring import evaluate, roc_auc
from ebbline.operators.splits import stratified_folds

Trainer = Callable[[DataFrame], Model]

#: Bytes of features below which a training partition is not divided. A boosted fit is over
#: a thousand passes, so a partition that takes no longer than starting its task is a waste.
PARTITION_BYTES = 4 << 20

#: Bytes of features in a training partition at most; so much has to fit in memory per core.
MAX_PARTITION_BYTES = 256 << 20

#: Bytes of features up to which a boosted fit is one task. Its 1,200 passes as Spark jobs took 40 s for 148 rows
#: on eight local cores, several times that for five fits side by side. In one task each, five fits of 71,000 rows
#: (19 MB) took under a minute; beyond this bound one fit gains from more cores than it loses by its jobs.
ONE_TASK_BYTES = 64 << 20


def _partition_count(size: int, cores: int) -> int:
    """One partition per core, fewer for a small input, a multiple if memory asks for it.

    Every pass of a fit ends with its slowest core, so a partition over the cores' number
    would make each pass last twice as long.
    """
    whole_rounds = cores * math.ceil(size / (cores * MAX_PARTITION_BYTES))
    return max(1, min(math.ceil(size / PARTITION_BYTES), whole_rounds))


def _shape(train: DataFrame) -> Row:
    """Numbers of kept and churned rows, and of features."""
    return train.agg(
        F.count_if(F.col("label") == 0).alias("neg"),
        F.count_if(F.col("label") == 1).alias("pos"),
        F.max(F.size(vector_to_array("features"))).alias("width"),
    ).first()


def _size(shape: Row) -> int:
    return 8 * (shape["width"] or 0) * (shape["neg"] + shape["pos"])


@contextmanager
def _balanced(
    train: DataFrame, weights: Callable[[int, int], tuple[float, float]], shape: Row | None = None
) -> Iterator[DataFrame]:
    """Training rows with a `weight` per class, in even partitions for _partition_count().

    `weights` gets the numbers of kept and churned rows and returns the weight of each.
    `train` is read twice (`shape` saves one time): stage it first. A fit takes what it needs from the rows in a few
    passes and keeps that; a small input is kept in memory here, a larger one is dealt out
    once, and its shuffle files are what the passes read.
    """
    row = shape or _shape(train)
    if not row["neg"] or not row["pos"]:
        raise ValueError("training needs rows of both classes")
    negative, positive = weights(row["neg"], row["pos"])
    n = _partition_count(_size(row), train.sparkSession.sparkContext.defaultParallelism)
    weight = F.when(F.col("label") == 1, positive).otherwise(negative)
    if n > 1:
        yield train.repartition(n).withColumn("weight", weight)
        return
    level = train.storageLevel
    cached_before = level.useMemory or level.useDisk
    kept = train if cached_before else train.persist()
    try:
        yield kept.coalesce(1).withColumn("weight", weight)
    finally:
        if not cached_before:
            kept.unpersist()


def train_logistic(
    train: DataFrame, strength: float = 0.5, max_iter: int = 1000
) -> LogisticRegressionModel:
    """Standardised logistic regression with balanced classes.

    `strength` is the inverse regularisation of a summed loss. The loss here is
    a weighted mean and the balanced weights add up to the row count `n`, so
    the penalty is divided by it. The model is the saved one, read again: a fitted model
    keeps its training summary, and with it the session, which tasks cannot be sent.
    """
    n = 0

    def balance(neg: int, pos: int) -> tuple[float, float]:
        nonlocal n
        n = neg + pos
        return n / (2 * neg), n / (2 * pos)

    with _balanced(train, balance) as rows:
        fitted = LogisticRegression(
            weightCol="weight", standardization=True, maxIter=max_iter, regParam=1 / (strength * n)
        ).fit(rows)
    return load_logistic(save_model(fitted, scratch_path(train.sparkSession, "logistic")))


def train_boosted(
    train: DataFrame, trees: int = 300, depth: int = 4, step: float = 0.05, seed: int = 42
) -> GBTClassificationModel:
    """Gradient-boosted trees; the churned class is weighted up to balance.

    Up to ONE_TASK_BYTES of features a fit is one task, beyond that (or with features marked as
    categories) Spark's passes over partitions. Both give the same trees.
    """
    shape = _shape(train)
    kinds = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    with _balanced(train, lambda neg, pos: (1.0, neg / pos), shape) as rows:
        if _size(shape) <= ONE_TASK_BYTES and set(kinds) <= {"numeric"}:
            return boosting.fit(rows, shape["width"], trees, depth, step, seed)
        return GBTClassifier(
            weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", seed=seed,
        ).fit(rows)


def score(model: Model, features: DataFrame, name: str = "score") -> DataFrame:
    """Add the predicted churn probability."""
    scored = model.transform(features).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*features.columns, name)


def evaluate_model(model: Model, test: DataFrame, name: str = "") -> DataFrame:
    return evaluate(score(model, test), "label", "score", name=name)


def cross_validate(
    train_fn: Trainer, features: DataFrame, folds: int = 5, id_column: str = "customerID",
    seed: int = 42, side_by_side: int | None = None,
) -> DataFrame:
    """AUC per fold, with their mean and population standard deviation.

    Folds share the assigned rows and are fitted `side_by_side` (all of them unless given):
    the many short passes of one fit leave room for those of another.
    """
    assigned = stratified_folds(features, folds, "label", id_column, seed).persist()

    def auc(k: int) -> tuple[int, float]:
        model = train_fn(assigned.where(F.col("fold") != k).drop("fold"))
        held_out = assigned.where(F.col("fold") == k).drop("fold")
        return k, roc_auc(score(model, held_out), "label")

    try:
        assigned.count()  # kept before the folds start, so that it is derived once
        with ThreadPoolExecutor(side_by_side or folds) as pool:
            scores = list(pool.map(inheritable_thread_target(auc), range(folds)))
    finally:
        assigned.unpersist()
    table = features.sparkSession.createDataFrame(scores, "fold int, roc_auc double")
    moments = table.agg(
        F.struct(F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std"))
    ).scalar()
    return table.withColumn("_m", moments).select(
        "fold", "roc_auc", F.col("_m.mean").alias("mean_auc"), F.col("_m.std").alias("std_auc")
    )


def feature_importance(model: GBTClassificationModel, names: Sequence[str], top: int = 20) -> DataFrame:
    """The most important features of a tree model, largest first."""
    weights = model.featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(names, weights)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def save_model(model: Model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_boosted(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)


def load_logistic(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def retrain_and_compare(
    train_fn: Trainer, new_train: DataFrame, test: DataFrame, old_model: Model
) -> tuple[Model, DataFrame]:
    """Train on new data and compare both models on rows neither has seen."""
    new_model = train_fn(new_train)
    old_auc = roc_auc(score(old_model, test), "label")
    new_auc = roc_auc(score(new_model, test), "label")
    row = [(old_auc, new_auc, new_auc > old_auc, new_auc - old_auc)]
    report = test.sparkSession.createDataFrame(
        row, "old_model_auc double, new_model_auc double, improved boolean, delta double"
    ).withColumn("retrained_at", F.current_timestamp())
    return new_model, report


def retrain_if_needed(
    train_fn: Trainer, new_train: DataFrame, test: DataFrame, old_model: Model, decision: DataFrame
) -> DataFrame:
    """The comparison of retrain_and_compare() with the decision's verdict and reasons.

    Nothing is trained unless the decision (a row of `drift.retrain_decision`) says so; the
    new model's figures are null then.
    """
    row = decision.select("should_retrain", "reasons").first()
    if row["should_retrain"]:
        _, report = retrain_and_compare(train_fn, new_train, test, old_model)
    else:
        kept = [(roc_auc(score(old_model, test), "label"), None, None, None)]
        report = test.sparkSession.createDataFrame(
            kept, "old_model_auc double, new_model_auc double, improved boolean, delta double"
        ).withColumn("retrained_at", F.lit(None).cast("timestamp"))
    return report.withColumns({
        "should_retrain": F.lit(row["should_retrain"]), "reasons": F.lit(row["reasons"]),
    })
