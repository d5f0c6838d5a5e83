"""Boosted fits in one task against Spark's own, tree by tree."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ebbline.operators import boosting, churn_model
from ebbline.sources import store


def _rows(spark, n, opposite=True):
    """A wide number, a narrow one, a level, its opposite (as good to split by), a constant and mostly zeros."""
    draw = random.Random(7)
    rows = []
    for i in range(n):
        a, b, c = draw.gauss(0, 1), draw.randrange(5), draw.randrange(2)
        d = draw.random() if draw.random() < 0.1 else 0.0
        odds = 1 / (1 + np.exp(-a + b / 3 - c))
        rows.append((i, float(draw.random() < odds), [a, float(b), float(c), 1.0 - c if opposite else 0.0, 3.0, d]))
    frame = spark.createDataFrame(rows, "id long, label double, x array<double>").select(
        "id", "label", array_to_vector("x").alias("features"))
    return store.stage(frame.repartition(1), "rows")


def _nodes(spark, model, name):
    path = churn_model.save_model(model, store.scratch_path(spark, name))
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()


@pytest.mark.parametrize("n, trees, partition_bytes", [
    (300, 25, 4 << 20), (2_000, 6, 30_000), (12_000, 4, 4 << 20), (30_000, 3, 300_000),
])
def test_one_task_gives_the_trees_of_spark(spark, monkeypatch, n, trees, partition_bytes):
    """Few rows, rows in several partitions, and so many that bins come from a sample (drawn in two ways)."""
    monkeypatch.setattr(churn_model, "PARTITION_BYTES", partition_bytes)
    train = _rows(spark, n, opposite=partition_bytes == 4 << 20)
    mine = churn_model.train_boosted(train, trees=trees)
    with churn_model._balanced(train, lambda neg, pos: (1.0, neg / pos)) as rows:
        assert (rows.rdd.getNumPartitions() > 1) == (partition_bytes < 4 << 20)
        theirs = GBTClassifier(
            weightCol="weight", maxIter=trees, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
            featureSubsetStrategy="0.8", seed=42,
        ).fit(rows)
    assert list(mine.treeWeights) == list(theirs.treeWeights) and mine.numFeatures == theirs.numFeatures
    got, want = _nodes(spark, mine, "mine"), _nodes(spark, theirs, "theirs")
    if partition_bytes == 4 << 20:
        assert got == want
    else:  # Spark adds up its partitions in the order they come in, so last bits differ from run to run
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert (a["split"], a["rawCount"], a["leftChild"]) == (b["split"], b["rawCount"], b["leftChild"])
            assert a["prediction"] == pytest.approx(b["prediction"], rel=1e-9, abs=1e-9)
    score = lambda model: [r[0] for r in churn_model.score(model, train).orderBy("id").select("score").collect()]
    assert score(mine) == pytest.approx(score(theirs), abs=1e-9)
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-6)


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark):
    """As jobs, passes took minutes for any number of rows."""
    train = _rows(spark, 100)
    context = spark.sparkContext

    def jobs(trees):
        group = f"fit-{trees}"
        context.setJobGroup(group, group)
        try:
            churn_model.train_boosted(train, trees=trees)
            return len(context.statusTracker().getJobIdsForGroup(group))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(30) == jobs(3) < 20


def test_larger_inputs_are_passed_over_by_the_cluster(spark, monkeypatch):
    train = _rows(spark, 200)
    small = _nodes(spark, churn_model.train_boosted(train, trees=3), "small")
    monkeypatch.setattr(churn_model, "ONE_TASK_BYTES", 100)
    monkeypatch.setattr(boosting, "fit", lambda *a: pytest.fail("in one task"))
    assert _nodes(spark, churn_model.train_boosted(train, trees=3), "large") == small


def test_rows_that_spark_refuses_are_refused(spark):
    train = _rows(spark, 20)
    odd = [
        train.withColumn("features", array_to_vector(F.array(*[F.lit(x) for x in (1.0, float("nan"))]))),
        train.withColumn("label", F.when(F.col("id") > 0, F.col("label"))),
        train.withColumn("label", F.when(F.col("id") > 0, F.col("label")).otherwise(2.0)),
    ]
    for rows in odd:
        with pytest.raises(Exception, match="training needs"):
            churn_model.train_boosted(rows, trees=2)


def test_random_numbers_one_by_one_and_all_at_once():
    for seed in (0, 42, -5, 1 << 40):
        one = boosting.XorShift(seed)
        assert boosting.doubles(seed, 1000).tolist() == [one.double() for _ in range(1000)]


def test_exponential():
    x = np.concatenate([np.linspace(-40, 40, 4001), [0.0, 699.0, 710.0, -800.0]])
    with np.errstate(over="ignore"):
        assert boosting.exponential(x) == pytest.approx(np.exp(x), rel=5e-16)
