"""Tree contributions against Shapley values summed over all feature sets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ebbline.operators import churn_model, tree_attribution
from ebbline.sources import store

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)) | (x[:, 2] > 1)
    rows = [(str(i), *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, label double")
    data = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).persist()
    model = churn_model.train_boosted(data.select("customerID", "features", "label"), trees=4, depth=3)
    path = churn_model.save_model(model, store.scratch_path(spark, "trees"))
    return model, path, data, x


def expectation(nodes, node, row, known):
    if node["leftChild"] < 0:
        return node["prediction"]
    left, right = nodes[node["leftChild"]], nodes[node["rightChild"]]
    feature = node["split"]["featureIndex"]
    if feature in known:
        goes_left = row[feature] <= node["split"]["leftCategoriesOrThreshold"][0]
        return expectation(nodes, left if goes_left else right, row, known)
    total = node["impurityStats"][0]
    return (
        left["impurityStats"][0] * expectation(nodes, left, row, known)
        + right["impurityStats"][0] * expectation(nodes, right, row, known)
    ) / total


def test_equals_the_sum_over_feature_sets(spark, fitted):
    model, path, data, x = fitted
    table = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    trees = [{r["id"]: r for r in table if r["treeID"] == t} for t in range(model.getNumTrees)]

    def value(row, known):
        return 2 * sum(
            w * expectation(t, t[0], row, known) for w, t in zip(model.treeWeights, trees)
        )

    got = {
        int(r["customerID"]): r
        for r in tree_attribution.tree_contributions(model, path, data).collect()
    }
    for i in range(0, 400, 40):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            phi = sum(
                factorial(s) * factorial(2 - s) / factorial(3)
                * (value(x[i], {*known, j}) - value(x[i], set(known)))
                for s in range(3) for known in combinations(others, s)
            )
            assert got[i]["contributions"][j] == pytest.approx(phi, abs=1e-9)
        assert got[i]["base"] == pytest.approx(value(x[i], set()))


def test_base_and_contributions_give_the_probability(fitted):
    model, path, data, _ = fitted
    parts = tree_attribution.tree_contributions(GBTClassificationModel.load(path), path, data)
    total = F.aggregate("contributions", F.col("base"), lambda a, b: a + b)
    gap = parts.join(churn_model.score(model, data), "customerID").select(
        F.max(F.abs(total - F.col("margin"))).alias("sum"),
        F.max(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("score"))).alias("score"),
    ).first()
    assert gap["sum"] < 1e-9 and gap["score"] < 1e-9


def test_ranking_and_top_customer(fitted):
    model, path, data, _ = fitted
    parts = tree_attribution.tree_contributions(model, path, data).persist()
    ranking = tree_attribution.contribution_ranking(parts, NAMES).collect()
    assert {r["feature"] for r in ranking} == set(NAMES)
    assert ranking[0]["mean_abs"] >= ranking[-1]["mean_abs"]
    top = tree_attribution.explain_top_customer(parts, NAMES).collect()
    assert top[0]["margin"] == parts.agg(F.max("margin")).first()[0]
    assert top[0]["base"] + sum(r["contribution"] for r in top) == pytest.approx(top[0]["margin"])


def test_patterns_are_worked_out_before_the_rows(spark, fitted, monkeypatch):
    """A task looks contributions up; the rows of one small file are dealt over the cores."""
    model, path, data, _ = fitted
    shapes, whole = [], tree_attribution._contributions

    def counted(leaf, met):
        shapes.append((met.shape[0], len(leaf.features)))
        return whole(leaf, met)

    monkeypatch.setattr(tree_attribution, "_contributions", counted)
    parts = tree_attribution.tree_contributions(model, path, data.coalesce(1))
    leaves = tree_attribution.leaf_paths(spark, path, list(model.treeWeights))
    assert shapes == [(2 ** len(leaf.features), len(leaf.features)) for leaf in leaves]
    assert parts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_leaves_too_wide_for_a_table(fitted, monkeypatch):
    model, path, data, _ = fitted
    rows = lambda: {r["customerID"]: r for r in tree_attribution.tree_contributions(model, path, data).collect()}
    tabulated = rows()
    monkeypatch.setattr(tree_attribution, "TABLE_FEATURES", 1)
    wide = rows()
    assert wide.keys() == tabulated.keys()
    for key, row in wide.items():
        assert row["contributions"] == pytest.approx(tabulated[key]["contributions"], abs=1e-12)
        assert row["margin"] == pytest.approx(tabulated[key]["margin"], abs=1e-12)
