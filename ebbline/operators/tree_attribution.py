"""Shapley contributions of a boosted-tree score, computed where the rows are.

A tree's expected output with some features unknown follows both branches of
an unknown split in proportion to the training rows that went each way. Along
one leaf's path this makes a product of terms, one per feature, so a row's
contribution depends only on which of the path's conditions it meets. The
contributions of all such patterns of a leaf are worked out once, before the rows
are read; a row looks them up under its pattern's number. Only for leaves with
many features are they worked out for the patterns that occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Contributions are on the log-odds scale, which is twice the sum of the trees.
LOG_ODDS = 2.0

#: Features of a leaf up to which the contributions of all its patterns are tabulated: bits of a byte.
TABLE_FEATURES = 8


@dataclass
class LeafPath:
    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray  # training rows that meet the condition on each feature


def leaf_paths(spark: SparkSession, path: str, tree_weights: list[float]) -> list[LeafPath]:
    """The leaves of a saved model. Their number is set by trees and depth."""
    table = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    trees: dict[int, dict] = {}
    for row in table.collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    leaves = []

    def walk(nodes: dict, node, weight: float, conditions: dict) -> None:
        if node["leftChild"] < 0:
            used = sorted(conditions)
            low, high, share = (
                np.array([conditions[f][i] for f in used], dtype=float) for i in range(3)
            )
            leaves.append(LeafPath(weight * node["prediction"], used, low, high, share))
            return
        if node["split"]["numCategories"] > 0:
            raise ValueError("only numeric splits are supported")
        feature = node["split"]["featureIndex"]
        threshold = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (nodes[node["leftChild"]], (low, min(high, threshold))),
            (nodes[node["rightChild"]], (max(low, threshold), high)),
        ):
            went = child["impurityStats"][0] / node["impurityStats"][0]
            walk(nodes, child, weight, {**conditions, feature: (*bounds, share * went)})

    for tree, nodes in sorted(trees.items()):
        walk(nodes, nodes[0], LOG_ODDS * tree_weights[tree], {})
    return leaves


def _contributions(leaf: LeafPath, met: np.ndarray) -> np.ndarray:
    """Contributions of a leaf's features for rows of met conditions (patterns x features).

    Sets of known features are summed by size: coefficient s of a product of one linear
    term per other feature.
    """
    k = len(leaf.features)
    weights = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])
    out = np.zeros(met.shape)
    for j in range(k):
        by_size = np.zeros((len(met), k))
        by_size[:, 0] = 1.0
        for i in range(k):
            if i != j:
                shifted = np.pad(by_size[:, :-1], ((0, 0), (1, 0)))
                by_size = by_size * leaf.share[i] + shifted * met[:, i: i + 1]
        out[:, j] = leaf.value * (met[:, j] - leaf.share[j]) * (by_size @ weights)
    return out


def _table(leaf: LeafPath) -> np.ndarray | None:
    """Contributions (features x patterns) by number of the pattern: bit j is condition j."""
    k = len(leaf.features)
    if k > TABLE_FEATURES:
        return None
    bits = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    return np.ascontiguousarray(_contributions(leaf, bits.astype(float)).T)


def tree_contributions(
    model: GBTClassificationModel, path: str, features: DataFrame, id_column: str = "customerID"
) -> DataFrame:
    """`contributions` per feature, `base` and `margin` (log odds) of every row.

    `path` is where the model was saved. Base plus contributions is margin. The rows are
    dealt evenly over the cores: they take far longer than their bytes suggest, and a
    small file would be one task.
    """
    leaves = leaf_paths(features.sparkSession, path, list(model.treeWeights))
    base = float(sum(leaf.value * leaf.share.prod() for leaf in leaves))
    # Leaves share conditions, and each is tested once in a batch.
    conditions: dict[tuple, int] = {}
    numbers = [
        [conditions.setdefault(c, len(conditions)) for c in zip(leaf.features, leaf.low, leaf.high)]
        for leaf in leaves
    ]
    tables = [_table(leaf) for leaf in leaves]

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.ascontiguousarray(np.stack(batch["features"].to_numpy()).T)
            met = np.empty((len(conditions), len(batch)), dtype=np.uint8)
            for (feature, low, high), number in conditions.items():
                met[number] = (x[feature] > low) & (x[feature] <= high)
            phi, margin = np.zeros_like(x), np.zeros(len(batch))
            for leaf, used, table in zip(leaves, numbers, tables):
                if table is None:
                    patterns, place = np.unique(met[used].T, axis=0, return_inverse=True)
                    phi[leaf.features] += _contributions(leaf, patterns.astype(float))[place.ravel()].T
                    margin += leaf.value * met[used].all(axis=0)
                    continue
                bits = np.zeros(len(batch), dtype=np.uint8)
                for j, number in enumerate(used):
                    bits |= met[number] << j
                pattern = bits.astype(np.intp)
                for feature, contribution in zip(leaf.features, table):
                    phi[feature] += contribution[pattern]
                margin += leaf.value * (bits == (1 << len(used)) - 1)
            yield pd.DataFrame({
                id_column: batch[id_column], "contributions": list(phi.T), "base": base, "margin": margin,
            })

    kind = features.schema[id_column].dataType.simpleString()
    rows = features.select(id_column, vector_to_array("features").alias("features"))
    return rows.repartition(features.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        attribute, f"{id_column} {kind}, contributions array<double>, base double, margin double"
    )


def contribution_ranking(contributions: DataFrame, names: list[str]) -> DataFrame:
    """Average size of each feature's contribution, largest first."""
    means = contributions.agg(*[
        F.avg(F.abs(F.col("contributions")[i])).alias(f"_{i}") for i in range(len(names))
    ])
    entries = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(f"_{i}").alias("mean_abs"))
        for i, name in enumerate(names)
    ])
    return means.select(F.inline(entries)).orderBy(F.desc("mean_abs"), "feature")


def explain_top_customer(
    contributions: DataFrame, names: list[str], id_column: str = "customerID"
) -> DataFrame:
    """Contributions of the customer with the highest margin, one row each."""
    top = contributions.orderBy(F.desc("margin"), id_column).limit(1)
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.arrays_zip(labels.alias("feature"), F.col("contributions").alias("contribution"))
    return top.select(id_column, "base", "margin", F.inline(pairs)).toDF(
        id_column, "base", "margin", "feature", "contribution"
    )
