"""Connected components of a graph given as edges, by alternating star steps.

Large-star links every larger neighbour of a node to its smallest neighbour, small-star
does the same for the smaller ones; after a logarithmic number of rounds each node
hangs on the smallest node of its component. Only a minimum per node is aggregated, so
a hub with a third of all edges needs no list. Rounds are cut with checkpoint().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.functions.staging import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple[int, int | None]:
    """Count and order-free hash of an edge set, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges (a, b)`; component: its smallest node.

    Self-loops and repeated edges change nothing; no edges give no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    current = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a != b").distinct().checkpoint()
    before = _digest(current)
    while True:
        current = _small_star(_large_star(current)).checkpoint()
        after = _digest(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
