"""Merkle manifest of a dataset, with inclusion proofs expanded from octopus multiproofs.

Every row is a leaf. The leaves of a group, in the order of their key, are hashed in runs
of `fan` consecutive nodes until one remains; the groups' remaining nodes, in the order of
the groups, are hashed likewise into the root. A node has coordinates (tree, level, place):
the tree is the group's number, or -1 for the tree over the groups.

* Building: chunks of fan**3 consecutive nodes of a tree are hashed three levels up with SQL
  functions; the chunks' nodes are the next round's leaves, so a hot group is as many
  chunks as it needs and the rounds are the logarithm of its size to base fan**3.
* Proving: leaves are cut into partitions of fan**3 in global order. A partition needs, for
  the proofs of all its leaves together, only the siblings at its borders that its own
  leaves do not determine; the minimal union of these coordinates is computed from the
  ranges that the partition holds, fetched in one join, and the interior nodes that its
  leaves share are derived once, in the task. Each leaf's own proof is then read off.
  Root and group root of a partition are derived from its own leaves, so a manifest
  that does not fit its leaves cannot pass unseen.

Texts are read once; only digests are moved. A task holds one partition or one chunk.

Defined results: a null field counts as `-`; null groups come first, null keys first within
a group. Rows of equal group and key are ordered by leaf; equal leaves are interchangeable.
A group of one leaf has that leaf as its root, a single group's root is the root. An empty
table gives an empty result. Input columns of other names, or like result columns, are not
carried and clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions.lookups import attach_lookup
from ebbline.functions.ordering import global_row_number
from ebbline.llm.common import stage

FAN = 16
TOP = -1  # the tree over the groups
RANGES = "array<struct<tree:bigint,low:bigint,high:bigint,n:bigint>>"
PLACES = pa.list_(pa.struct([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64())]))


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def depth(n: int, fan: int = FAN) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


# ── building ─────────────────────────────────────────────────────────────────

def _level_up(nodes: Column, fan: int) -> Column:
    """Digests of runs of `fan` nodes."""
    runs = F.ceil(F.size(nodes) / fan).cast("int")
    return F.transform(
        F.sequence(F.lit(0), runs - 1),
        lambda i: F.sha2(F.array_join(F.slice(nodes, i * fan + 1, fan), "").cast("binary"), 256))


def build_nodes(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """`tree, level, place, node` above the leaves `tree, place, node, n` (n leaves in the tree)."""
    steps, current, base, built = 3, leaves, 0, []
    chunk = fan**steps
    while True:
        held = current.where("n > 1").groupBy(
            "tree", "n", F.floor(F.col("place") / chunk).alias("chunk")
        ).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("members"))
        held = held.select("tree", "n", "chunk", F.col("members.node").alias("level0"))
        size = F.col("n")
        for step in range(1, steps + 1):
            below = F.col(f"level{step - 1}")
            held = held.withColumn(
                f"level{step}", F.when(size > 1, _level_up(below, fan)).otherwise(F.array().cast("array<string>")))
            size = F.ceil(size / fan)
        levels = F.array(*[
            F.struct(
                F.lit(base + step).alias("level"), F.lit(fan ** (steps - step)).cast("long").alias("width"),
                F.col(f"level{step}").alias("nodes"))
            for step in range(1, steps + 1)])
        nodes = held.select("tree", "n", "chunk", F.explode(levels).alias("l")).select(
            "tree", "n", "chunk", "l.level", "l.width", F.posexplode("l.nodes").alias("at", "node"),
        ).select("tree", "n", "level", (F.col("chunk") * F.col("width") + F.col("at")).alias("place"), "node")
        nodes = stage(nodes, "merkle-nodes")
        built.append(nodes)
        base += steps
        above = F.ceil(F.col("n") / chunk)
        current = nodes.where((F.col("level") == base) & (above > 1)).select("tree", "place", "node", above.alias("n"))
        if current.isEmpty():
            break
    return _union(built).select("tree", "level", "place", "node")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _roots(sizes: DataFrame, leaves: DataFrame, nodes: DataFrame, fan: int) -> DataFrame:
    """`tree, n, node` with the last node of each tree of `sizes (tree, n)`."""
    last = F.ceil(F.log(F.col("n").cast("double")) / F.log(F.lit(float(fan)))).cast("int")
    # The logarithm may be off by one where n is a power of the fan.
    power = lambda k: F.pow(F.lit(float(fan)), k)
    last = F.when(power(last - 1) >= F.col("n"), last - 1).when(power(last) < F.col("n"), last + 1).otherwise(last)
    wanted = sizes.withColumn("level", F.when(F.col("n") == 1, 0).otherwise(last))
    everything = nodes.where("place = 0").unionByName(
        leaves.where("place = 0").select("tree", F.lit(0).alias("level"), "place", "node"))
    return wanted.join(everything, ["tree", "level"]).select("tree", "n", "node")


# ── octopus multiproofs ──────────────────────────────────────────────────────

def missing_nodes(ranges: Sequence[tuple[int, int, int, int]], trees: int, fan: int = FAN) -> list[tuple[int, int, int]]:
    """Coordinates (tree, level, place) that proofs of whole ranges need from elsewhere.

    `ranges` has (tree, first place, last place, leaves of the tree) for consecutive trees.
    A node that the ranges themselves determine is not among them.
    """
    out = []
    top = (TOP, ranges[0][0], ranges[-1][0], trees)
    for tree, low, high, n in [*ranges, top]:
        level = 0
        while n > 1:
            start, stop = low // fan * fan, min(n, (high // fan + 1) * fan)
            out += [(tree, level, i) for i in (*range(start, low), *range(high + 1, stop))]
            low, high, n, level = low // fan, high // fan, -(-n // fan), level + 1
    return out


class Expansion:
    """Interior nodes of one tree over a range of its leaves, and the proofs below them."""

    def __init__(self, tree: int, low: int, leaves: Sequence[str], n: int, fetched: dict, fan: int = FAN) -> None:
        self.fan, self.rows = fan, []
        row, level = list(leaves), 0
        while n > 1:
            start, last = low // fan * fan, low + len(row) - 1
            stop = min(n, (last // fan + 1) * fan)
            before = [fetched[tree, level, i] for i in range(start, low)]
            after = [fetched[tree, level, i] for i in range(last + 1, stop)]
            row = [*before, *row, *after]
            self.rows.append((start, row))
            row = [digest(row[i:i + fan]) for i in range(0, len(row), fan)]
            low, n, level = start // fan, -(-n // fan), level + 1
        self.root = row[0]
        self.above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def proof(self, place: int, level: int = 0) -> list[tuple[str, str]]:
        """Siblings left and right of the path, level by level; shared parts are made once."""
        if level == len(self.rows):
            return []
        start, row = self.rows[level]
        first = (place // self.fan) * self.fan - start
        at = place - start
        run = row[first:first + self.fan]
        key = (level + 1, place // self.fan)
        if key not in self.above:
            self.above[key] = self.proof(place // self.fan, level + 1)
        return [("".join(run[:at - first]), "".join(run[at - first + 1:])), *self.above[key]]


def fold(leaf: str, proof: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for left, right in proof:
        leaf = digest((left, leaf, right))
    return leaf


# ── the operator ─────────────────────────────────────────────────────────────

def merkle_manifest(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "source",
    claimed: dict[str, Column] | None = None, fan: int = FAN,
) -> DataFrame:
    """Leaf, roots and proof of every row.

    Columns: the key, `leaf`, `subroot` (of the row's group), `root`, `siblings` (digests of
    the proof, joined in order), `claimed_leaf` (with the expressions of `claimed` in the
    place of their fields) and `folded_root`, which a claimed leaf and the proof give.
    """
    claims = claimed or {}
    own = leaf_digest([F.col(f) for f in fields])
    told = leaf_digest([claims.get(f, F.col(f)) for f in fields]) if claims else own
    # Order of groups: null first, then by bytes; the prefix keeps null apart from empty.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    digests = stage(docs.select(
        F.col(key).alias("_key"), named.alias("_group"), own.alias("node"), told.alias("told")), "merkle-leaves")
    # The number tells equal rows apart, so that very many copies are spread.
    ordered = stage(global_row_number(
        digests.withColumn("_row", F.monotonically_increasing_id()),
        [F.col("_group"), F.col("_key").asc_nulls_first(), F.col("node"), F.col("_row")]).drop("_row"), "merkle-order")
    groups = ordered.groupBy("_group").agg(
        F.min("row_number").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage(global_row_number(groups, [F.col("first")], "number"), "merkle-groups")
    trees = groups.count()
    if not trees:
        empty = "leaf string, subroot string, root string, siblings string, claimed_leaf string, folded_root string"
        return docs.sparkSession.createDataFrame([], empty).select(
            F.lit(None).cast(docs.schema[key].dataType).alias(key), "*")
    leaves = attach_lookup(ordered, groups, ["_group"], "inner").select(
        "_key", "node", "told", "n", (F.col("number") - 1).alias("tree"),
        (F.col("row_number") - 1).alias("global"), (F.col("row_number") - F.col("first")).alias("place"))
    leaves = stage(leaves, "merkle-placed")
    nodes = build_nodes(leaves.select("tree", "place", "node", "n"), fan)
    sizes = groups.select((F.col("number") - 1).alias("tree"), "n")
    subroots = stage(_roots(sizes, leaves, nodes, fan).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "node",
        F.lit(trees).cast("long").alias("n")), "merkle-subroots")
    top = build_nodes(subroots, fan)
    size = fan**3
    parted = leaves.withColumn("part", F.floor(F.col("global") / size))
    ranges = parted.groupBy("part", "tree", "n").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    held = ranges.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("tree", "low", "high", "n"))).cast(RANGES).alias("held"))

    @F.arrow_udf("array<struct<tree:bigint,level:int,place:bigint>>")
    def wanted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for parts in batches:
            found = [
                [dict(zip(("tree", "level", "place"), c)) for c in
                 missing_nodes([(r["tree"], r["low"], r["high"], r["n"]) for r in part], trees, fan)]
                for part in parts.to_pylist()]
            yield pa.array(found, type=PLACES)

    needed = held.select("part", F.explode(wanted("held")).alias("c")).select("part", "c.*")
    # Leaves are fetched only from runs that a border of partitions cuts.
    run = F.col("global") - F.col("place") % fan
    border = leaves.where(F.floor(run / size) != F.floor((run + fan - 1) / size)).select(
        "tree", F.lit(0).alias("level"), "place", "node")
    store = _union([border, nodes, top, subroots.select("tree", F.lit(0).alias("level"), "place", "node")])
    fetched = stage(
        needed.join(store, ["tree", "level", "place"]).select("part", "tree", "level", "place", "node"),
        "merkle-fetched")

    schema = docs.select(
        F.col(key).alias("_key"), *[F.lit("").alias(c) for c in
        ("leaf", "subroot", "root", "siblings", "claimed_leaf", "folded_root")]).schema

    def expand(own: pa.Table, others: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        known = dict(zip(
            zip(*[others.column(c).to_pylist() for c in ("tree", "level", "place")]),
            others.column("node").to_pylist()))
        own = own.sort_by("global")
        tree, place, node, told, n = (
            own.column(c).to_pylist() for c in ("tree", "place", "node", "told", "n"))
        # The first row of each tree: rows of a tree are consecutive.
        starts = [i for i in range(len(tree)) if i == 0 or tree[i] != tree[i - 1]]
        lower = [
            Expansion(tree[a], place[a], node[a:b], n[a], known, fan)
            for a, b in zip(starts, [*starts[1:], len(tree)])]
        upper = Expansion(TOP, tree[0], [e.root for e in lower], trees, known, fan)
        subroot, siblings, folded = [], [], []
        for a, b, below in zip(starts, [*starts[1:], len(tree)], lower):
            rest = upper.proof(tree[a])
            for i in range(a, b):
                path = [*below.proof(place[i]), *rest]
                subroot.append(below.root)
                siblings.append("".join(s for pair in path for s in pair))
                folded.append(fold(told[i], path))
        columns = [own.column("_key"), node, subroot, [upper.root] * len(node), siblings, told, folded]
        return pa.table(
            [c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, type=f.type)
             for c, f in zip(columns, to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    proved = parted.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, schema)
    return proved.withColumnRenamed("_key", key)
