"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal directions of a group are one node. Nodes are gathered into balls: inside each home
   cell (`cells.overlapping_cells`) a leader takes the nodes within half the threshold
   angle, and leaders are gathered again while that makes them markedly fewer. Any two
   nodes of a ball are linked, by the triangle inequality, so large groups of near copies
   are counted, never spread out into pairs.
2. The graph is over leaders. Each overlapping cell is a shard: candidates are the nearest
   members and some random ones for long ways, robust pruning (`ALPHA`) keeps a short
   diverse list, reverse edges are added and pruned again, and what the medoid cannot reach
   is tied to its nearest reached member. A leader's lists of all its shards are united.
3. Every leader is searched for in each of its shards: greedy from the shard's medoid and
   from its own node, over the united lists, with a beam that doubles while it is full of
   hits. The range is the threshold angle plus both radii.
4. The pairs of leaders found are verified: where the radii leave no doubt all members are
   linked; otherwise the members are compared in double precision, block by block.
5. An audit compares leaders picked by hash with all leaders by brute force. If the search
   missed too many, it is repeated with longer lists and a wider beam; if that does not
   reach the target, it raises an error rather than return an incomplete result.

Tasks hold one cell (`cell_rows` vectors) or two blocks of members; hot groups are split into
as many cells as they need.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries, and
rows without label, link with nothing. Vectors of different length are never linked.
Copies count as other vectors, repeated rows and rows without id too; a component is the
smallest id reachable, null only if no row of it has an id. An empty table gives an empty
result. Input columns of other names clash with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.cells import matrix, overlapping_cells, per_cell
from ebbline.llm.common import stage
from ebbline.llm.components import connected_components

ALPHA = 1.2
SURE = 1e-6      # radians that rounding may cost an angle
BLOCK = 256
MEMBERS = 2048   # expected members of a block that are compared at once
AUDIT = 64       # leaders of each kind that are compared with all others
TARGET = 0.98


@dataclass(frozen=True)
class Settings:
    cell_rows: int = 4096
    degree: int = 24
    candidates: int = 48
    random: int = 12
    beam: int = 16
    overlap: int = 2  # cells of a leader in each round of splits

    def wider(self) -> Settings:
        return Settings(
            self.cell_rows, 2 * self.degree, 2 * self.candidates, 2 * self.random, 4 * self.beam, 2 * self.overlap)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _directions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        values = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out: list = [None] * len(column)
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            block = values[starts[rows][:, None] + np.arange(size)]
            largest = np.abs(block).max(axis=1)
            sound = np.isfinite(block).all(axis=1) & (largest > 0)
            block = block[sound] / largest[sound, None]
            block /= np.sqrt((block * block).sum(axis=1))[:, None]
            for row, direction in zip(rows[sound], block):
                out[row] = direction
        yield pa.array(out, pa.list_(pa.float64()))


def unit(vector: Column) -> Column:
    """The direction of a sound vector, null for any other; nulls inside count as not finite."""
    return _directions(F.transform(vector.cast("array<double>"), lambda c: F.coalesce(c, F.lit(math.nan))))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


# ── balls ────────────────────────────────────────────────────────────────────

def gather_ball(u: np.ndarray, radius: np.ndarray, most: float) -> np.ndarray:
    """For each row the place of its leader: rows in order lead what no earlier row has."""
    m = len(u)
    allowed = np.cos(np.maximum(most - radius, 0.0))
    fits = radius <= most
    near = np.zeros((m, m), dtype=bool)
    for a in range(0, m, BLOCK):
        near[a:a + BLOCK] = (u[a:a + BLOCK] @ u.T >= allowed) & fits
    leader = np.full(m, -1)
    crowded = near.sum(axis=1) > 1
    for i in range(m):
        if leader[i] < 0:
            if crowded[i]:
                leader[near[i] & (leader < 0)] = i
            leader[i] = i
    return leader


def _gather(most: float):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, r, u = table.column("id").to_numpy(), table.column("r").to_numpy(), matrix(table.column("v"))
        own = gather_ball(u, r, most)
        gap = np.where(own == np.arange(len(own)), 0.0, _angles((u * u[own]).sum(axis=1)))
        return pa.table({"id": ids, "leader": ids[own], "reach": gap + r})

    return work


@dataclass(frozen=True)
class Balls:
    """`node, leader` of all nodes; `id, group, r, v` of the leaders; their cells."""

    members: DataFrame
    leaders: DataFrame
    cells: DataFrame


def gather_balls(nodes: DataFrame, theta: float, cell_rows: int) -> Balls:
    """Balls of nodes `id, group, v` whose members are all within theta of each other."""
    most = (theta - SURE) / 2 - SURE
    current = nodes.select("id", "group", F.lit(0.0).alias("r"), "v")
    members, count = None, nodes.count()
    while True:
        cells = stage(overlapping_cells(current, cell_rows), "ball-cells")
        taken = stage(per_cell(cells.where("home"), _gather(most), "id bigint, leader bigint, reach double"), "balls")
        step = taken.select(F.col("id").alias("was"), F.col("leader").alias("now"))
        members = step.select(F.col("was").alias("node"), F.col("now").alias("leader")) if members is None else (
            members.join(step, F.col("leader") == F.col("was")).select("node", F.col("now").alias("leader")))
        members = stage(members, "ball-members")
        radii = taken.groupBy("leader").agg(F.max("reach").alias("r"))
        current = stage(
            current.drop("r").join(radii, F.col("id") == F.col("leader")).select("id", "group", "r", "v"), "leaders")
        before, count = count, current.count()
        if count >= 0.9 * before:
            kept = current.select("id", F.col("r").alias("radius"))
            return Balls(members, current, stage(
                cells.join(kept, "id").select("id", "cell", "home", F.col("radius").alias("r"), "v"), "leader-cells"))


# ── graph ────────────────────────────────────────────────────────────────────

def robust_prune(u: np.ndarray, rows: np.ndarray, lists: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (-1: none), nearest first, those that no kept one covers."""
    out = np.full((len(rows), degree), -1)
    for a in range(0, len(rows), BLOCK):
        own, some = u[rows[a:a + BLOCK]], lists[a:a + BLOCK]
        vectors = u[some]
        cosine = np.where(some >= 0, np.einsum("id,ijd->ij", own, vectors), -2.0)
        order = np.argsort(-cosine, axis=1, kind="stable")
        some = np.take_along_axis(some, order, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(cosine, order, axis=1), 0.0))
        vectors = np.take_along_axis(vectors, order[:, :, None], axis=1)
        between = np.sqrt(np.maximum(2 - 2 * vectors @ vectors.transpose(0, 2, 1), 0.0))
        alive, lines = some >= 0, np.arange(len(some))
        for step in range(degree):
            pick = alive.argmax(axis=1)
            there = alive[lines, pick]
            if not there.any():
                break
            out[a + lines[there], step] = some[lines[there], pick[there]]
            alive &= ~((ALPHA * between[lines, pick] <= far) & there[:, None])
            alive[lines, pick] = False
    return out


def medoid(u: np.ndarray) -> int:
    return int(np.argmax(u @ u.mean(axis=0)))


def _reached(lists: np.ndarray, start: int) -> np.ndarray:
    seen = np.zeros(len(lists), dtype=bool)
    front = np.array([start])
    while len(front):
        seen[front] = True
        after = np.unique(lists[front])
        after = after[after >= 0]
        front = after[~seen[after]]
    return seen


def build_graph(u: np.ndarray, settings: Settings, seed: int = 0) -> list[list[int]]:
    """Robust-pruned lists of a shard, all reachable from its medoid."""
    m = len(u)
    rng = np.random.default_rng(seed)
    near = min(settings.candidates, m - 1)
    chosen = np.full((m, near + settings.random), -1)
    for a in range(0, m, BLOCK):
        cosine = u[a:a + BLOCK] @ u.T
        lines = np.arange(len(cosine))
        cosine[lines, a + lines] = -3.0
        if near:
            chosen[a:a + BLOCK, :near] = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
    if m > near + 1:
        some = rng.integers(0, m, (m, settings.random))
        some[some == np.arange(m)[:, None]] = -1
        some[(some[:, :, None] == chosen[:, None, :near]).any(axis=2)] = -1
        chosen[:, near:] = some
    lists = robust_prune(u, np.arange(m), chosen, settings.degree)
    # Reverse edges; rows that get too many are pruned again.
    source, place = np.nonzero(lists >= 0)
    target = lists[source, place]
    pairs = np.unique(np.concatenate([
        np.stack([source, target], axis=1), np.stack([target, source], axis=1)]), axis=0) if len(source) else np.zeros((0, 2), int)
    counts = np.bincount(pairs[:, 0], minlength=m)
    width = 2 * settings.degree
    joined = np.full((m, max(int(counts.max(initial=0)), 1)), -1)
    starts = np.concatenate([[0], np.cumsum(counts)])
    joined[pairs[:, 0], np.arange(len(pairs)) - starts[pairs[:, 0]]] = pairs[:, 1]
    full = np.flatnonzero(counts > width)
    result = [row[row >= 0].tolist() for row in joined]
    for a in range(0, len(full), BLOCK):
        rows = full[a:a + BLOCK]
        kept = robust_prune(u, rows, _nearest_first(u, rows, joined[rows], 4 * width), width)
        for i, row in zip(rows, kept):
            result[i] = row[row >= 0].tolist()
    padded = np.full((m, max(map(len, result), default=1) or 1), -1)
    for i, row in enumerate(result):
        padded[i, :len(row)] = row
    seen = _reached(padded, medoid(u))
    lost = np.flatnonzero(~seen)
    inside = np.flatnonzero(seen)
    for a in range(0, len(lost), BLOCK):
        tie = inside[np.argmax(u[lost[a:a + BLOCK]] @ u[inside].T, axis=1)]
        for i, j in zip(tie, lost[a:a + BLOCK]):
            result[int(i)].append(int(j))
    return result


def _nearest_first(u: np.ndarray, rows: np.ndarray, lists: np.ndarray, most: int) -> np.ndarray:
    """The nearest candidates of each row, so many that pruning has a choice; a hub's list
    is as long as its shard."""
    if lists.shape[1] <= most:
        return lists
    out = np.full((len(rows), most), -1)
    for n, (row, some) in enumerate(zip(rows, lists)):
        some = some[some >= 0]
        best = some[np.argsort(-(u[some] @ u[row]), kind="stable")][:most]
        out[n, :len(best)] = best
    return out


# ── search ───────────────────────────────────────────────────────────────────

def _beam(u: np.ndarray, lists: np.ndarray, queries: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and cosines of the `width` best that greedy search meets, for several queries."""
    count = len(queries)
    nodes = np.full((count, width), -1)
    cosine = np.full((count, width), -np.inf, dtype=u.dtype)
    open_ = np.zeros((count, width), dtype=bool)
    met = np.zeros((count, len(u)), dtype=bool)
    own = u[queries]
    nodes[:, 0], cosine[:, 0], open_[:, 0] = queries, 1.0, True
    other = queries != start
    nodes[other, 1], cosine[other, 1], open_[other, 1] = start, own[other] @ u[start], True
    met[np.arange(count), queries] = True
    met[:, start] = True
    active = np.arange(count)
    while len(active):
        ahead = np.where(open_[active], cosine[active], -np.inf)
        pick = ahead.argmax(axis=1)
        some = ahead[np.arange(len(active)), pick] > -np.inf
        active, pick = active[some], pick[some]
        if not len(active):
            break
        open_[active, pick] = False
        after = lists[nodes[active, pick]]
        fresh = (after >= 0) & ~met[active[:, None], after]
        line, column = np.nonzero(fresh)
        reached = after[line, column]
        met[active[line], reached] = True
        found = np.full(after.shape, -np.inf, dtype=u.dtype)
        found[line, column] = np.einsum("ij,ij->i", u[reached], own[active[line]])
        every = np.hstack([cosine[active], found])
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        cosine[active] = np.take_along_axis(every, best, axis=1)
        nodes[active] = np.take_along_axis(np.hstack([nodes[active], after]), best, axis=1)
        open_[active] = np.take_along_axis(np.hstack([open_[active], fresh]), best, axis=1)
    return nodes, cosine


def range_search(
    u: np.ndarray, lists: np.ndarray, radius: np.ndarray, theta: float, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) whose angle is at most theta and both radii, as far as found.

    A beam that is half full of hits is doubled and run again, up to the whole shard.
    """
    rough = u.astype(np.float32)
    start = medoid(u)
    reach = np.cos(np.minimum(theta + radius + radius.max(initial=0.0) + SURE, math.pi)) - 1e-5
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    todo, width = np.arange(len(u)), max(2, width)
    while len(todo):
        width = min(width, max(2, len(u)))
        again = []
        step = max(1, min(BLOCK, (1 << 22) // max(width, len(u) // 8 + 1)))
        for a in range(0, len(todo), step):
            own = todo[a:a + step]
            nodes, cosine = _beam(rough, lists, own, start, width)
            hit = (nodes >= 0) & (cosine >= reach[own][:, None])
            full = (hit.sum(axis=1) * 2 > width) & (width < len(u))
            again.append(own[full])
            line, column = np.nonzero(hit & ~full[:, None])
            left.append(own[line])
            right.append(nodes[line, column])
        todo, width = np.concatenate(again), 2 * width
    a, b = np.concatenate(left), np.concatenate(right)
    keep = a != b
    return a[keep], b[keep]


def _build(settings: Settings):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        lists = build_graph(matrix(table.column("v")), settings, len(ids))
        return pa.table({
            "id": pa.array(ids), "near": pa.array([ids[row].tolist() for row in lists], pa.list_(pa.int64()))})

    return work


def _search(theta: float, beam: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, r, u = table.column("id").to_numpy(), table.column("r").to_numpy(), matrix(table.column("v"))
        near = table.column("near").combine_chunks()
        near = near if isinstance(near, pa.Array) else pa.concat_arrays(near.chunks)
        owner = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy(zero_copy_only=False))
        named = near.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, named).clip(0, len(ids) - 1)
        here = ids[at] == named  # members of other shards are searched there
        owner, at = owner[here], at[here]
        counts = np.bincount(owner, minlength=len(ids))
        starts = np.concatenate([[0], np.cumsum(counts)])
        lists = np.full((len(ids), max(1, int(counts.max(initial=0)))), -1)
        lists[owner, np.arange(len(owner)) - starts[owner]] = at
        a, b = range_search(u, lists, r, theta, beam)
        gap = _angles(np.einsum("ij,ij->i", u[a], u[b]))
        keep = gap <= theta + r[a] + r[b] + SURE
        a, b, gap = a[keep], b[keep], gap[keep]
        low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        return pa.table({"a": low, "b": high, "gap": gap})

    return work


def leader_pairs(balls: Balls, theta: float, settings: Settings) -> DataFrame:
    """`a, b, gap` of leaders within theta and both radii: built, united, searched."""
    lists = per_cell(balls.cells, _build(settings), "id bigint, near array<bigint>")
    united = stage(lists.groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    found = per_cell(
        balls.cells.join(united, "id"), _search(theta, settings.beam), "a bigint, b bigint, gap double")
    return stage(found.groupBy("a", "b").agg(F.min("gap").alias("gap")), "leader-pairs")


def audit(balls: Balls, pairs: DataFrame, theta: float) -> float:
    """Share of the true pairs of some leaders, by brute force over all leaders, that was found.

    Taken are AUDIT leaders of the smallest hash, and as many of those that lead others.
    """
    leaders = balls.leaders
    order = [F.xxhash64("id"), F.col("id")]
    some = leaders.orderBy(*order).limit(AUDIT).collect() + leaders.where("r > 0").orderBy(*order).limit(AUDIT).collect()
    if not some:
        return 1.0
    some = list({r["id"]: r for r in some}.values())
    sent = leaders.sparkSession.sparkContext.broadcast(some)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_group: dict[str, list] = {}
        for row in sent.value:
            by_group.setdefault(row["group"], []).append(row)
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), dtype=object)
            out: list[list] = [[], []]
            for group, rows in by_group.items():
                mine = np.flatnonzero(groups == group)
                if not len(mine):
                    continue
                part = batch.take(pa.array(mine))
                ids, r, u = part.column(0).to_numpy(), part.column(2).to_numpy(), matrix(part.column(3))
                for row in rows:
                    gap = _angles(u @ np.array(row["v"]))
                    near = (gap <= theta + r + row["r"] + SURE) & (ids != row["id"])
                    out[0] += np.minimum(ids[near], row["id"]).tolist()
                    out[1] += np.maximum(ids[near], row["id"]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    true = leaders.select("id", "group", "r", "v").mapInArrow(compare, "a bigint, b bigint").distinct()
    row = true.join(pairs.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0


# ── verification and components ──────────────────────────────────────────────

def _compare(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        one, two = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        out = {"node": [], "a": [], "b": [], "links": []}
        if len(one) and len(two):
            linked = matrix(one.column("v")) @ matrix(two.column("v")).T >= threshold
            for own, other, links in ((one, two, linked), (two, one, linked.T)):
                n = links @ other.column("m").to_numpy()
                hit = np.flatnonzero(n)
                out["node"] += own.column("node").to_numpy()[hit].tolist()
                out["a"] += own.column("leader").to_numpy()[hit].tolist()
                out["b"] += [other.column("leader")[0].as_py()] * len(hit)
                out["links"] += n[hit].tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return work


def _verified(
    nodes: DataFrame, balls: Balls, pairs: DataFrame, theta: float, threshold: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows linked to all of a ball, rows linked to single nodes, and edges between balls."""
    sizes = stage(balls.members.join(nodes.select(F.col("id").alias("node"), "m"), "node").groupBy("leader").agg(
        F.sum("m").alias("rows"), F.count(F.lit(1)).alias("nodes")), "ball-sizes")
    known = balls.leaders.select(F.col("id").alias("leader"), "r").join(sizes, "leader")
    side = lambda s: known.select(*[F.col(c).alias(s if c == "leader" else f"{s}_{c}") for c in known.columns])
    joined = stage(pairs.join(side("a"), "a").join(side("b"), "b"), "leader-pairs")
    sure = F.col("gap") + F.col("a_r") + F.col("b_r") <= theta - SURE
    clear = joined.where(sure)
    whole = clear.select("a", F.col("b_rows").alias("links")).unionByName(
        clear.select(F.col("b").alias("a"), F.col("a_rows").alias("links"))
    ).groupBy(F.col("a").alias("leader")).agg(F.sum("links").alias("whole"))
    # Pairs of balls that need a look at their members, in blocks.
    blocks = lambda n: F.ceil(F.col(n) / MEMBERS).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    tasks = stage(joined.where(~sure).withColumn("ca", numbers("a_nodes")).withColumn("cb", numbers("b_nodes")).select(
        F.concat_ws("-", "a", "ca", "b", "cb").alias("cell"), "a", "ca", "b", "cb"), "ball-blocks")
    asked = tasks.select("cell", F.lit(0).alias("side"), F.col("a").alias("leader"), F.col("ca").alias("block")).unionByName(
        tasks.select("cell", F.lit(1).alias("side"), F.col("b").alias("leader"), F.col("cb").alias("block")))
    placed = (
        balls.members.join(sizes, "leader")
        .join(asked.select("leader").distinct(), "leader", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks("nodes")).cast("int"))
        .join(nodes.select(F.col("id").alias("node"), "m", "v"), "node")
        .select("leader", "block", "node", "m", "v"))
    single = stage(per_cell(
        placed.join(asked, ["leader", "block"]), _compare(threshold),
        "node bigint, a bigint, b bigint, links bigint"), "ball-links")
    edges = clear.select("a", "b").unionByName(single.select("a", "b").distinct())
    return whole, single.groupBy("node").agg(F.sum("links").alias("single")), edges


@dataclass(frozen=True)
class NearDuplicates:
    """One row per vector, and the measured recall of the leaders' search."""

    rows: DataFrame
    recall: float


def near_duplicates(
    table: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector: str = "embedding",
    label: str = "label", settings: Settings = Settings(),
) -> NearDuplicates:
    """`id, n_links, component_id, kept`: links of rows of one label with this cosine or more."""
    theta = math.acos(threshold)
    direction = F.when(F.col(label).isNotNull(), unit(F.col(vector)))
    rows = stage(table.select(F.col(id_column).alias("_id"), F.col(label).cast("string").alias("_label"), direction.alias("v")).withColumn(
        "group", F.concat_ws("|", F.size("v").cast("string"), "_label")).select("_id", F.when(F.col("v").isNotNull(), F.col("group")).alias("group"), "v"), "vectors")
    nodes = stage(rows.where("v IS NOT NULL").groupBy("group", "v").agg(
        F.min("_id").alias("low"), F.count(F.lit(1)).alias("m")
    ).withColumn("id", F.monotonically_increasing_id()), "nodes")
    balls = gather_balls(nodes, theta, settings.cell_rows)
    for _ in range(3):
        pairs = leader_pairs(balls, theta, settings)
        recall = audit(balls, pairs, theta)
        if recall >= TARGET:
            break
        settings = settings.wider()
        balls = replace(balls, cells=stage(
            overlapping_cells(balls.leaders, settings.cell_rows, settings.overlap), "leader-cells"))
    else:
        raise RuntimeError(f"the search finds {recall:.3f} of the links only")
    whole, single, edges = _verified(nodes, balls, pairs, theta, threshold)
    in_ball = stage(balls.members.join(nodes.select(F.col("id").alias("node"), "m", "low"), "node"), "ball-nodes")
    per_ball = in_ball.groupBy("leader").agg(F.sum("m").alias("rows"), F.min("low").alias("low"))
    roots = connected_components(edges)
    rooted = stage(per_ball.join(roots, F.col("leader") == F.col("node"), "left").select(
        "leader", "rows", "low", F.coalesce("component", "leader").alias("root")), "roots")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    judged = rooted.join(least, "root").join(whole, "leader", "left").select(
        "leader", "component_id", (F.col("rows") - 1 + F.coalesce("whole", F.lit(0))).alias("links"))
    per_node = in_ball.select("leader", "node").join(judged, "leader").join(single, "node", "left").select(
        F.col("node").alias("id"), "component_id", (F.col("links") + F.coalesce("single", F.lit(0))).alias("n_links"))
    named = nodes.select("id", "group", "v").join(per_node, "id").drop("id")
    found = rows.join(named, ["group", "v"], "left").select(
        F.col("_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))
    kept = F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False))
    return NearDuplicates(found.withColumn("kept", kept), recall)
