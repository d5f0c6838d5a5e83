"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest distance: vectors are scaled by the largest
norm and get one more coordinate that brings them to length one, queries get a zero there;
the distance then falls as the inner product grows. Each of `tables` tables hashes with k
Gaussian projections, cut into slots of width w. A query looks into its own bucket and into
buckets that differ by one slot in some projections, ordered by the estimated success: the
smaller the sum of squared distances from the query's projections to the slot borders
crossed, the likelier a neighbour lies there.

Fitting sets k from the number of rows (buckets keep about `bucket_rows` rows, smoothly)
and measures the rest: `calibration` queries, taken by hash, get their exact neighbours in
one pass over all rows, and the number of probes is the smallest that would have found a
share of `target` of them. So recall holds whatever the data are like; where hashing tells
little (vectors without any cluster) more buckets are probed.

Search sends every vector to the tasks that own its buckets, one row per table, and every
query once to each task that owns some of its probed buckets. A task keeps a bounded part
of the index, scores the query against its probed buckets as matrix products and returns
the best `k` of that part with exact scores; the parts' candidates are merged per query.
No pair is ever a row. A bucket of more than `bucket_limit` rows is spread over chunks, and
a query visits all of them: no bucket is cut.

Defined results: vectors that are null, empty, zero, of another length than the commonest,
or hold null or non-finite components take no part, neither do null ids. Equal scores go by
the smaller id. Repeated rows, exact copies too, are candidates and queries of their own;
only a query's own row is no candidate of it. A table without vectors gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions.ordering import global_row_number
from ebbline.llm.common import stage

HITS = "part bigint, query_id bigint, hits array<struct<score:double,vec_id:bigint>>"
VECTOR = "array<double>"


@dataclass(frozen=True)
class LshIndex:
    """Projections, slot widths and the number of probes of each table."""

    directions: np.ndarray  # tables x k x (dim + 1)
    shifts: np.ndarray      # tables x k
    width: float
    scale: float            # largest norm
    probes: int
    rows: int               # vectors it was fitted on
    recall: float           # of the calibration queries at that number of probes

    @property
    def tables(self) -> int:
        return len(self.directions)

    def augmented(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        scaled = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) if query else self.scale)
        rest = np.zeros(len(scaled)) if query else np.sqrt(
            np.clip(1 - np.einsum("ij,ij->i", scaled, scaled), 0, None))
        return np.hstack([scaled, rest[:, None]])

    def slots(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections in slot units: rows x tables x k."""
        points = self.augmented(vectors, query)
        return np.einsum("nd,tkd->ntk", points, self.directions) / self.width + self.shifts

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for the table and cell: rows x tables (x ...) of int64."""
        weights = _MIX[: cells.shape[-1]]
        table = np.arange(self.tables, dtype=np.int64).reshape([-1] + [1] * (cells.ndim - 3))
        with np.errstate(over="ignore"):
            mixed = (cells.astype(np.int64) * weights).sum(axis=-1) + table * _TABLE
            mixed ^= (mixed >> 31) & 0x1FFFFFFFF
            return mixed * _FINAL

    def probe_order(self, position: np.ndarray, limit: int) -> np.ndarray:
        """Offsets (-1, 0, 1) of the `limit` likeliest cells for one table's k slots.

        The score of a set of perturbations is the sum of squared border distances; a
        projection moves one way at most.
        """
        low = position - np.floor(position)
        offsets = _offsets(len(position))
        costs = np.stack([low**2, np.zeros_like(low), (1 - low) ** 2])  # -1, 0, 1
        total = costs[offsets + 1, np.arange(len(position))].sum(axis=1)
        chosen = np.argpartition(total, limit - 1)[:limit] if limit < len(total) else np.arange(len(total))
        return offsets[chosen[np.argsort(total[chosen], kind="stable")]]

    def probe_keys(self, vectors: np.ndarray) -> np.ndarray:
        """Keys of all probed cells: queries x (tables x probes)."""
        position = self.slots(vectors, query=True)
        base = np.floor(position).astype(np.int64)
        cells = np.stack([
            np.stack([base[i, t] + self.probe_order(position[i, t], self.probes) for t in range(self.tables)])
            for i in range(len(vectors))
        ])
        return self.keys(cells).reshape(len(vectors), -1)


_RNG = np.random.default_rng(20)
_MIX = _RNG.integers(-(1 << 62), 1 << 62, 64) | 1
_TABLE, _FINAL = np.int64(0x9E3779B97F4A7C1), np.int64(0x2545F4914F6CDD1D)
_CELLS: dict[int, np.ndarray] = {}


def _offsets(k: int) -> np.ndarray:
    """All offsets with entries -1, 0, 1, fewest moves first; as many moves at once as
    keep the list within MOST_CELLS (all of them up to k = 9)."""
    if k not in _CELLS:
        found: list[np.ndarray] = []
        for n in range(k + 1):
            if len(found) + math.comb(k, n) * 2**n > MOST_CELLS:
                break
            for where in itertools.combinations(range(k), n):
                for signs in itertools.product((-1, 1), repeat=n):
                    row = np.zeros(k, dtype=np.int64)
                    row[list(where)] = signs
                    found.append(row)
        _CELLS[k] = np.array(found)
    return _CELLS[k]


MOST_CELLS = 20_000


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`id, v` (doubles) of the rows that take part."""
    doubles = table.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast(VECTOR).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    sound = doubles.where(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # Ties between lengths go to the shorter one.
    lengths = sound.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    row = lengths.orderBy(F.desc("c"), "n").first()
    return sound.where(F.size("v") == (row["n"] if row else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: largest score, then smallest id; ties all compared."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= bound)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _nearest(
    matrix: np.ndarray, ids: np.ndarray, query: np.ndarray, rough: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows for one query and their scores.

    `rough` has fast products, minus infinity for rows that are no candidates. It picks
    what can be among the best; sums in a fixed order, alike for equal vectors, decide.
    """
    near = np.flatnonzero(rough > -np.inf)
    if len(near) > k:
        kth = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= kth - 1e-9 * (1 + abs(kth)))
    exact = (matrix[near] * query).sum(axis=1)
    best = _best(ids[near], exact, k)
    return near[best], exact[best]


def exact_neighbours(vectors: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """Best k rows for a stated, bounded set of queries, in one pass over all rows."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries, query_ids))
    schema = "query_id bigint, vec_id bigint, score double, v array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, own = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
            rows = []
            for q, i in zip(points, own):
                near, exact = _nearest(matrix, ids, q, np.where(ids == i, -np.inf, matrix @ q), k)
                rows += [(int(i), int(ids[n]), float(s), matrix[n].tolist()) for n, s in zip(near, exact)]
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score", "v"])

    return vectors.select("id", "v").mapInArrow(scan, schema)


def fit_index(
    vectors: DataFrame, k: int = 20, tables: int = 4, bucket_rows: int = 512, width: float = 1.2,
    calibration: int = 64, target: float = 0.95, seed: int = 5,
) -> LshIndex | None:
    """An index for the rows of usable_vectors(); None for no rows.

    The number of projections follows the logarithm of the row count. Directions have unit
    standard deviation on unit vectors, so `width` is in units of that.
    """
    figures = vectors.agg(
        F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.max(F.size("v"))
    ).first()
    count, scale, dim = figures
    if not count:
        return None
    hashes = max(3, round(math.log(max(1, count / bucket_rows)) / math.log(2.3)))
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(calibration).collect()
    queries, ids = np.array([r["v"] for r in sample]), np.array([r["id"] for r in sample])
    truth = _merge(exact_neighbours(vectors, queries, ids, k), k, F.col("v")).collect()
    while True:
        rng = np.random.default_rng(seed)
        index = LshIndex(
            rng.standard_normal((tables, hashes, dim + 1)), rng.random((tables, hashes)), width, scale, 1, count, 1.0)
        ranks = np.sort(_ranks(index, queries, ids, truth))
        if not len(ranks):
            return index
        everything = len(_offsets(hashes))
        probes = min(int(ranks[math.ceil(target * len(ranks)) - 1]) + 1, everything)
        recall = float((ranks < probes).mean())
        if recall >= target or hashes == 1:
            return replace(index, probes=probes, recall=recall)
        hashes -= 1  # too fine for the data: neighbours lie beyond the adjacent slots


def _ranks(index: LshIndex, queries: np.ndarray, ids: np.ndarray, truth: list) -> np.ndarray:
    """At which probe each true neighbour is found first, over the tables."""
    number = {int(i): n for n, i in enumerate(ids)}
    if not truth:
        return np.zeros(0)
    owner = np.array([number[r["query_id"]] for r in truth])
    cells = np.floor(index.slots(np.array([r["v"] for r in truth]), query=False)).astype(np.int64)
    position = index.slots(queries, query=True)
    base = np.floor(position).astype(np.int64)
    everything = len(_offsets(position.shape[2]))
    ranks = np.full(len(truth), everything)
    for q in range(len(queries)):
        mine = np.flatnonzero(owner == q)
        for t in range(index.tables):
            order = index.probe_order(position[q, t], everything)
            where = {row.tobytes(): n for n, row in enumerate(order)}
            for n in mine:
                ranks[n] = min(ranks[n], where.get((cells[n, t] - base[q, t]).tobytes(), everything))
    return ranks


def _merge(hits: DataFrame, k: int, *more: Column) -> DataFrame:
    """The k best distinct candidates of each query, `rank` from 1."""
    entry = F.struct((-F.col("score")).alias("s"), "vec_id", *more)
    return _ranked(
        hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(entry)), 1, k).alias("best")),
        *(["v"] if more else []))


def _ranked(best: DataFrame, *more: str) -> DataFrame:
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"), *[F.col(f"b.{c}") for c in more])


@dataclass(frozen=True)
class Placement:
    """Which part of the index holds a bucket.

    A bucket of more than the limit is dealt out over chunks by the vectors' ids, and each
    chunk has its own part. There are at most as many such buckets as index entries divided
    by the limit.
    """

    index: LshIndex
    parts: int
    hot: np.ndarray     # ascending keys of large buckets
    chunks: np.ndarray  # how many chunks each has

    def _chunks(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(keys.shape, dtype=np.int64)
        at = np.searchsorted(self.hot, keys).clip(0, len(self.hot) - 1)
        return np.where(self.hot[at] == keys, self.chunks[at], 1)

    def _part(self, keys: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        return (_mixed(keys.astype(np.uint64) + _mixed(chunk.astype(np.uint64))) % np.uint64(self.parts)).astype(np.int64)

    def place(self, ids: np.ndarray, vectors: np.ndarray) -> list[list[dict]]:
        """Parts of each vector, with its buckets there."""
        keys = self.index.keys(np.floor(self.index.slots(vectors, query=False)).astype(np.int64))
        chunk = (_mixed(ids.astype(np.uint64))[:, None] % self._chunks(keys).astype(np.uint64)).astype(np.int64)
        return [_by_part(k, p) for k, p in zip(keys, self._part(keys, chunk))]

    def ask(self, vectors: np.ndarray) -> list[list[dict]]:
        """Parts of each query's probed buckets, all chunks of large ones included."""
        out = []
        for keys in self.index.probe_keys(vectors):
            chunks = self._chunks(keys)
            spread = np.repeat(keys, chunks)
            chunk = np.arange(len(spread)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            out.append(_by_part(spread, self._part(spread, chunk)))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: unsigned numbers spread evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def _by_part(keys: np.ndarray, parts: np.ndarray) -> list[dict]:
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    return [
        {"part": int(parts[group[0]]), "buckets": np.unique(keys[group]).tolist()}
        for group in np.split(order, cuts) if len(group)
    ]


_PLACES = pa.list_(pa.struct([("part", pa.int64()), ("buckets", pa.list_(pa.int64()))]))
_PLACES_DDL = "array<struct<part:bigint,buckets:array<bigint>>>"


def search(
    vectors: DataFrame, queries: DataFrame, index: LshIndex, k: int = 20,
    part_bytes: int = 8 << 20, bucket_limit: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found.

    `vectors` and `queries` have `id, v`; a query's own id is no candidate of it.
    """
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(index)

    @F.arrow_udf("array<bigint>")
    def own_keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            cells = np.floor(sent.value.slots(_matrix(column), query=False)).astype(np.int64) if len(column) else None
            yield pa.array(sent.value.keys(cells).tolist() if len(column) else [], type=pa.list_(pa.int64()))

    # Only large buckets come to the driver; their number is bounded by their size.
    large = (
        vectors.select(F.explode(own_keys.asNondeterministic()("v")).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_limit)
        .orderBy("bucket").collect()
    )
    dim = index.directions.shape[2] - 1
    placement = context.broadcast(Placement(
        index, max(1, -(-index.rows * index.tables * dim * 8 // part_bytes)),
        np.array([r["bucket"] for r in large], dtype=np.int64),
        np.array([-(-r["n"] // bucket_limit) for r in large], dtype=np.int64)))

    @F.arrow_udf(_PLACES_DDL)
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, column in batches:
            found = placement.value.place(ids.to_numpy(), _matrix(column)) if len(column) else []
            yield pa.array(found, type=_PLACES)

    @F.arrow_udf(_PLACES_DDL)
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(placement.value.ask(_matrix(column)) if len(column) else [], type=_PLACES)

    # Vectors and queries go once to each part that needs them, with their buckets there.
    columns = ["at.part", "kind", "id", "at.buckets", "v"]
    placed = vectors.select(
        "id", "v", F.lit(0).alias("kind"), F.explode(place.asNondeterministic()("id", "v")).alias("at")).select(*columns)
    asked = queries.select(
        "id", "v", F.lit(1).alias("kind"), F.explode(ask.asNondeterministic()("v")).alias("at")).select(*columns)
    both = placed.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind", "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _PartBlock()
        for batch in batches:
            which, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Runs of one part and kind inside the batch.
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(which)]):
                if a == b:
                    continue
                run = batch.slice(a, b - a)
                ids, lists, matrix = run.column(2).to_numpy(), run.column(3).to_pylist(), _matrix(run.column(4))
                if kinds[a] == 0:
                    block.add(int(which[a]), ids, lists, matrix)
                    continue
                yield _hit_rows(int(which[a]), *block.answer(int(which[a]), ids, lists, matrix, k))

    # One row per query and part, merged in two steps without being spread out: neither
    # gathers more than k candidates of about the root of the number of parts.
    groups = math.ceil(math.sqrt(placement.value.parts))
    entries = F.transform("hits", lambda h: F.struct((-h["score"]).alias("s"), h["vec_id"].alias("vec_id")))
    first = both.mapInArrow(score, HITS).select("query_id", (F.col("part") % groups).alias("g"), entries.alias("best"))
    return _ranked(_kept(_kept(first, k, "query_id", "g"), k, "query_id"))


def _kept(lists: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best distinct entries of the lists of each group."""
    return lists.groupBy(*by).agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best"))


def _hit_rows(part: int, owners: list[int], ids: list[np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
    """One row per query with its best candidates in a part."""
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.zeros(0), *scores])),
         pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64))], ["score", "vec_id"])
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(owners), type=pa.int64()), pa.array(owners, type=pa.int64()),
         pa.ListArray.from_arrays(pa.array(offsets), flat)],
        names=["part", "query_id", "hits"])


class _PartBlock:
    """The vectors of one part of the index, by bucket."""

    def __init__(self) -> None:
        self.part = None

    def add(self, part: int, ids: np.ndarray, buckets: list[list[int]], matrix: np.ndarray) -> None:
        if part != self.part:
            self.part, self.pieces, self.members, self.count = part, [], {}, 0
            self.ready = False
        for n, held in enumerate(buckets):
            for bucket in held:
                self.members.setdefault(bucket, []).append(self.count + n)
        self.pieces.append((ids, matrix))
        self.count += len(ids)

    def answer(self, part: int, ids: np.ndarray, buckets: list[list[int]], matrix: np.ndarray, k: int):
        out = ([], [], [])
        if part == self.part:
            if not self.ready:
                self.ids = np.concatenate([p[0] for p in self.pieces])
                self.matrix = np.vstack([p[1] for p in self.pieces])
                self.members = {b: np.array(m) for b, m in self.members.items()}
                self.ready = True
            for n in range(0, len(ids), 64):
                products = matrix[n:n + 64] @ self.matrix.T
                for own, asked, query, rough in zip(ids[n:n + 64], buckets[n:n + 64], matrix[n:n + 64], products):
                    probed = np.zeros(len(rough), dtype=bool)
                    for bucket in asked:
                        if bucket in self.members:
                            probed[self.members[bucket]] = True
                    rough[~probed | (self.ids == own)] = -np.inf
                    near, exact = _nearest(self.matrix, self.ids, query, rough, k)
                    out[0].append(int(own))
                    out[1].append(self.ids[near])
                    out[2].append(exact)
        return out


def nearest_neighbours(
    table: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding",
    k: int = 20, **options,
) -> DataFrame:
    """Fit on the table's vectors and search for the rows that `queries` (over `id`) selects."""
    vectors = stage(usable_vectors(table, id_column, vector), "lsh-vectors")
    repeated = vectors.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        return _search_numbered(vectors, queries, k, **options)
    index = fit_index(vectors, k, **options)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(vectors, vectors.where(queries), index, k)


def _search_numbered(vectors: DataFrame, queries: Column, k: int, **options) -> DataFrame:
    """The search where ids repeat: rows get numbers in the order of their ids, so that
    each row is a candidate and a query of its own and ties still go by the id."""
    row = stage(
        global_row_number(
            vectors.withColumn("_row", F.monotonically_increasing_id()), [F.col("id"), F.col("_row")], "number"),
        "lsh-numbered")
    numbered = row.select(F.col("number").cast("long").alias("id"), "v")
    asked = row.where(queries).select(F.col("number").cast("long").alias("id"), "v")
    found = search(numbered, asked, fit_index(numbered, k, **options), k)
    own = row.select(F.col("number").alias("query_id"), F.col("id").alias("_query"))
    other = row.select(F.col("number").alias("vec_id"), F.col("id").alias("_vec"))
    return found.join(own, "query_id").join(other, "vec_id").select(
        F.col("_query").alias("query_id"), "rank", F.col("_vec").alias("vec_id"), "score")
