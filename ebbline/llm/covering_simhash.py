"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one majority bit for each of the 64 bit positions of its shingles'
XXH64 values. For a radius r, every bit position i carries a code m(i), a nonzero
vector of r + 1 bits, and every nonzero vector v of r + 1 bits is a table that keeps
the positions with an odd <m(i), v>. At most r differing positions span at most r
dimensions, so some v is orthogonal to all of them: that table masks every difference,
and the pair collides there. Nothing is left to chance, within the radius no pair is
missed.

Only distinct fingerprints enter the tables, so exact copies cost one row. A bucket of
up to `pair_bucket` fingerprints compares its members. A larger one uses an exact way
that is linear in its size: its members agree on all kept bits, so two of them are
within r bits exactly if they share a fingerprint at distance up to r/2 (rounded up)
from both, and each member links to the smallest holder of every such value. No bucket
is cut, no pair of the radius loses its link.

Defined results: a null or empty text has no words and fingerprint zero, linked like
any other. Null ids keep their row; the component is the smallest non-null id reachable
(null if there is none). Repeated rows stay. Input columns named like result columns
give way. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import stage, utf8
from ebbline.llm.components import connected_components

BITS = 64
SEED = 42
_LOWER_ASCII = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_CHUNK = 1 << 15  # shingles whose bits are added up at once


def shingle_hashes(text: bytes | None, width: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, in blocks; repeats included."""
    words = (text or b"").translate(_LOWER_ASCII).split()
    if not words:
        return
    hashed = functools.partial(xxhash.xxh64_intdigest, seed=seed)
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([hashed(joined)], dtype=np.uint64)
        return
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = itertools.chain([0], ends)
    spans = zip(starts, itertools.islice(ends, width - 1, None))
    while block := [hashed(joined[i:j - 1]) for i, j in itertools.islice(spans, _CHUNK)]:
        yield np.array(block, dtype=np.uint64)


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """The fingerprint as an unsigned number; bit set if set in over half the hashes."""
    votes, total = np.zeros(BITS, dtype=np.int64), 0
    for block in shingle_hashes(text, width, seed):
        bits = np.unpackbits(
            block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(block)
    chosen = np.packbits((2 * votes > total).astype(np.uint8), bitorder="little")
    return int(chosen.view("<u8")[0])


def fingerprint_column(text: str, width: int = 3, seed: int = SEED) -> Column:
    """Signed 64-bit fingerprints, an Arrow function over whole texts."""

    @F.arrow_udf("bigint")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = np.fromiter(
                (fingerprint(t.as_py(), width, seed) for t in texts), np.uint64, len(texts))
            yield pa.array(values.view(np.int64))

    return compute.asNondeterministic()(utf8(text)).alias("fingerprint")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks; positions cycle through the nonzero codes."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, code in enumerate(codes) if (code & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _nearby(free: Column, masks: list[int], reach: int) -> Column:
    """All values within `reach` flips of the bits a table leaves free."""
    per_table = []
    for mask in masks:
        open_bits = [i for i in range(BITS) if not mask >> i & 1]
        flips = [
            _signed(sum(1 << i for i in chosen))
            for n in range(reach + 1) for chosen in itertools.combinations(open_bits, n)
        ]
        per_table.append(F.array(*[F.lit(x) for x in flips]))
    return F.transform(F.element_at(F.array(*per_table), F.col("table") + 1), lambda x: free.bitwiseXOR(x))


def near_links(nodes: DataFrame, radius: int, pair_bucket: int = 64) -> DataFrame:
    """Edges `a, b` that connect what pairs within the radius connect.

    `nodes` has distinct `fp` with the id `node`, unique too.
    """
    masks = covering_masks(radius)
    tables = F.array(*[
        F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for k, m in enumerate(masks)
    ])
    entries = nodes.select("node", "fp", F.explode(tables).alias("t")).select("node", "fp", "t.*")
    shared = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Most fingerprints are alone in all their buckets; the rest is written once.
    members = stage(entries.join(shared, ["table", "key"]), "simhash-buckets")
    small = members.where(F.col("n") <= pair_bucket)
    other = small.select("table", "key", F.col("node").alias("b"), F.col("fp").alias("other"))
    pairs = (
        small.select("table", "key", F.col("node").alias("a"), "fp")
        .join(other, ["table", "key"])
        .where((F.col("a") < F.col("b"))
               & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
        .select("a", "b")
    )
    # Distance r is covered by halves of r/2 on either side; odd radii need the larger
    # half on both, and then the link is checked again.
    reach = (radius + 1) // 2
    around = members.where(F.col("n") > pair_bucket).select(
        "table", "key", "node", "fp", F.explode(_nearby(F.col("fp"), masks, reach)).alias("value"))
    meeting = around.groupBy("table", "value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n"))
    linked = around.join(meeting.where("n > 1"), ["table", "value"]).select(
        F.col("node").alias("a"), "b").where("a != b")
    return pairs.unionByName(linked).distinct()


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3,
    radius: int = 2, pair_bucket: int = 64,
) -> DataFrame:
    """Id, fingerprint (16 hex digits) and component_id of every row.

    Two fingerprints are linked at `radius` or fewer differing bits; the component is
    the smallest id reachable over links. The radius is even: for odd ones the linear
    way of large buckets would link at one bit more.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even and not negative")
    hashed = stage(
        docs.select(F.col(id_column).alias("_id"), fingerprint_column(text, width).alias("fp")),
        "simhash")
    nodes = stage(hashed.groupBy("fp").agg(F.min("_id").alias("node")), "simhash-nodes")
    edges = near_links(nodes.where("node IS NOT NULL"), radius, pair_bucket)
    roots = connected_components(edges)
    labelled = nodes.join(roots, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return hashed.join(labelled, "fp").select(
        F.col("_id").alias(id_column),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def deduplicate(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2,
) -> DataFrame:
    """One row of each component stays: that of the smallest id, with all columns.

    Rows of equal id count as one; of them the row with the smallest text stays (null before
    any text, then by the other columns). Rows without an id cannot be told apart and stay.
    """
    named = docs.where(F.col(id_column).isNotNull())
    components = simhash_components(named, id_column, text, width, radius)
    kept = components.where(F.col(id_column) == F.col("component_id")).select(id_column)
    rest = [text, *[c for c in docs.columns if c not in (id_column, text)]]
    least = named.join(kept.distinct(), id_column, "left_semi").groupBy(id_column).agg(
        F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    one = least.select(id_column, *[F.col("_row").getField(c).alias(c) for c in rest]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
    return one.unionByName(docs.where(F.col(id_column).isNull()))
