"""SimHash components and nearest neighbours against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ebbline.llm import components, covering_simhash, neighbours

SCHEMA = "doc_id long, text string, fingerprint string, extra int"


def brute_fingerprint(text, width=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").split(r"[ \t-\r]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    """values: {id: fingerprint}; smallest id reachable."""
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (values[a] ^ values[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_equals_the_definition():
    rng = random.Random(4)
    texts = ["", None, "one", "One TWO", "a b c", "É é x \x0b y\tz", "a a a a a a"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    for text in texts:
        got = covering_simhash.fingerprint(text.encode() if text is not None else None)
        assert got == brute_fingerprint(text), text


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000))
    whole = covering_simhash.fingerprint(text.encode())
    monkeypatch.setattr(covering_simhash, "_CHUNK", 7)
    assert covering_simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_every_pair_within_the_radius_shares_a_table():
    masks = covering_simhash.covering_masks(2)
    assert len(masks) == 7
    for bits in itertools.chain(itertools.combinations(range(64), 1), itertools.combinations(range(64), 2)):
        difference = sum(1 << b for b in bits)
        assert any(not difference & m for m in masks)
    assert all(30 <= m.bit_count() <= 40 for m in masks)


@pytest.mark.parametrize("pair_bucket", [1, 4, 64])
def test_links_connect_what_brute_force_connects(spark, pair_bucket):
    rng = random.Random(7)
    values = {}
    for center in range(6):
        base = rng.getrandbits(64)
        for _ in range(12):
            flips = sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1)
            values[len(values)] = base ^ flips
    distinct = {}
    for i, v in values.items():
        distinct.setdefault(v, i)
    nodes = spark.createDataFrame(
        [(i, covering_simhash._signed(v)) for v, i in distinct.items()], "node long, fp long")
    edges = covering_simhash.near_links(nodes, 2, pair_bucket)
    by_id = {i: v for v, i in distinct.items()}
    for a, b in edges.collect():
        assert (by_id[a] ^ by_id[b]).bit_count() <= 2
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert {i: found.get(i, i) for i in by_id} == brute_components(by_id)


def test_simhash_rows_nulls_and_clashes(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (5, "the same text here", "x", 1), (3, "the same text here", "y", 2), (3, "the same text here", "y", 2),
        (9, None, "z", 3), (8, "", None, 4), (7, " \n\t ", None, 5), (None, "the same text here", None, 6),
        (10, long, None, 7), (11, long + " tail", None, 8), (None, "alone among all", None, 9),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = covering_simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    values = {}
    for i, text, *_ in rows:
        if i is not None:
            values[i] = brute_fingerprint(text)
    expected = brute_components(values)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{values[r['doc_id']]:016x}"
            assert r["component_id"] == expected[r["doc_id"]]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["3", "None"]
    kept = covering_simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([*set(expected.values()), None, None], key=str)
    assert covering_simhash.simhash_components(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(100, 101), (7, 7)]
    found = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert set(found[i] for i in range(31)) == {0}
    assert set(found[i] for i in range(100, 140)) == {100}
    empty = spark.createDataFrame([], "a long, b long")
    assert components.connected_components(empty).count() == 0


# ── nearest neighbours ───────────────────────────────────────────────────────

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def brute_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(rows[q], v)), i) for i, v in rows.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def test_small_table_is_searched_in_full_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).astype(np.float32).astype(float) for i in range(40)}
    rows[7] = rows[3].copy()  # a tie
    data = [(i, v.tolist(), 1, "x") for i, v in rows.items()]
    data += [
        (200, None, 1, "x"), (220, [0.0] * 8, 1, "x"), (240, [float("nan")] * 8, 1, "x"), (260, [], 1, "x"),
        (280, [float("inf")] + [1.0] * 7, 1, "x"), (None, [1.0] * 8, 1, "x"), (300, [None] + [1.0] * 7, 1, "x"),
        (320, [1.0, 2.0], 1, "x"),
    ]
    table = spark.createDataFrame(data, VECTORS)
    got = neighbours.nearest_neighbours(table, F.col("id") % 20 == 0, k=5, bucket_rows=10_000, width=50.0)
    by_query = {}
    for r in got.orderBy("query_id", "rank").collect():
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(by_query[r["query_id"]])
    expected = brute_neighbours(rows, [0, 20], 5)
    assert {q: [i for i, _ in v] for q, v in by_query.items()} == {q: [i for i, _ in v] for q, v in expected.items()}
    for q in expected:
        np.testing.assert_allclose([s for _, s in by_query[q]], [s for _, s in expected[q]], rtol=1e-12)


def test_recall_with_clusters_norms_and_a_hot_bucket(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16)) * 3
    points = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16)) * 0.4
    points[:500] = centres[0] + rng.normal(size=(500, 16)) * 0.01  # a third nearly alike
    points *= rng.uniform(0.5, 2, size=(1500, 1))
    rows = dict(enumerate(points))
    table = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in rows.items()], "vec_id long, embedding array<double>, label int, score string")
    vectors = neighbours.usable_vectors(table).cache()
    index = neighbours.fit_index(vectors, 10)
    assert index.recall >= 0.95
    got = neighbours.search(vectors, vectors.where("id % 20 = 0"), index, 10, part_bytes=300 * 16 * 8, bucket_limit=100).collect()
    expected = brute_neighbours(rows, range(0, 1500, 20), 10)
    found = sum(r["vec_id"] in {i for i, _ in expected[r["query_id"]]} for r in got)
    assert found / sum(map(len, expected.values())) >= 0.9
    assert all(r["vec_id"] != r["query_id"] for r in got)


def test_probe_order_is_by_border_distance():
    index = neighbours.LshIndex(np.zeros((1, 3, 2)), np.zeros((1, 3)), 1.0, 1.0, 1, 1, 1.0)
    order = index.probe_order(np.array([0.1, 0.5, 0.8]), 27)
    costs = [sum(((0.1, 0.5, 0.8)[j] if o < 0 else 1 - (0.1, 0.5, 0.8)[j]) ** 2 for j, o in enumerate(row) if o) for row in order]
    assert costs == sorted(costs) and len({tuple(r) for r in order}) == 27 and not order[0].any()
    assert order[1].tolist() == [-1, 0, 0]


def test_no_vectors(spark):
    table = spark.createDataFrame([(1, None, 1, "x")], VECTORS)
    assert neighbours.nearest_neighbours(table, F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest_neighbours(table.limit(0), F.col("id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 0.0], 1, "x")], VECTORS)
    assert neighbours.nearest_neighbours(one, F.col("id") % 20 == 0).count() == 0
