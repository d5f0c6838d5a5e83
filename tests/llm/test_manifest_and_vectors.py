"""Merkle manifests, whitening, the pruned graph, and repeated rows of the neighbour search."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import merkle, neighbours, packing, pruned_graph, whitening
from ebbline.llm.queries import packing_tokenizer


# ── Merkle manifest ──────────────────────────────────────────────────────────

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes, fan):
    rows = [nodes]
    while len(rows[-1]) > 1:
        last = rows[-1]
        rows.append([sha("".join(last[i:i + fan])) for i in range(0, len(last), fan)])
    return rows


def siblings_of(rows, place, fan):
    out = ""
    for row in rows[:-1]:
        start = place // fan * fan
        out += "".join(n for i, n in enumerate(row[start:start + fan], start) if i != place)
        place //= fan
    return out


def brute_manifest(docs, fan):
    """Rows (doc_id, leaf, subroot, root, siblings) by definition."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, s, t in docs:
        groups.setdefault(s, []).append((d is not None, d or 0, sha(part(d) + part(s) + part(t)), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in names]
    top = levels_of([t[-1][0] for t in trees], fan)
    return [
        (x[3], x[2], t[-1][0], top[-1][0], siblings_of(t, i, fan) + siblings_of(top, k, fan))
        for k, (s, t) in enumerate(zip(names, trees))
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:3]))]


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_equals_the_definition(spark, fan):
    rng = np.random.default_rng(fan)
    docs = [(int(i), ["a", "b", None, "", "é"][int(rng.integers(5))] if i % 3 else "hot", f"Text {i % 7} É") for i in range(300)]
    docs += [(None, "a", "x"), (None, "a", None), (5, None, "y"), (5, None, "y"), (7, "alone", "z")]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("leaf", F.lit(3))
    got = merkle.merkle_manifest(table.repartition(5), ["doc_id", "source", "text"], fan=fan).collect()
    want = brute_manifest(docs, fan)
    order = lambda rows: sorted(rows, key=str)
    assert order([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in got]) == order(want)
    assert all(r["folded_root"] == r["root"] and r["claimed_leaf"] == r["leaf"] for r in got)


def test_manifest_finds_a_changed_claim_and_nothing_else(spark):
    table = spark.createDataFrame([(i, "s", f"Word{i}" if i % 2 else "low") for i in range(40)], "doc_id long, source string, text string")
    got = merkle.merkle_manifest(table, ["doc_id", "text"], claimed={"text": F.lower("text")}).collect()
    assert {r["doc_id"] for r in got if r["folded_root"] != r["root"]} == {i for i in range(40) if i % 2}
    assert merkle.merkle_manifest(table.limit(0), ["doc_id", "text"]).count() == 0
    one = merkle.merkle_manifest(table.limit(1), ["doc_id", "text"]).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["siblings"] == ""


def test_missing_nodes_are_the_minimal_union():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, fan = int(rng.integers(1, 200)), int(rng.integers(2, 6))
        low = int(rng.integers(0, n))
        high = int(rng.integers(low, n))
        own, want, size, level = set(range(low, high + 1)), set(), n, 0
        while size > 1:
            need = {i for p in own for i in range(p // fan * fan, min(size, (p // fan + 1) * fan))} - own
            want |= {(4, level, i) for i in need}
            own, size, level = {p // fan for p in own}, -(-size // fan), level + 1
        found = merkle.missing_nodes([(4, low, high, n)], 1, fan)
        assert set(found) == want and len(found) == len(want)


# ── whitening ────────────────────────────────────────────────────────────────

@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1, 1], [1, 1, 1], [1e6, 1, 1e-6, 0], [0, 0], [2]])
def test_components_of_known_spectra(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    found, basis = whitening.spectral_components((v + v.T) / 2)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-12 * max(1, max(values)))
    assert np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ basis - basis * found) <= 1e-12 * max(1, max(values))


def test_polar_factor_has_eigenvalues_of_size_one():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((12, 12))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.allclose(u @ u, np.eye(12), atol=1e-12)
    assert np.all(np.linalg.eigvalsh(u @ a) > 0)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 6)) * [5, 3, 2, 1, 0.5, 0.2]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, x[0].tolist()), (None, x[1].tolist())]
    odd = [(301, None), (302, [1.0, None, 0.0]), (303, [math.nan] * 6), (304, [math.inf] * 6), (305, [1.0] * 5), (306, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("n", F.lit(0))
    got = whitening.whiten_embeddings(table.repartition(4), components=3).toPandas()
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(int)
    fit = np.unique(whole, axis=0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = (whole - fit.mean(axis=0)) @ basis[:, ::-1][:, :3] / np.sqrt(values[::-1][:3])
    assert len(got) == 302 and set(got["n"]) == {300} and got["identity_error"].max() < 1e-12
    by_id = {None if row.vec_id != row.vec_id else int(row.vec_id): row for row in got.itertuples()}
    for (key, _), w, v in zip(rows, want, whole):
        assert np.allclose(np.abs(by_id[key].whitened), np.abs(w), atol=1e-9)
        assert by_id[key].deviation == int(((300 * v - fit.sum(axis=0)) ** 2).sum())
        assert np.allclose(by_id[key].explained, values[::-1][:3] / values.sum())
    assert whitening.whiten_embeddings(table.limit(0), 3).count() == 0
    assert whitening.whiten_embeddings(table.where("vec_id = 0"), 3).count() == 0


def test_deviations_stay_exact_for_large_numbers():
    own = whitening.Whitening(10**6, (10**12, -5), np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    x = np.array([[123456, 7], [2**40, 1]])
    exact = [int(sum((10**6 * int(a) - s) ** 2 for a, s in zip(row, own.sums))) for row in x]
    assert own.deviation(x) == [e if e < 2**63 else None for e in exact]


# ── embedding near-duplicates ────────────────────────────────────────────────

def brute_links(rows, threshold):
    """(n_links, component) of each (vec_id, label, vector) row."""
    def sound(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    units = [np.array(v) / np.linalg.norm(v) if label is not None and sound(v) else None for _, label, v in rows]
    near = [[
        j for j in range(len(rows)) if i != j and units[i] is not None and units[j] is not None
        and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
        for i in range(len(rows))]
    root = [None] * len(rows)
    for i in range(len(rows)):
        if root[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                root[j] = min(ids, default=None)
    return [(len(n), r) for n, r in zip(near, root)]


def test_links_equal_all_pairs(spark):
    """Cells of 150 vectors, so that the larger label is split."""
    cell_rows = 150
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 8))
    rows = []
    for i in range(360):
        # Half of all rows around one centre; spreads so that many pairs lie at the border.
        centre = centres[0] if i % 2 else centres[int(rng.integers(12))]
        rows.append((i, int(i % 5 == 0), (centre + rng.standard_normal(8) * rng.choice([0.02, 0.2, 0.4])).tolist()))
    rows += [(360 + i, 1, rows[0][2]) for i in range(30)] + [(3, 1, rows[0][2]), (None, 1, rows[0][2])]
    rows += [(400, None, rows[1][2]), (401, 0, None), (402, 0, [0.0] * 8), (403, 0, [math.nan] * 8),
             (404, 0, [1.0, None] * 4), (405, 0, [1.0, 2.0]), (406, 0, [2.0, 4.0]), (407, 0, [])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("kept", F.lit("x"))
    found = pruned_graph.near_duplicates(table, 0.9, settings=pruned_graph.Settings(cell_rows=cell_rows))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.rows.collect()), key=str)
    want = sorted(((v, n, c, v is not None and v == c) for (v, _, _), (n, c) in zip(rows, brute_links(rows, 0.9))), key=str)
    assert found.recall >= 0.98 and got == want


def test_no_vectors_no_links(spark):
    table = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in pruned_graph.near_duplicates(table).rows.collect()] == [(1, 0, 1, True)]
    assert pruned_graph.near_duplicates(table.limit(0)).rows.count() == 0


def test_every_member_is_reached_and_found():
    rng = np.random.default_rng(2)
    u = np.vstack([rng.standard_normal((150, 16)), np.repeat(rng.standard_normal((3, 16)), 40, axis=0) + 0.01 * rng.standard_normal((120, 16))])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    settings = pruned_graph.Settings(degree=6, candidates=12, random=4, beam=4)
    graph = pruned_graph.build_graph(u, settings)
    lists = np.full((len(u), max(map(len, graph))), -1)
    for i, row in enumerate(graph):
        lists[i, :len(row)] = row
        assert i not in row and len(set(row)) == len(row)
    assert pruned_graph._reached(lists, pruned_graph.medoid(u)).all()
    a, b = pruned_graph.range_search(u, lists, np.zeros(len(u)), math.acos(0.93), 4)
    cosine = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(cosine >= 0.93)) if i < j}
    got = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())}
    assert len(want - got) <= 0.02 * len(want)


# ── repeated rows ────────────────────────────────────────────────────────────

def test_copies_are_candidates_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(30)] + [(4, None)] * 2
    rows += [(4, rows[4][1])] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(table, F.col("id") == 7, k=40).collect()
    assert len(got) == 32 and sorted(r["rank"] for r in got) == list(range(1, 33))
    assert [r["vec_id"] for r in got].count(4) == 4
    own = neighbours.nearest_neighbours(table, F.col("id") == 4, k=3).collect()
    assert len(own) == 12 and all(r["vec_id"] == 4 for r in own if r["score"] > 0.999 * max(x["score"] for x in own))


def test_ids_of_any_letters_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(packing_tokenizer()), packing.WordTokenizer(packing_tokenizer(), memo_words=300)
    assert own.by_runs
    rng = np.random.default_rng(6)
    letters = ["\x1c", "\x1f"] + list("aİıŞǅßΣσςéÉ̇  　\t\n.,!?'’s‍9٣中ﬁ") + ["'ll", "…", "Ⅷ", "\U0001d400", "🙂"]
    for _ in range(4000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 9))))
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids, ascii(text)
