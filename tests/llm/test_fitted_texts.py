"""Quality, language and toxicity: parts against brute force, models by held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm import language_id, ordinal_quality, toxicity
from ebbline.llm.common import remainder

DOCS = "doc_id long, text string, score string, Predicted int, expected_grade int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 7) for i, t in rows], DOCS)


# ── quality ──────────────────────────────────────────────────────────────────

def ordinal_sample(rng, n):
    """Texts whose share of good words sets a grade from 0 to 4, with noise."""
    features, grades, hasher = [], [], ordinal_quality.TextHasher(1 << 12)
    for _ in range(n):
        share = rng.random()
        text = " ".join(rng.choice(["fine", "sound", "clear"]) if rng.random() < share else rng.choice(["junk", "spam", "xx"]) for _ in range(40))
        features.append(hasher.features(text.encode()))
        grades.append(min(4, max(0, int(5 * (share + rng.gauss(0, 0.08))))))
    return features, grades


def test_ordered_thresholds_and_held_out_grades():
    rng = random.Random(8)
    model = ordinal_quality.fit_ordinal(*ordinal_sample(rng, 1200), buckets=1 << 12)
    assert model.grades == (0, 1, 2, 3, 4) and (np.diff(model.thresholds) > 0).all()
    features, grades = ordinal_sample(rng, 400)
    scores = np.array([model.weights[i] @ v for i, v in features])
    expected = model.expected(scores)
    assert np.abs(expected - grades).mean() < 0.6
    assert np.corrcoef(expected, grades)[0, 1] > 0.9
    # The expected grade is the sum of the tails.
    np.testing.assert_allclose(expected, sum(model.tail(scores, g) for g in (1, 2, 3, 4)), atol=1e-12)
    assert (model.tail(scores, 0) == 1).all() and (model.tail(scores, 5) == 0).all()


def test_gradient_equals_differences():
    """The fit's optimum: no threshold or weight can be moved to raise the likelihood."""
    features = [(np.array([0], np.int32), np.array([x])) for x in (-2.0, -1.0, 0.0, 1.0, 2.0, 0.5)]
    grades = [0, 1, 0, 2, 1, 2]
    model = ordinal_quality.fit_ordinal(features, grades, buckets=1, rounds=4000, rate=0.02, penalty=0.0)

    def loss(w, t):
        p = ordinal_quality.OrdinalModel((0, 1, 2), np.array([w]), np.array(t)).cumulative(np.array([w * v[0] for _, v in features]))
        p = np.hstack([np.zeros((6, 1)), p, np.ones((6, 1))])
        return -np.log([p[i, g + 1] - p[i, g] for i, g in enumerate(grades)]).sum()

    best = loss(model.weights[0], model.thresholds)
    for d in (-0.05, 0.05):
        assert loss(model.weights[0] + d, model.thresholds) > best
        for k in range(2):
            moved = model.thresholds.copy()
            moved[k] += d
            assert loss(model.weights[0], moved) > best


def test_shapes():
    assert ordinal_quality.token_shape(b"THE,!!") == b"AA,!!"
    assert ordinal_quality.token_shape("Écoute12".encode()) == b"aa00"


def test_quality_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words"), (3, "good words"), (None, "GOOD!!"), (4, "w " * 60_000)]
    docs = frame(spark, rows)
    ratings = spark.createDataFrame([(3, 2), (2, 0), (2, 1), (1, None), (None, 1), (4, 0)], "doc_id long, grade int")
    model = ordinal_quality.fit_quality(docs, ratings, F.lit(True))
    assert model.grades == (0, 1, 2)
    got = ordinal_quality.score_quality(docs, model, 1)
    assert got.columns == ["doc_id", "text", "score", "Predicted", "expected_grade", "tail_probability", "selected"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in got)
    none = ordinal_quality.fit_quality(docs, ratings.limit(0), F.lit(True))
    assert {(r["expected_grade"], r["tail_probability"]) for r in ordinal_quality.score_quality(docs, none, 1).collect()} == {(0.0, 0.0)}
    assert ordinal_quality.score_quality(docs.limit(0), model, 1).count() == 0


# ── language ─────────────────────────────────────────────────────────────────

def slow_label(reader, text):
    """One document, one byte at a time."""
    units, steps = reader.recurrent.shape[2], language_id.STEPS
    total = np.zeros(len(reader.languages))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for s in range(0, len(text), steps):
        part, sides = text[s:s + steps], []
        for side, letters in ((0, part), (1, part[::-1])):
            state, states = np.zeros(units), []
            for b in letters:
                given, kept = reader.inputs[side][:, b], reader.recurrent[side] @ state
                z, r = sigmoid(given[:units] + kept[:units]), sigmoid(given[units:2 * units] + kept[units:2 * units])
                n = np.tanh(given[2 * units:] + r * kept[2 * units:])
                state = (1 - z) * n + z * state
                states.append(state)
            sides.append(states if side == 0 else states[::-1])
        for f, b in zip(*sides):
            e = np.exp(reader.readout @ np.concatenate([f, b]) + reader.bias[:, 0])
            total += e / e.sum()
    return total / max(1, len(text))


@pytest.fixture(scope="module")
def reader():
    rng = random.Random(1)
    texts = [(" ".join(rng.choice(w) for _ in range(12)), k) for k, w in
             (("aa", ["the", "and", "thing"]), ("bb", ["der", "und", "schön"])) for _ in range(60)]
    return language_id.train_reader([t.encode() for t, _ in texts], [k for _, k in texts], updates=80)


def test_matrix_labels_equal_single_steps(reader):
    texts = ["the und thing", "", None, "schön " * 40, "a", "x" * 64, "y" * 65]
    array = pa.array([None if t is None else t.encode() for t in ["skip", *texts]], type=pa.binary()).slice(1)
    got = reader.documents(array)
    for t, row in zip(texts, got):
        np.testing.assert_allclose(row, slow_label(reader, (t or "").encode()), atol=2e-4)


def test_gradients_of_backpropagation():
    rng = np.random.default_rng(0)
    trainer = language_id._Trainer(2, 3, rng)
    trainer.weights = {k: v.astype(np.float64) for k, v in trainer.weights.items()}
    letters, labels = rng.integers(0, 5, (6, 4)), np.array([0, 1, 1, 0])

    def loss(weights):
        copy = language_id._Trainer(2, 3, np.random.default_rng(0))
        copy.weights = {k: v.copy() for k, v in weights.items()}
        return copy.step(letters, labels, 0.0)

    seen = {}
    trainer.moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in trainer.weights.items()}
    trainer.step(letters, labels, 0.0)
    for name, (m, _) in trainer.moments.items():
        seen[name] = m / 0.1
    for name, place in [("inputs", (0, 1, 2)), ("inputs", (1, 7, 3)), ("recurrent", (0, 4, 1)), ("recurrent", (1, 8, 2)),
                        ("readout", (1, 4)), ("bias", (0, 0))]:
        ends = []
        for d in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in trainer.weights.items()}
            moved[name][place] += d
            ends.append(loss(moved))
        assert abs((ends[0] - ends[1]) / 2e-4 - seen[name][place]) < 2e-3, (name, place)


def test_language_rows(spark, reader):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "the thing and the"), (4, "the thing and the"), (None, "und der schön"), (5, "der und " * 20_000)]
    docs = frame(spark, rows)
    got = language_id.predict_language(docs, reader)
    assert [c for c in got.columns if c.lower() == "score"] == ["score"]
    by_id = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert [by_id[1, None]["lang_pred"], by_id[2, ""]["lang_pred"], by_id[3, "12 34 !?"]["lang_pred"]] == ["und"] * 3
    assert by_id[1, None]["score"] == 0 and by_id[4, "the thing and the"]["lang_pred"] == "aa"
    assert by_id[None, "und der schön"]["lang_pred"] == by_id[5, "der und " * 20_000]["lang_pred"] == "bb"
    assert language_id.predict_language(docs.limit(0), reader).count() == 0
    assert {r["lang_pred"] for r in language_id.predict_language(docs, None).collect()} == {"und"}


def test_training_sample_has_rare_languages_and_stays_bounded(spark):
    rows = [(i, "the thing and the", "aa") for i in range(3000)] + [(7000, "der und schön", "rare")]
    rows += [(i, "copied words", "bb") for i in (8000, 8001) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, labels = language_id.training_windows(docs, sample_docs=30, windows=1)
    assert {k: labels.count(k) for k in labels} == {"aa": 10, "bb": 2, "rare": 1}
    assert language_id.training_windows(docs.limit(0)) == ([], [])


def test_held_out_languages(spark):
    from ebbline.llm import queries

    got = queries.op8_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


# ── toxicity ─────────────────────────────────────────────────────────────────

def distance(a, b):
    """Optimal string alignment: edits and swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def brute_kind(word, terms, fuzzy_from):
    found = []
    for t in terms:
        allowed = 1 if len(t.text) >= fuzzy_from and not t.stem else 0
        spent = 2 * (not word.startswith(t.text)) if t.stem else distance(t.text, word)
        if spent <= allowed:
            found.append((spent == 0, t.weight, 2 if t.stem else spent))
    return max(found)[:0:-1] if found else None


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    for _ in range(60):
        terms = [toxicity.Term("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))), rng.random() < 0.3, rng.randint(1, 9)) for _ in range(4)]
        automaton = toxicity.LexiconAutomaton(terms, fuzzy_from=4)
        for _ in range(60):
            word = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
            assert automaton.match(word) == brute_kind(word, terms, 4), (terms, word)


def test_quotation_and_context():
    finder = toxicity.HitFinder([toxicity.Term("idiot")])
    hits = lambda t: [(h[2], *h[4:]) for h in finder.hits(t.encode())]
    assert hits("You IDIOT") == [(0, False, False, True)]
    assert hits('He said "what an idoit" then') == [(1, True, True, False)]
    assert hits("“idiot”\n idiots") == [(0, True, False, False), (1, False, False, False)]
    assert hits('"open idiot\nclosed"') == [(0, False, False, False)]
    assert finder.features(None) == finder.features(b"nothing here") and not any(finder.features(b""))


def test_terms_cover_and_copies_add_none():
    toxic = [{"grumble", f"word{i}"} for i in range(10)] + [{"grumble", "copied", "once"}] * 50
    toxic += [{f"vexo{e}", "x"} for e in ("ling", "ment", "rad", "tor")]
    clean = [{f"word{i}", "nice"} for i in range(200)]
    learned = [(t.text, t.stem) for t in toxicity.learn_terms(toxic, clean) if t.text not in toxicity.BASE_TERMS]
    assert learned == [("grumble", False), ("vexo", True)]


def test_toxicity_rows(spark):
    rng = random.Random(9)
    plain = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(120)]
    rows = [(i, t + (" you zorkish" if i % 3 == 0 else "")) for i, t in enumerate(plain)]
    odd = [(None, "zorkish"), (500, None), (501, ""), (502, "zorksih you " + "alpha " * 50_000), (502, "alpha"), (502, "alpha")]
    docs = frame(spark, rows + odd)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(3, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert "zorkish" in {t.text for t in model.terms}
    got = toxicity.score_toxicity(docs, model)
    assert [c.lower() for c in got.columns].count("predicted") == 1
    found = got.collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    by_id = {(r["doc_id"], r["text"]): r["predicted"] for r in found}
    assert all(by_id[i, t] == (i % 3 == 0) for i, t in rows)
    assert by_id[None, "zorkish"] == 1 and by_id[500, None] == by_id[501, ""] == by_id[502, "alpha"] == 0
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        constant = toxicity.fit_toxicity(docs, few, F.lit(True))
        assert all(r["score"] < 0.01 for r in toxicity.score_toxicity(docs, constant).collect())


def test_held_out_toxicity(spark):
    from ebbline.llm import queries

    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = got.join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in both}
    assert n.get((1, 1), 0) >= 0.85 * sum(c for (t, _), c in n.items() if t == 1)
    assert n.get((0, 1), 0) <= 0.01 * sum(c for (t, _), c in n.items() if t == 0)


def test_held_out_quality(spark):
    from ebbline.llm import queries

    got = queries.op3_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    joined = got.join(labels, "doc_id").where("held_out")
    right = joined.agg(F.avg((F.col("selected") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95
    assert got.where(F.col("held_out") != (remainder("doc_id", 5) == 0)).count() == 0
