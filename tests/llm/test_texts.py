"""Decontamination, packing, chat formatting and sharding."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import chat, contamination, packing, sharding
from ebbline.llm.queries import packing_tokenizer

DOCS = "doc_id long, text string, n_words string, shard int, Slot string"


# ── decontamination ──────────────────────────────────────────────────────────

def words(rng, n, letters="abc"):
    return " ".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("window", [1, 3, 5, 13])
def test_automaton_equals_comparing_all_windows(window):
    rng = random.Random(window)
    for _ in range(150):
        items = [(str(i), words(rng, rng.randint(0, 9))) for i in range(rng.randint(0, 6))]
        text = words(rng, rng.randint(0, 40))
        automaton = contamination.SuffixAutomaton.build(
            [(i, contamination.word_bytes(t.encode())) for i, t in items], window)
        spans, found = automaton.hits(contamination.word_bytes(text.encode()))
        expected = contamination.reference_hits(text, items, window)
        assert sum(b - a + 1 for a, b in spans) == expected["n_hit"]
        assert hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() == expected["items_sha256"]
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_longest_matches():
    automaton = contamination.SuffixAutomaton.build([("1", [b"a", b"b", b"c"]), ("2", [b"b", b"d"])], 2)
    assert [m for _, _, m in automaton.walk([b"x", b"a", b"b", b"d", b"c", b"b", b"c"])] == [0, 1, 2, 2, 1, 1, 2]


@pytest.mark.parametrize("block_words", [16, 100_000])
def test_documents_against_brute_force(spark, block_words):
    rng = random.Random(1)
    items = [(i, words(rng, rng.randint(1, 30), "abcdefghij")) for i in range(12)] + [(50, None), (51, ""), (52, " , ")]
    items += [(60, items[0][1]), (None, "j i h g f e d"), (None, "i")]
    rows = [(1, None), (2, ""), (3, "!!"), (4, items[3][1].upper()), (4, items[3][1].upper()), (None, "a b")]
    rows += [(10 + i, words(rng, rng.randint(1, 300), "abcdefghij") + " " + items[rng.randrange(12)][1] if i % 3 else "q " * 5000)
             for i in range(12) if items[i][1]]
    rows = [(i, t, "clash", 1, "x") for i, t in rows]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = contamination.decontaminate(docs, bench, window=5, block_words=block_words).withColumn(
        "sha", contamination.items_digest("hit_items")).collect()
    assert len(got) == len(rows)
    known = {t: i for i, t, *_ in rows}
    assert len(known)
    named = [(str(i), t or "") for i, t in items]
    for r in got:
        e = contamination.reference_hits(r["text"], named, 5)
        with_id = contamination.reference_hits(r["text"], [x for x in named if x[0] != "None"], 5)
        e |= {k: with_id[k] for k in ("n_items", "items_sha256")}
        assert (r["n_words"], r["n_hit"], len(r["hit_items"]), r["sha"]) == (
            e["n_words"], e["n_hit"], e["n_items"], e["items_sha256"])
        assert r["contaminated"] == (e["n_hit"] > 0 and 20 * e["n_hit"] >= e["n_words"])
        if not e["n_hit"]:
            assert r["clean_text"] == r["text"]
    assert contamination.decontaminate(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in contamination.decontaminate(docs, bench.limit(0)).collect())


def test_long_spans_are_cut():
    text = "Before, one TWO three four; after!".encode()
    assert contamination.cut_spans(text, [(1, 4)], 3) == b"Before, ; after!"
    assert contamination.cut_spans(text, [(1, 4)], 4) == text


# ── packing ──────────────────────────────────────────────────────────────────

def test_window_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 12))]
        windows = packing.pack_lengths(lengths, 40)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
        first = [lengths[i] for i in windows[0]]
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums if s + n + max(lengths) <= 40}
        assert first[0] == max(lengths) and sum(first) == max(lengths) + max(sums)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing_tokenizer())


ODD = ["", "Hello, World!", "it's we're <|endoftext|> a<|startoftext|>b", "A1b2 3.14.", "É́ é ÀB, ", "İstanbul ΣΑΣ",
       "x y z\x1cq", "“quoted”...", "ﬁ ½ ①", "日本語。テスト", "a\tb\nc\r\nd  e", "<|STARTOFTEXT|>.", "don't.!?", "....", "𝔘𝔫", "́a"]


def test_ids_equal_the_tokenizer():
    plain, own = tokenizer(), packing.WordTokenizer(packing_tokenizer(), memo_words=50)
    rng = random.Random(3)
    mixed = [" ".join(rng.choice(ODD + ["the", "The", "the,", "naïve", "NAÏVE;"]) for _ in range(60)) for _ in range(30)]
    for text in ODD + mixed:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want, text


def test_long_texts_are_read_in_segments(monkeypatch):
    text = " ".join(f"word{i % 91}, {'x' * (i % 7)}" for i in range(2000))
    whole = packing.WordTokenizer(packing_tokenizer()).encode(text)
    monkeypatch.setattr(packing, "_SEGMENT", 50)
    assert packing.WordTokenizer(packing_tokenizer()).encode(text) == whole


def test_pieces_give_back_every_document(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (4, "long " * 9000)]
    rows += [(10 + i, words(rng, rng.randint(1, 700), ["alpha", "beta", "gamma,", "Δ"])) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "c", 1, "s") for i, t in rows], DOCS)
    got = packing.pack_documents(docs.repartition(3), packing_tokenizer(), capacity=512, pool_tokens=4000).collect()
    plain = tokenizer()
    wanted = collections.Counter()
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 512):
            wanted[i, s, np.array(ids[s:s + 512], dtype="<u4").tobytes(), len(ids)] += 1
    assert wanted == collections.Counter((r["doc_id"], r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got)
    by_sequence = collections.defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) // 4
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    need = sum(len(k[2]) // 4 * n for k, n in wanted.items()) / 512
    assert len(by_sequence) <= need + 2 * 3
    assert packing.pack_documents(docs.limit(0), packing_tokenizer()).count() == 0


# ── chat formatting ──────────────────────────────────────────────────────────

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[ROLE x]", "[/ROLE]", " ", "\n", "a", "<", "s>", "[", "]", "[SYS]", "é", ""]


def random_turns(rng):
    return [
        (rng.choice(["user", "assistant", "system", "tool", "", "we]ird\\[ROLE"]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))))
        for _ in range(rng.randint(1, 40))
    ]


def test_round_trip_and_spans():
    rng = random.Random(1)
    for _ in range(400):
        turns = random_turns(rng)
        full = chat.instruct_template(turns)
        assert chat.read_back(full) == turns
        formatter = chat.IncrementalFormatter(chat.instruct_template, 4, 200)
        spans = [formatter.add(*t) for t in turns]
        assert "".join(s.formatted for s in spans) == full
        for s, (role, text) in zip(spans, turns):
            assert not s.rewrites and chat.unescape(full[s.text_start:s.text_stop]) == text
        assert len(formatter.turns) <= 6


def test_rewriting_templates_are_detected():
    def last_only(turns):  # keeps reasoning in the last turn only
        return "".join(f"{r}: {t if i == len(turns) - 1 else t.split('|')[-1]}\n" for i, (r, t) in enumerate(turns))

    formatter = chat.IncrementalFormatter(last_only)
    spans = [formatter.add(*t) for t in [("user", "hi"), ("assistant", "think|yes"), ("user", "ok"), ("assistant", "no")]]
    assert [s.rewrites for s in spans] == [False, False, True, False]
    assert spans[2].shared == len("user: hi\nassistant: ") and spans[2].text_start is None
    rebuilt = ""
    for s in spans:
        rebuilt = rebuilt[:s.shared if s.rewrites else len(rebuilt)] + s.formatted
    assert rebuilt == last_only([("user", "hi"), ("assistant", "think|yes"), ("user", "ok"), ("assistant", "no")])


def test_template_that_looks_far_back_keeps_its_context():
    def numbered(turns):
        return "".join(f"{i}/{r}:{t};" for i, (r, t) in enumerate(turns))

    formatter = chat.IncrementalFormatter(numbered, context_turns=3)
    turns = [("user", f"t{i}") for i in range(30)]
    assert "".join(formatter.add(*t).formatted for t in turns) == numbered(turns)


def follow(template, turns):
    """Spans, and the text that they build up, checked against every full prefix."""
    formatter, text, spans = chat.IncrementalFormatter(template), "", []
    for i, turn in enumerate(turns):
        s = formatter.add(*turn)
        before, full = text, template(turns[:i + 1])
        text = text[:s.shared if s.rewrites else len(text)] + s.formatted
        assert text == full and s.rewrites == (not full.startswith(before)), i
        assert s.start == s.shared == len(os.path.commonprefix([before, full])), i
        spans.append(s)
    return spans


def test_templates_that_drop_or_move_turns_late_are_followed():
    def last_twenty(turns):
        return "".join(f"{r}: {t}\n" for r, t in turns[-20:])

    def system_first(turns):
        return "".join(f"<{r}>{t}" for r, t in sorted(turns, key=lambda t: t[0] != "system"))

    turns = [("user" if i % 2 else "assistant", f"t{i}") for i in range(50)]
    assert [s.rewrites for s in follow(last_twenty, turns)] == [i >= 20 for i in range(50)]
    turns[30] = ("system", "late")
    spans = follow(system_first, turns)
    assert [s.position for s in spans if s.rewrites] == [30] and spans[30].shared == 1


def test_wrongly_declared_template_is_an_error():
    @chat.local
    def numbered(turns):
        return "".join(f"{i}/{r}:{t};" for i, (r, t) in enumerate(turns))

    formatter = chat.IncrementalFormatter(numbered, context_turns=3)
    with pytest.raises(ValueError, match="declared local"):
        for i in range(5):
            formatter.add("user", f"t{i}")


def test_conversation_rows(spark):
    rows = [
        (1, 1, "assistant", "b <s>"), (1, 0, "user", None), (1, 2, None, "x"), (None, 0, "user", "n"), (2, None, "assistant", ""),
        (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 0, "assistant", "z"), (4, 0, "assistant", "long " * 50_000),
    ] + [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(120)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    formatted = chat.format_conversations(turns)
    assert formatted.count() == len(rows)
    got = {r["conv_id"]: r for r in chat.digest_conversations(formatted).collect()}
    by_conv = collections.defaultdict(list)
    for c, n, r, t in rows:
        by_conv[c].append((-1 if n is None else n, r or "", t or ""))
    assert got.keys() == by_conv.keys()
    for c, own in by_conv.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.instruct_template([(r, t) for _, r, t in own]))
    assert chat.digest_conversations(chat.format_conversations(turns.limit(0))).count() == 0


# ── sharding ─────────────────────────────────────────────────────────────────

def test_hypergeometric_draws_have_the_right_distribution():
    rng, n = np.random.default_rng(1), 20_000
    for good, bad, sample in [(3, 5, 4), (50, 70, 30), (1, 1, 1), (0, 4, 2), (4, 0, 2), (1000, 20, 900)]:
        own = np.array([sharding.draw_hypergeometric(rng, good, bad, sample) for _ in range(n)])
        other = rng.hypergeometric(good, bad, sample, n)
        assert own.min() >= max(0, sample - bad) and own.max() <= min(good, sample)
        assert abs(own.mean() - other.mean()) < 0.05 * max(1, other.std())
        assert abs(own.std() - other.std()) < 0.05 * max(1, other.std())
    huge = [sharding.draw_hypergeometric(rng, 20_000_000_000, 10_000_000_000, 3_000_000) for _ in range(5)]
    assert all(abs(h - 2_000_000) < 10_000 for h in huge)


def test_matrix_rows_fit_together():
    counts, sizes = [7, 0, 12, 5, 9], np.array([11, 11, 11])
    matrix = np.array([sharding.matrix_row(counts, sizes, p, 3) for p in range(5)])
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == sizes.tolist()
    assert (matrix >= 0).all()


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_shards_are_exact_and_keep_every_row(spark, block_rows):
    rows = [(i, f"text {i}") for i in range(101)] + [(None, None), (5, "text 5"), (7, ""), (8, "l" * 200_000)]
    docs = spark.createDataFrame([(i, t, "c", 9, "clash") for i, t in rows], DOCS).repartition(5)
    placed = sharding.shuffle_into_shards(docs, 7, block_rows=block_rows)
    assert placed.columns == ["doc_id", "text", "n_words", "shard", "slot"]
    got = placed.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffle_into_shards(docs.limit(0), 7).count() == 0
    few = sharding.shuffle_into_shards(docs.limit(3), 7).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_the_shuffle_is_uniform(spark):
    docs = spark.range(0, 40, numPartitions=4).select(F.col("id").alias("doc_id"))
    together, rounds = 0, 60
    for seed in range(rounds):
        shards = {r["doc_id"]: r["shard"] for r in sharding.shuffle_into_shards(docs, 4, seed=seed, staged=False).collect()}
        together += sum(shards[i] == shards[i + 1] for i in range(0, 40, 2))
    share = together / (20 * rounds)  # 9 of the 39 others share a row's shard
    assert abs(share - 9 / 39) < 0.05


def test_digest_columns(spark):
    from ebbline.llm import queries

    got = queries.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_a_small_memory_changes_no_id_and_only_one_is_kept():
    path = packing_tokenizer()
    texts = [" ".join(f"Wort{i % 37}, tail{i * j}." for j in range(40)) for i in range(50)]
    small = packing.tokenizer_for(path, 20)
    got = [small.encode(t) for t in texts]
    assert len(small.runs.new) <= 20 + 80
    whole = packing.tokenizer_for(path)
    assert got == [whole.encode(t) for t in texts] and list(packing._TOKENIZERS) == [(path, packing.MEMO_WORDS)]
