"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of all benchmark items and accepts exactly their
runs of words. Training words are streamed through it once; after each word it knows
the longest run ending there that some item holds. A run of `window` words or more
marks its words as hit, an item shorter than the window counts as one window of its own
length. Spans of hit words are removed where they are longer than `max_span`, and a
document is rejected where hits cover more than `coverage` of it.

Items are cut into blocks of about `block_words` words at most (a longer item into pieces
that overlap by a window less one word), so that an automaton has a bounded size whatever
the benchmark's. Up to PASS_BLOCKS blocks are sent to the tasks for one pass over the
documents; a larger benchmark takes further passes, between which the documents and their
hits so far are written to the shared folder. So the driver and a task never hold more than
PASS_BLOCKS blocks, and each automaton is built once per task. The usual benchmark is one
block and one pass.

Defined results: a null or empty text has no words, is never hit and is returned as it
is. Items without words are ignored, items of equal text all count. Null item ids are
left out of the id list. Repeated rows stay. An empty benchmark hits nothing. Input
columns named like result columns give way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import replace_columns, stage, utf8, word_bytes

WINDOW = 13
BLOCK_WORDS = 100_000
PASS_BLOCKS = 4
NO_ID = "\0"  # stands for a null item id, whose windows count but whose id is not listed

_WORD_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"


@dataclass
class SuffixAutomaton:
    """States of a generalised suffix automaton over words.

    `follow[s]` maps a word to the next state, `link[s]` is the suffix link and
    `length[s]` the longest run of state s. `windows[s]` has the items that hold the
    run of exactly `window` words belonging to s. `short[s]` lists, for s and the
    states it links to, `(length, item)` of whole items below the window length.
    """

    window: int = WINDOW
    follow: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    windows: list[tuple[str, ...] | None] = field(default_factory=list)
    short: list[tuple[tuple[int, str], ...] | None] = field(default_factory=list)

    def _copy(self, state: int, length: int) -> int:
        self.follow.append(dict(self.follow[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.follow) - 1

    def _redirect(self, start: int, word: bytes, old: int, new: int) -> None:
        while start >= 0 and self.follow[start].get(word) == old:
            self.follow[start][word] = new
            start = self.link[start]

    def _append(self, last: int, word: bytes) -> int:
        """The state of the run `last + word`, added where it is new."""
        target = self.follow[last].get(word)
        if target is not None:
            if self.length[target] == self.length[last] + 1:
                return target
            clone = self._copy(target, self.length[last] + 1)
            self.link[target] = clone
            self._redirect(last, word, target, clone)
            return clone
        self.follow.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = len(self.follow) - 1
        at = last
        while at >= 0 and word not in self.follow[at]:
            self.follow[at][word] = state
            at = self.link[at]
        if at >= 0:
            target = self.follow[at][word]
            if self.length[target] == self.length[at] + 1:
                self.link[state] = target
            else:
                clone = self._copy(target, self.length[at] + 1)
                self.link[target] = self.link[state] = clone
                self._redirect(at, word, target, clone)
        return state

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match) after each word."""
        state = matched = 0
        for i, word in enumerate(words):
            target = self.follow[state].get(word)
            while target is None and state:
                state = self.link[state]
                matched = self.length[state]
                target = self.follow[state].get(word)
            if target is None:
                matched = 0
            else:
                state, matched = target, matched + 1
            yield i, state, matched

    def _window_state(self, state: int) -> int:
        """The state that holds the last `window` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
        self = cls(window)
        for _, words in items:
            last = 0
            for word in words:
                last = self._append(last, word)
        held: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str]]] = {}
        for item, words in items:
            for i, state, matched in self.walk(words):
                if matched >= window:
                    held.setdefault(self._window_state(state), set()).add(item)
                if i == len(words) - 1 < window - 1:
                    whole.setdefault(state, set()).add((matched, item))
        n = len(self.follow)
        self.windows = [tuple(sorted(held[s])) if s in held else None for s in range(n)]
        self.short = [None] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            own = tuple(sorted(whole[s])) if s in whole else ()
            self.short[s] = (self.short[self.link[s]] or ()) + own or None
        return self

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal spans (first, last) of hit words, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        follow, link, length, window, short = (
            self.follow, self.link, self.length, self.window, self.short)

        def mark(first: int, last: int) -> None:
            while spans and spans[-1][1] >= first - 1:
                first = min(first, spans.pop()[0])
            spans.append((first, last))

        state = matched = 0
        edges = follow[0]
        for i, word in enumerate(words):
            target = edges.get(word)
            if target is None:
                while target is None and state:
                    state = link[state]
                    matched = length[state]
                    target = follow[state].get(word)
                if target is None:
                    edges = follow[0]
                    continue
            state = target
            matched += 1
            edges = follow[state]
            if matched >= window:
                mark(i - matched + 1, i)
                items.update(self.windows[self._window_state(state)] or ())
            if short[state]:
                for n, item in short[state]:
                    if n <= matched:
                        mark(i - n + 1, i)
                        items.add(item)
        return spans, items


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _send(block: DataFrame) -> Broadcast:
    """The items of one block, of about `block_words` words at most, for all tasks."""
    return block.sparkSession.sparkContext.broadcast([
        (NO_ID if r["item"] is None else r["item"], bytes(r["text"]).split()) for r in block.collect()])


def _hit_column(text: str, earlier: str, blocks: list[Broadcast], window: int) -> Column:
    """An Arrow function that unites the hits of these blocks with those of earlier ones."""

    @F.arrow_udf(HITS)
    def compute(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        automata = [SuffixAutomaton.build(b.value, window) for b in blocks]
        kind = pa.struct([
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            ("items", pa.list_(pa.string())),
        ])
        for texts, before in batches:
            rows = []
            for t, known in zip(texts, before.to_pylist()):
                words = word_bytes(t.as_py() or b"")
                spans = [(s["first"], s["last"]) for s in known["spans"]] if known else []
                items = set(known["items"]) if known else set()
                for automaton in automata:
                    more, named = automaton.hits(words)
                    spans.extend(more)
                    items.update(named)
                rows.append({
                    "n_words": len(words),
                    "spans": [{"first": a, "last": z} for a, z in join_spans(spans)],
                    "items": sorted(items - {NO_ID}),
                })
            yield pa.array(rows, type=kind)

    return compute.asNondeterministic()(utf8(text), F.col(earlier)).alias("hits")


def _item_blocks(benchmark: DataFrame, window: int, block_words: int) -> list[DataFrame]:
    """Blocks of `item, text` rows with at most about `block_words` words each.

    Long items are cut inside the tasks. The number of blocks follows from the total;
    a hash of the piece spreads them, with headroom for the spread.
    """

    @F.arrow_udf("array<binary>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = max(1, block_words // 8)
        for texts in batches:
            out = []
            for t in texts:
                words = word_bytes(t.as_py() or b"")
                starts = range(0, max(1, len(words) - window + 1), step)
                out.append([b" ".join(words[s:s + step + window - 1]) for s in starts] if words else [])
            yield pa.array(out, type=pa.list_(pa.binary()))

    pieces = stage(
        benchmark.select(
            F.col("item_id").cast("string").alias("item"),
            F.posexplode(cut(utf8("text"))).alias("piece", "text"),
        ).withColumn("n", F.size(F.split(F.decode("text", "utf-8"), " "))),
        "benchmark-items")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // block_words))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    if count > 1:  # each block reads its own files
        placed = stage(placed, "benchmark-blocks", ["block"])
    return [placed.where(F.col("block") == b).select("item", "text").distinct() for b in range(count)]


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add n_words, n_hit, hit_spans (word positions) and hit_items to each document."""
    blocks = _item_blocks(benchmark, window, block_words)
    named = replace_columns(docs, {"_hits": F.lit(None).cast(HITS)})
    sent: list[Broadcast] = []
    for at in range(0, len(blocks), PASS_BLOCKS):
        if sent:
            named = stage(named, "hits")
            for block in sent:
                block.destroy()
        sent = [_send(block) for block in blocks[at:at + PASS_BLOCKS]]
        named = replace_columns(named, {"_hits": _hit_column(text, "_hits", sent, window)})
    return replace_columns(named, {
        "n_words": F.col("_hits.n_words"),
        "n_hit": F.aggregate(
            "_hits.spans", F.lit(0).cast("long"),
            lambda acc, s: acc + s["last"] - s["first"] + F.lit(1)),
        "hit_spans": F.col("_hits.spans"),
        "hit_items": F.col("_hits.items"),
    }).drop("_hits")


def cut_spans(text: bytes, spans: list[tuple[int, int]], max_span: int) -> bytes:
    """The text without its hit spans of more than `max_span` words."""
    at = [m.span() for m in _WORD_SPANS.finditer(text)]
    out, start = [], 0
    for first, last in spans:
        if last - first + 1 > max_span:
            out.append(text[start:at[first][0]])
            start = at[last][1]
    return b"".join([*out, text[start:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
    coverage: tuple[int, int] = (1, 20), max_span: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """find_hits() plus `contaminated` and `clean_text`.

    A document is contaminated if it has hits and they cover at least `coverage` (a
    fraction) of its words. `clean_text` lacks all spans of more than `max_span` words
    (window - 1 unless given); null stays null.
    """
    limit = window - 1 if max_span is None else max_span

    @F.arrow_udf("string")
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield pa.array([
                None if t is None
                else t.decode("utf-8", "replace") if not s
                else cut_spans(t, [(x["first"], x["last"]) for x in s], limit).decode("utf-8", "replace")
                for t, s in zip(texts.to_pylist(), spans.to_pylist())
            ], type=pa.string())

    found = find_hits(docs, benchmark, text, window, block_words)
    part, whole = coverage
    return replace_columns(found, {
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * whole >= F.col("n_words") * part),
        "clean_text": cleaned.asNondeterministic()(utf8(text), F.col("hit_spans")),
    })


def items_digest(items: str) -> Column:
    """Hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)


def reference_hits(text: str | None, items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """The same figures for one text by comparing all windows; for tests."""
    words = word_bytes((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = word_bytes(body.encode())
        n = min(window, len(own))
        wanted = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(item)
    return {
        "n_words": len(words), "n_hit": len(hit), "n_items": len(found),
        "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
    }
