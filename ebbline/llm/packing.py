"""Packing token sequences by minimum bin slack.

Documents are tokenised and cut into pieces: full windows as long as they last, then the
rest. For each window the longest waiting piece is taken and a subset-sum dynamic program
over the other waiting lengths finds the multiset that comes closest to capacity: the
reachable sums are one big integer, a length with its count enters as shifted copies in
powers of two, and the program stops as soon as the window can be filled without slack.
Backtracking over the recorded steps gives the count of each length. Pieces wait in a
pool of `pool_tokens` tokens, which is refilled before it runs dry, so only the last
windows of a partition can have slack.

Nothing is shuffled: each partition packs its own rows, and the memory of a task is the
pool and one document. Sequence ids combine the partition with a counter; offsets in a
sequence are gapless. A lost task packs the same rows in the same order again.

Defined results: a null or empty text is a document of just the end id. Repeated rows and
null ids are packed like any other. An empty table gives an empty result. Columns besides
id and text are not carried.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import utf8

CAPACITY = 4096
END_ID = 2
POOL_TOKENS = 4_000_000
MEMO_WORDS = 300_000  # runs in a generation of a tokenizer's memory, two of which are kept
LONGEST_RUN = 64      # letters of a run that is remembered
_SEGMENT = 1 << 20
_TRAILING = ".,;:!?"
#: str.split() cuts at these control characters too, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[ \t\n\r]")
_SIGMAS = frozenset("\u03a3\u03c3\u03c2")
#: Byte-level models write a byte as itself where it is printable and not a blank, else
#: as the next free code point from 256.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class Memory:
    """Two generations of remembered ids: what the newer one lacks is taken over from the
    older one, and a full newer one takes the older one's place."""

    def __init__(self, entries: int) -> None:
        self.entries = entries
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def make_room(self, entries: int) -> None:
        if len(self.new) + entries > self.entries:
            self.old, self.new = self.new, {"": b""}


#: What WordTokenizer relies on; fixed values of the tokenizer file.
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizer file normalises and splits the way WordTokenizer knows."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normal, split = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    steps = split.get("pretokenizers", [])
    return (
        kinds == KNOWN_NORMALIZERS and [p["type"] for p in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"].get("Regex") == KNOWN_SPLIT and not steps[1]["add_prefix_space"]
        and rules["model"]["type"] == "BPE" and rules.get("post_processor") is None)


class WordTokenizer:
    """Token ids of texts, as bytes (unsigned 32-bit, little-endian).

    For a tokenizer of the known rules nothing merges across white space, and trailing
    punctuation after a letter is a run of its own: the ids of runs are remembered, so a
    text is mostly a join of known runs. The memory is bounded by `memo_words` runs of at
    most LONGEST_RUN letters in each of two generations. Any other tokenizer gets whole
    texts.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.by_runs = splits_at_blanks(path)
        self.runs, self.cores = Memory(memo_words), Memory(memo_words // 2)

    @staticmethod
    def _parts(run: str) -> tuple[str, str]:
        """A run and its trailing punctuation, apart where the tokenizer splits them: after
        what is still a letter when normalised (a dotted capital I leaves a mark)."""
        core = run.rstrip(_TRAILING)
        if core and core.isascii() and core.isalpha():
            return core.lower(), run[len(core):]
        if core and core.isalpha() and unicodedata.normalize("NFC", core).lower().isalpha():
            return core, run[len(core):]
        return run, ""

    def _core_ids(self, core: str) -> list[int]:
        """Ids of one run. Letters need no splitting and go to the model directly."""
        if core.isalpha():
            small = core if core.isascii() else unicodedata.normalize("NFC", core).lower()
            # Lower-casing can leave marks (a dotted I), and the capital sigma depends on
            # its neighbours: these take the whole way below.
            if small.isascii() or small.isalpha() and not _SIGMAS.intersection(small):
                letters = small.encode().decode("latin-1").translate(_BYTE_LETTERS)
                return [t.id for t in self.inner.model.tokenize(letters)]
        return self.inner.encode(core, add_special_tokens=False).ids

    def _core(self, core: str) -> bytes:
        """Ids of a run that the newer generation lacks."""
        known = self.cores.old.get(core)
        if known is None:
            known = array("I", self._core_ids(core)).tobytes()
        if len(core) <= LONGEST_RUN:
            self.cores.new[core] = known
        return known

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of runs that the newer generation lacks, which takes them over."""
        self.cores.make_room(2 * len(runs))
        cores, before, parts, found = self.cores.new, self.runs.old, self._parts, {}
        for run in runs:
            ids = before.get(run)
            if ids is None:
                core, tail = parts(run)
                ids = cores.get(core)
                if ids is None:
                    ids = self._core(core)
                if tail:
                    rest = cores.get(tail)
                    ids += self._core(tail) if rest is None else rest
            found[run] = ids
        self.runs.make_room(len(found))
        self.runs.new.update(found)
        return found

    def _segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > _SEGMENT:
            stop = text.find(" ", start + _SEGMENT)
            if stop < 0:
                break
            yield text[start:stop]
            start = stop + 1
        yield text[start:]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.by_runs:
            return array("I", self.inner.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for segment in self._segments(text):
            runs = _BLANKS.split(segment) if _SEPARATORS.search(segment) else segment.split()
            known = self.runs.new
            unknown = set(runs).difference(known)
            if not unknown:
                out.append(b"".join(map(known.__getitem__, runs)))
                continue
            found = self._learn(unknown)
            if self.runs.new is not known:  # what was known is the older generation now
                found |= {r: known[r] for r in set(runs) - unknown}
                out.append(b"".join(map(found.__getitem__, runs)))
            else:
                out.append(b"".join(map(known.__getitem__, runs)))
            for run in unknown:
                if len(run) > LONGEST_RUN:
                    del self.runs.new[run]
        return b"".join(out)


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer_for(path: str, memo_words: int = MEMO_WORDS) -> WordTokenizer:
    """One tokenizer for each worker process, so that tasks share what it remembers.

    A worker keeps the one it used last: another file or bound takes its place.
    """
    if (path, memo_words) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path, memo_words] = WordTokenizer(path, memo_words)
    return _TOKENIZERS[path, memo_words]


class SlackPool:
    """Waiting lengths, and the choice of the next window's content."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.present = 0  # bit l: some piece of length l waits
        self.tokens = 0

    def add(self, length: int, piece: int) -> None:
        self.waiting[length].append(piece)
        self.present |= 1 << length
        self.tokens += length

    def _take(self, length: int, count: int) -> list[int]:
        stack = self.waiting[length]
        taken = [stack.pop() for _ in range(count)]
        if not stack:
            self.present &= ~(1 << length)
        self.tokens -= length * count
        return taken

    def next_window(self) -> list[int]:
        """Pieces of the next window: the longest one and the least slack beside it."""
        first = self.present.bit_length() - 1
        pieces = self._take(first, 1)
        room = self.capacity - first
        mask = (1 << (room + 1)) - 1
        reach, steps, left = 1, [], self.present & mask
        while left and not reach >> room & 1:
            length = left.bit_length() - 1
            left ^= 1 << length
            count = min(len(self.waiting[length]), room // length)
            chunk = 1
            while count and not reach >> room & 1:
                chunk = min(chunk, count)
                steps.append((reach, length, chunk))
                reach |= reach << (length * chunk) & mask
                count -= chunk
                chunk *= 2
        total = reach.bit_length() - 1
        for before, length, chunk in reversed(steps):
            if not before >> total & 1:
                pieces += self._take(length, chunk)
                total -= length * chunk
        return pieces


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of piece numbers for a list of lengths from 1 to capacity."""
    pool = SlackPool(capacity)
    for i, n in enumerate(lengths):
        pool.add(n, i)
    windows = []
    while pool.present:
        windows.append(pool.next_window())
    return windows


class _Writer:
    """Turns windows into record batches of pieces."""

    def __init__(self, schema: pa.Schema, first_sequence: int) -> None:
        self.schema, self.sequence = schema, first_sequence
        self.rows: list[tuple] = []

    def window(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((key, start, n, ids, total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS,
    memo_words: int = MEMO_WORDS,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Columns: the id, `start` (ids of the document before the piece), `length`, `ids`
    (unsigned 32-bit little-endian), `doc_tokens`, `sequence_id` and `offset`.
    `tokenizer` is the path of a tokenizer file that exists on every executor. A worker
    remembers up to `memo_words` runs in each of two generations; fewer cost time, no result.
    """
    source = docs.select(F.col(id_column).alias("_id"), utf8(text).alias("_text"))
    kind = source.schema["_id"].dataType
    names = [(id_column, kind), ("start", T.LongType()), ("length", T.LongType()),
             ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
             ("sequence_id", T.LongType()), ("offset", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in names])
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        words = tokenizer_for(tokenizer, memo_words)
        writer = _Writer(to_arrow_schema(schema), TaskContext.get().partitionId() << 33)
        pool, waiting, number = SlackPool(capacity), {}, 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = body.as_py()
                ids = words.encode(raw.decode("utf-8", "replace") if raw else "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = (key, start, ids[4 * start:4 * (start + capacity)], total)
                    if len(piece[2]) == 4 * capacity:
                        writer.window([piece])
                        continue
                    pool.add(len(piece[2]) // 4, number)
                    waiting[number] = piece
                    number += 1
                if pool.tokens > pool_tokens:
                    while pool.tokens > pool_tokens // 2:
                        writer.window([waiting.pop(i) for i in pool.next_window()])
                if len(writer.rows) > 1000:
                    yield writer.flush()
        while pool.present:
            writer.window([waiting.pop(i) for i in pool.next_window()])
            if len(writer.rows) > 1000:
                yield writer.flush()
        yield writer.flush()

    return source.mapInArrow(pack, schema)
