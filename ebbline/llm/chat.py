"""Chat formatting with a black-box template, rendered turn by turn.

A template is any function from a list of turns to a string. Prefixes of the conversation
are rendered one after the other; where an output continues the one before, what was added
is the new turn's span. Where it does not, the template has rewritten history (moved a
system prompt, dropped earlier reasoning), and the turn is reported with the length both
outputs still share. The text inside a span is found by a second rendering in which the
turn says only a sentinel: what stands before and after the sentinel is markup.

A template is rendered with full prefixes, which is quadratic in the turns of a conversation
and holds all its text. Only a template declared `@local` is not: it promises that the
rendering of `[..., previous, turn]` is that of `[..., previous]` followed by what `turn` adds
to `[previous]` alone, so that what a turn adds depends on the turn before at most and nothing
is ever rewritten. For it the context is anchored anew at its last turn after `context_turns`
turns or `context_chars` characters: the rendering of that turn alone becomes the base, and the
following turns are located against it. The next turn is still rendered in both contexts at an
anchor; where they differ, the declaration is wrong and an error says so.

Rows are brought together by conversation and sorted by turn; a task streams over them
and holds one context, which for a template that is not local is the conversation.

Defined results: a null text is empty, a null role too. Ties in the turn go by role and
text. Repeated rows are turns of their own. A null conversation id is a conversation. An
empty table gives an empty result; columns besides id, turn, role and text are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]  # role, text
Template = Callable[[Sequence[Turn]], str]

CONTEXT_TURNS = 16
CONTEXT_CHARS = 1_000_000
SENTINELS = ("\ue000", "\ue001\ue002", "\uf8ff")

_CONTROL = re.compile(r"(</?s>|\[/?INST\]|\[/?SYS\]|\[/?ROLE)|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BLOCK = re.compile(
    r"(?P<begin><s>)?(?:\[(?P<kind>INST|SYS)\] (?P<body>.*?) \[/(?P=kind)\]"
    r"|\[ROLE (?P<role>.*?)\]\n(?P<other>.*?) \[/ROLE\]| (?P<answer>.*?)</s>)", re.DOTALL)


def escape(text: str) -> str:
    """Break control strings with a backslash, reversibly: no control string remains."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("]", "\\]")


def local(template: Template) -> Template:
    """Declare that what a turn adds depends on the turn before at most, and rewrites nothing."""
    template.local = True
    return template


@local
def instruct_template(turns: Sequence[Turn]) -> str:
    """`<s>`, then `[INST] user [/INST]`, ` assistant</s>`, `[SYS] system [/SYS]`;
    other roles are named in `[ROLE name]` blocks. Texts are escaped."""
    out = ["<s>"] if turns else []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        elif role == "system":
            out.append(f"[SYS] {body} [/SYS]")
        else:
            out.append(f"[ROLE {escape_role(role)}]\n{body} [/ROLE]")
    return "".join(out)


def read_back(formatted: str) -> list[Turn]:
    """The turns of a text that instruct_template() made, from the text alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = _match_block(formatted, at)
        if m["kind"]:
            turns.append(({"INST": "user", "SYS": "system"}[m["kind"]], unescape(m["body"])))
        elif m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append(("assistant", unescape(m["answer"])))
        at = m.end()
    return turns


def _match_block(formatted: str, at: int) -> re.Match:
    m = _BLOCK.match(formatted, at)
    if m is None:
        raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
    if m["role"] is not None:
        # An escaped bracket does not end the role.
        stop = re.compile(r"(?:[^\\\]]|\\.)*", re.DOTALL).match(formatted, at + len(m["begin"] or "") + 6).end()
        m = re.compile(
            r"(?P<begin><s>)?\[ROLE (?P<role>.{%d})\]\n(?P<other>.*?) \[/ROLE\](?P<kind>)(?P<answer>)(?P<body>)"
            % (stop - at - len(m["begin"] or "") - 6), re.DOTALL).match(formatted, at)
    return m


@dataclass
class Span:
    """One located turn; positions count code points of the whole formatted text."""

    position: int
    role: str
    formatted: str
    start: int
    text_start: int | None
    text_stop: int | None
    rewrites: bool
    shared: int


class IncrementalFormatter:
    """Feeds turns one at a time to a black-box template and locates their spans."""

    def __init__(self, template: Template, context_turns: int = CONTEXT_TURNS, context_chars: int = CONTEXT_CHARS):
        self.template, self.turn_limit, self.char_limit = template, context_turns, context_chars
        self.anchors = getattr(template, "local", False)
        self.turns: list[Turn] = []
        self.base = ""       # rendering of the context
        self.done = 0        # turns located
        self.length = 0      # characters of the whole formatted text so far

    def _added(self, context: list[Turn], base: str, turn: Turn) -> str | None:
        output = self.template([*context, turn])
        return output[len(base):] if output.startswith(base) else None

    def _inside(self, context: list[Turn], base: str, role: str, added: str) -> tuple[int, int] | None:
        """Where the text lies in what a turn added."""
        for sentinel in SENTINELS:
            probe = self._added(context, base, (role, sentinel))
            if probe is None or probe.count(sentinel) != 1:
                continue
            head, tail = probe.split(sentinel)
            if len(added) >= len(head) + len(tail) and added.startswith(head) and added.endswith(tail):
                return len(head), len(added) - len(tail)
        return None

    def _anchor(self, turn: Turn) -> None:
        """Shorten the context to its last turn."""
        short = self.turns[-1:]
        base = self.template(short)
        if not self._added(short, base, turn) == self._added(self.turns, self.base, turn) is not None:
            raise ValueError(f"the template is declared local, but turn {self.done} depends on more than one before")
        self.turns, self.base = short, base

    def add(self, role: str, text: str) -> Span:
        turn = (role, text)
        if self.anchors and len(self.turns) > 1 and (
                len(self.turns) >= self.turn_limit or len(self.base) >= self.char_limit):
            self._anchor(turn)
        before = len(self.base)
        output = self.template([*self.turns, turn])
        if output.startswith(self.base):
            added, rewrites, shared = output[before:], False, self.length
            inside = self._inside(self.turns, self.base, role, added)
            start = self.length
        else:
            kept = _common_prefix(self.base, output)
            start = self.length - before + kept
            added, rewrites, shared, inside = output[kept:], True, start, None
        span = Span(
            self.done, role, added, start,
            start + inside[0] if inside else None, start + inside[1] if inside else None,
            rewrites, shared)
        self.turns.append(turn)
        self.length = start + len(added)
        self.base = output
        self.done += 1
        return span


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _sorted_turns(turns: DataFrame, id_column: str) -> DataFrame:
    return (
        turns.select(
            F.col(id_column).alias("_id"), F.col("turn").alias("_turn"),
            F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
        .repartition("_id")
        .sortWithinPartitions("_id", "_turn", "_role", "_text")
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, str, str]]:
    """(id, whether it begins, role, text) for each row of sorted batches."""
    last, any_yet = None, False
    for batch in batches:
        for key, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            begins = not any_yet or key != last
            last, any_yet = key, True
            yield key, begins, role, text.as_py()


class _Rows:
    def __init__(self, schema: T.StructType, chars: int = 1 << 23) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.limit = to_arrow_schema(schema), chars
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.chars += chars
        return self.take() if self.chars > self.limit or len(self.rows) > 5000 else None

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(self.schema)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def format_conversations(
    turns: DataFrame, template: Template = instruct_template, id_column: str = "conv_id",
    context_turns: int = CONTEXT_TURNS, context_chars: int = CONTEXT_CHARS,
) -> DataFrame:
    """One row per turn: what it added to the formatted text, and where.

    `position` (from 0), `role`, `formatted` (the added text), `start` (its place in the
    whole), `text_start` and `text_stop` (the message inside), `loss` (whether the message
    is learned: role assistant), `rewrites_history` and `shared_chars`. Joining `formatted`
    by position gives the conversation, unless a turn rewrites history: then the text
    before it counts up to `shared_chars` only. `context_turns` and `context_chars` bound the
    context of a template declared `@local`; any other is rendered with full prefixes.
    """
    source = _sorted_turns(turns, id_column)
    schema = T.StructType([
        T.StructField(id_column, source.schema["_id"].dataType), T.StructField("position", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("formatted", T.StringType()),
        T.StructField("start", T.LongType()), T.StructField("text_start", T.LongType()),
        T.StructField("text_stop", T.LongType()), T.StructField("loss", T.BooleanType()),
        T.StructField("rewrites_history", T.BooleanType()), T.StructField("shared_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, formatter = _Rows(schema), None
        for key, begins, role, text in _conversations(batches):
            if begins:
                formatter = IncrementalFormatter(template, context_turns, context_chars)
            s = formatter.add(role, text)
            full = rows.add(
                (key, s.position, role, s.formatted, s.start, s.text_start, s.text_stop,
                 role == "assistant" and s.text_start is not None, s.rewrites, s.shared),
                len(s.formatted))
            if full is not None:
                yield full
        yield rows.take()

    return source.mapInArrow(run, schema)


def digest_conversations(
    formatted: DataFrame, reader: Callable[[str], list[Turn]] = read_back,
    unescaped: Callable[[str], str] = unescape, id_column: str = "conv_id",
) -> DataFrame:
    """Digests per conversation, read back from the rows of format_conversations().

    Turns come from the formatted texts, loss texts from the spans under the loss mask.
    Hashes run on from row to row, so a conversation is never held.
    """
    source = formatted.select(
        F.col(id_column).alias("_id"), "position", "formatted", "start", "text_start", "text_stop", "loss",
    ).repartition("_id").sortWithinPartitions("_id", "position")
    schema = T.StructType([
        T.StructField(id_column, source.schema["_id"].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, state = _Rows(schema), None, None

        def close() -> tuple:
            n, turns, chars, loss, total = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)]
            for (k, start, first, stop, masked), text in zip(zip(*columns), batch.column(2)):
                if state is None or k != key:
                    if state is not None and (full := rows.add(close(), 0)) is not None:
                        yield full
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                body = text.as_py()
                for role, said in reader(body):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if masked:
                    learned = unescaped(body[first - start:stop - start])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(body)
        if state is not None:
            rows.add(close(), 0)
        yield rows.take()

    return source.mapInArrow(run, schema)
