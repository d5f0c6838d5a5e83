"""Toxicity from a lexicon whose misspellings are found by Levenshtein automata.

The lexicon's terms form a trie; a term is a whole word or a stem. A word is read by the
intersection of that trie with the Levenshtein automata of all terms: a state is the set
of (trie node, edits spent) that the letters so far can reach, states are made when first
met, and a word that leaves every term's reach is dropped after a few letters. Whole words
of `fuzzy_from` letters or more are also found with one letter changed, added, left out, or
two neighbours swapped; stems are short pieces of many clean words too and are not.

Each hit is judged in its context window: in quotation marks on its line, near a verb of
reporting, near an address to someone. A hit counts with its term's weight, the log-odds of
the term among toxic documents. Sums of hits by kind, quoted and not, exact and misspelled,
are features of a logistic score, so that quotation and abuse weigh differently as far as
the labels say so.

The lexicon is BASE_TERMS and what labels teach, from a bounded sample: at most
`sample_docs` documents of each label, those of the smallest hash. A greedy cover picks the
word or stem that gains most toxic documents not yet covered for the clean ones it costs;
copies of one toxic text therefore add no terms beyond the first that explains them. The context weights are fitted on two folds, each with terms from the other one, so
a term that fits its own examples by chance earns no trust. Scoring reads whole texts.

Defined results: a null or empty text has no hits and gets the score of a document without
any. Null labels are not learned from; of repeated labels the larger counts. Without
toxic or without clean examples every score is the share of toxic ones (0 for no labels).
Repeated rows get equal results. An empty table gives an empty result. Input columns named
like result columns give way.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import replace_columns, utf8, word_bytes

#: Verbs of reporting and words of address in the languages of the corpus.
REPORTING = frozenset(
    "said says wrote called quote quoted quoting dijo dice escribió llamó dit écrit appelé "
    "sagte sagt schrieb nannte zitat".split())
ADDRESS = frozenset("you your youre du dein ihr tu ton vous votre usted tus eres".split())

#: Common insults in the languages of the corpus, where learning starts.
BASE_TERMS = (
    "idiot idiots moron morons stupid loser losers scum trash clown pathetic worthless disgusting "
    "dumbass imbecile idiota imbécil estúpido estúpida basura payaso patético asqueroso crétin "
    "imbécile débile ordure minable dummkopf trottel abschaum versager erbärmlich widerlich".split()
)

_BASE = frozenset(BASE_TERMS)
COUNT_TABLE = 1 << 20  # slots of the table that sorts out rare candidates

KINDS = ("whole", "misspelled", "stem")
WINDOW_WORDS = 8
MEMO_WORDS = 150_000
MEMO_STATES = 20_000
_WORD_SPANS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_RUNS = re.compile(r"[^\W_]+")
_PAIRED = ((b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xc2\xab", b"\xc2\xbb"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c"))


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False
    weight: float = 1.0


class LexiconAutomaton:
    """Lexicon trie and Levenshtein automata, intersected state by state on demand."""

    def __init__(self, terms: Iterable[Term], fuzzy_from: int = 5, edits: int = 1) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.terms = list(terms)
        self.ends: list[set[tuple[bool, int, int]]] = [set()]  # (stem, edits allowed, term)
        self.reach = [0]  # most edits allowed by any term below a node
        for number, term in enumerate(self.terms):
            allowed = edits if len(term.text) >= fuzzy_from and not term.stem else 0
            node = 0
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term.text:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(set())
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].add((term.stem, allowed, number))
        self._forget()

    def _forget(self) -> None:
        """Start with no states; they are made again when met."""
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._number(self._closed({(0, 0, "")}))

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """Add what leaving out a term's letter reaches; nothing beyond the edits allowed."""
        todo, seen = list(items), set()
        while todo:
            node, spent, swap = item = todo.pop()
            if item in seen or spent > self.reach[node]:
                continue
            seen.add(item)
            if not swap:
                todo += [(child, spent + 1, "") for child in self.children[node].values()]
        return frozenset(seen)

    def _number(self, items: frozenset) -> int:
        if items not in self.numbers:
            self.numbers[items] = len(self.states)
            self.states.append(items)
            self.moves.append({})
        return self.numbers[items]

    def _move(self, state: int, letter: str) -> int:
        """The next state; -1 when no term can be reached any more."""
        after: set[tuple[int, int, str]] = set()
        for node, spent, swap in self.states[state]:
            if swap:  # the second half of two swapped letters
                if letter == swap:
                    after.add((node, spent, ""))
                continue
            if any(stem and spent <= allowed for stem, allowed, _ in self.ends[node]):
                after.add((node, spent, ""))  # a stem goes on with anything
            for own, child in self.children[node].items():
                if own == letter:
                    after.add((child, spent, ""))
                else:
                    after.add((child, spent + 1, ""))
                    if letter in self.children[child]:
                        after.add((self.children[child][letter], spent + 1, own))
            after.add((node, spent + 1, ""))
        closed = self._closed(after)
        return self._number(closed) if closed else -1

    def match(self, word: str) -> tuple[int, float] | None:
        """Place in KINDS and weight of the best match: exact before misspelled, then the
        larger weight."""
        if len(self.states) > MEMO_STATES:
            self._forget()
        state = self.start
        for letter in word:
            following = self.moves[state].get(letter)
            if following is None:
                following = self.moves[state][letter] = self._move(state, letter)
            if following < 0:
                return None
            state = following
        found = [
            (spent == 0, self.terms[number].weight, 2 if stem else min(spent, 1))
            for node, spent, swap in self.states[state] if not swap
            for stem, allowed, number in self.ends[node] if spent <= allowed
        ]
        if not found:
            return None
        _, weight, kind = max(found)
        return kind, weight


def letter_runs(word: bytes) -> list[str]:
    """The runs of letters and digits in a word: non-ASCII quotes and dashes go."""
    return _RUNS.findall(word.decode("utf-8", "replace"))


class HitFinder:
    """Features of whole texts; remembers the kinds of words it has seen."""

    def __init__(self, terms: Iterable[Term], fuzzy_from: int = 5) -> None:
        self.automaton = LexiconAutomaton(terms, fuzzy_from)
        self.kinds: dict[bytes, tuple[int, float] | bool] = {}

    def _kinds(self, words: list[bytes]) -> list[tuple[int, float] | bool]:
        """Kind and weight of each word's best match, False for none."""
        found = list(map(self.kinds.get, words))
        if None in found:
            kinds = self.kinds
            for word in set(words):
                if word not in kinds:
                    matches = [m for w in letter_runs(word) if (m := self.automaton.match(w))]
                    kinds[word] = max(matches, key=lambda m: (m[0] != 1, m[1]), default=False)
            found = list(map(kinds.__getitem__, words))
            if len(kinds) > MEMO_WORDS:
                self.kinds = {}
        return found

    def hits(self, text: bytes) -> list[tuple[int, int, int, float, bool, bool, bool]]:
        """(start and end byte, kind, weight, quoted, reported, addressed) of each hit."""
        words = word_bytes(text)
        kinds = self._kinds(words)
        if not any(kinds):
            return []
        spans = [m.span() for m in _WORD_SPANS.finditer(text)]
        out = []
        for i, kind in enumerate(kinds):
            if kind:
                window = words[max(0, i - WINDOW_WORDS): i + WINDOW_WORDS + 1]
                near = {run for w in window for run in letter_runs(w)}
                out.append((
                    *spans[i], *kind, quoted(text, *spans[i]),
                    not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near)))
        return out

    def features(self, text: bytes | None) -> list[float]:
        """Per kind: weights of hits outside quotes and inside; then reported, addressed,
        and the share of words that are hits (all but the share as log(1 + sum))."""
        sums = [0.0] * (2 * len(KINDS) + 2)
        found = self.hits(text or b"")
        for _, _, kind, weight, inside, reported, addressed in found:
            sums[2 * kind + inside] += weight
            sums[-2] += reported
            sums[-1] += addressed
        share = len(found) / max(1, len(word_bytes(text or b""))) if found else 0.0
        return [*np.log1p(sums).tolist(), share]


def quoted(text: bytes, start: int, stop: int) -> bool:
    """Whether a span lies in quotation marks that open and close on its line.

    Typographic quotes touch their word, so they may be inside the span.
    """
    low = text.rfind(b"\n", 0, start) + 1
    high = text.find(b"\n", stop)
    before, after = text[low:start], text[stop:high if high >= 0 else len(text)]
    if before.count(b'"') % 2 and b'"' in after:
        return True
    inside = text[start:stop]
    middle = max(1, len(inside) // 2)
    before, after = before + inside[:middle], inside[middle:] + after
    return any(
        before.rfind(opens) > before.rfind(closes) and closes in after for opens, closes in _PAIRED)


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[Term, ...]
    weights: np.ndarray  # one per feature, the constant last
    fuzzy_from: int = 5

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _candidates(word: str, shortest: int, longest: int) -> Iterator[tuple[str, bool]]:
    if len(word) >= shortest:
        yield word, False
        for n in range(shortest, min(len(word), longest) + 1):
            yield word[:n], True


def learn_terms(
    toxic: list[Collection[str]], clean: list[Collection[str]], clean_scale: float = 1.0,
    support: int = 3, share: float = 0.01, shortest: int = 4, longest: int = 10,
) -> list[Term]:
    """Greedy cover of the toxic documents (their distinct words) by words and stems.

    `clean_scale` says how many clean documents one of the sample stands for, a toxic one
    standing for one. BASE_TERMS come first. A further term gains the toxic documents that
    no earlier term covers, at least `support` and a `share` of all, less the clean ones it
    newly hits. Of equal gain the longer text wins, then the whole word, then the alphabet.
    """
    least = max(support, share * len(toxic))
    # Most candidates are in one document only. A table of counts by hash, where collisions
    # only add, says which can reach the support; the others are never stored.
    table = [0] * COUNT_TABLE
    for words in toxic:
        for slot in {hash(t) % COUNT_TABLE for w in words for t in _candidates(w, shortest, longest)}:
            table[slot] += 1
    held: dict[tuple[str, bool], set[int]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for word in words:
            for term in _candidates(word, shortest, longest):
                if table[hash(term) % COUNT_TABLE] >= least or word in _BASE and not term[1]:
                    held[term].add(i)
    held = {t: docs for t, docs in held.items() if len(docs) >= least or t[0] in _BASE and not t[1]}
    cost: dict[tuple[str, bool], set[int]] = defaultdict(set)
    for i, words in enumerate(clean):
        for word in words:
            for term in _candidates(word, shortest, longest):
                if term in held:
                    cost[term].add(i)
    covered = {i for i, words in enumerate(toxic) if not _BASE.isdisjoint(words)}
    hit = {i for i, words in enumerate(clean) if not _BASE.isdisjoint(words)}

    def weight(term: tuple[str, bool], known: bool) -> float:
        """Log-odds of the term, shrunk for learned ones, at least 0.1."""
        a = len(held.get(term, ())) + (2.0 if known else 0.0)
        c = (len(cost.get(term, ())) + (0.05 if known else 0.5)) * clean_scale
        n1, n0 = len(toxic) + 4.0, (len(clean) + 4.0) * clean_scale
        return max(0.1, float(np.log(max(a, 0.5) / n1) - np.log(c / n0)))

    chosen = [Term(t, False, weight((t, False), True)) for t in BASE_TERMS]
    queue = [(-float(len(docs)), -len(t[0]), t[1], t[0]) for t, docs in held.items() if t[0] not in _BASE]
    heapq.heapify(queue)
    while queue:
        bound, length, stem, text = heapq.heappop(queue)
        fresh = held[text, stem] - covered
        gain = len(fresh) - clean_scale * len(cost[text, stem] - hit)
        if len(fresh) < least or gain <= 0:
            # Clean documents already hit cost nothing more, so a gain can grow; it is
            # judged when it is looked at, and a term is looked at in the order of bounds.
            continue
        if gain < -bound and queue and -gain > queue[0][0]:
            heapq.heappush(queue, (-gain, length, stem, text))
            continue
        covered |= held[text, stem]
        hit |= cost[text, stem]
        chosen.append(Term(text, stem, weight((text, stem), False)))
    return chosen


def fit_weights(features: np.ndarray, labels: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge penalty; the constant last."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + ridge @ w
        curvature = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, may_learn: Column, id_column: str = "doc_id",
    text: str = "text", label: str = "toxic", sample_docs: int = 2000, seed: int = 23,
    fuzzy_from: int = 5,
) -> ToxicityModel:
    """Learn terms and weights from labelled rows for which `may_learn` (over the id) holds."""
    usable = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & may_learn)
        .groupBy(id_column).agg(F.max(label).alias("_label"))
    )
    order = [F.xxhash64(id_column, F.lit(seed)), F.col(id_column)]
    chosen = usable.where("_label = 1").orderBy(*order).limit(sample_docs).unionByName(
        usable.where("_label = 0").orderBy(*order).limit(sample_docs))
    fold = F.pmod(F.xxhash64(id_column, F.lit(seed + 1)), F.lit(2)).alias("_fold")

    @F.arrow_udf("array<binary>")
    def distinct_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted(set(word_bytes(t.as_py() or b""))) for t in texts], type=pa.list_(pa.binary()))

    # The sample's ids are at most twice the parameter; its texts stay in the tasks.
    sample = (
        docs.select(id_column, text).join(F.broadcast(chosen), id_column)
        .where("_label IN (0, 1)").withColumn("_fold", fold)
    )
    words: dict[tuple[int, int], list[tuple[str, ...]]] = {(f, y): [] for f in (0, 1) for y in (0, 1)}
    shared: dict[str, str] = {}  # one copy of each word
    for row in (
        sample.select(id_column, "_label", "_fold", distinct_words(utf8(text)).alias("w"))
        .orderBy(id_column).toLocalIterator()
    ):
        own = {run for w in row["w"] for run in letter_runs(bytes(w))}
        words[row["_fold"], row["_label"]].append(tuple(shared.setdefault(w, w) for w in sorted(own)))
    shares = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    taken = [len(words[0, y]) + len(words[1, y]) for y in (0, 1)]
    scale = shares.get(0, 0) / max(1, taken[0]) * taken[1] / max(1, shares.get(1, 0)) or 1.0
    terms = tuple(learn_terms(words[0, 1] + words[1, 1], words[0, 0] + words[1, 0], scale))
    found = []
    for own in (0, 1):
        others = tuple(learn_terms(words[1 - own, 1], words[1 - own, 0], scale))
        found += sample.where(F.col("_fold") == own).select(
            "_label", features_column(docs, text, others, fuzzy_from).alias("f")).collect()
    width = 2 * len(KINDS) + 3
    x = np.array([r["f"] for r in found]).reshape(-1, width)
    y = np.array([r["_label"] for r in found], dtype=float)
    total = shares.get(0, 0) + shares.get(1, 0)
    if not len(y) or not 0 < y.mean() < 1:
        share = shares.get(1, 0) / total if total else 0.0
        constant = np.zeros(width + 1)
        constant[-1] = np.log(max(share, 1e-12) / max(1 - share, 1e-12))
        return ToxicityModel(terms, constant, fuzzy_from)
    weights = fit_weights(x, y)
    # Back to the labels' own shares: the sample may have both labels alike.
    prior = shares[1] / shares[0]
    weights[-1] += np.log(prior) - np.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(terms, weights, fuzzy_from)


def features_column(docs: DataFrame, text: str, terms: tuple[Term, ...], fuzzy_from: int) -> Column:
    """An Arrow function with the features of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    @F.arrow_udf("array<double>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = HitFinder(sent.value, fuzzy_from)
        for texts in batches:
            yield pa.array([finder.features(t.as_py()) for t in texts], type=pa.list_(pa.float64()))

    return compute.asNondeterministic()(utf8(text))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5) to every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        finder = HitFinder(own.terms, own.fuzzy_from)
        for texts in batches:
            features = np.array([finder.features(t.as_py()) for t in texts])
            yield pa.array(own.score(features) if len(texts) else [], type=pa.float64())

    scored = replace_columns(docs, {"score": compute.asNondeterministic()(utf8(text))})
    return replace_columns(scored, {"predicted": (F.col("score") >= 0.5).cast("int")})
