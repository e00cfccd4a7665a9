"""Secret scanning: formats of credentials learned by grammar inference.

Pass one finds the base spans, and counts how character classes follow each other in all
other text. The base spans are labelled credentials; a bounded sample of them per kind
becomes a prefix tree over character classes, whose statistically compatible states are
merged (Hoeffding bounds) into a probabilistic automaton. Pass two takes every token of the
labelled credentials' alphabet and least length as a candidate, and scores it by the
likelihood of its format against that of the corpus's ordinary text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of, stored

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)(?P<q>["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: What may be a credential: tokens of the alphabet and least length of the labelled ones.
LEAST = 12
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_KEYWORDS = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)

#: An automaton is learned from so many labelled credentials of its kind at most, those
#: with the smallest hashes, and from so many characters of them in all.
SAMPLE, SAMPLE_CHARACTERS = 400, 32_768
#: Significance of the merge test, and the mean advantage per character (in nats) over
#: ordinary text that the weakest of the labelled credentials still reaches.
ALPHA, KEEP, LEAST_ADVANTAGE = 0.05, 0.02, 0.25
_FLOOR = 1e-4

_CLASSES = {
    **dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
    **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U"), **dict.fromkeys("+/", "s"),
    **dict.fromkeys("_-.", "p"), "=": "e",
}
#: The classes, and one for every other character, which tokens begin after.
_SYMBOLS = "dhlHUspe "
_NUMBER = np.full(256, len(_SYMBOLS) - 1, dtype=np.uint8)
for _character, _symbol in _CLASSES.items():
    _NUMBER[ord(_character)] = _SYMBOLS.index(_symbol)
#: Ordinary text before any was seen: lower-case words with few digits, and how many pairs
#: of characters that guess is worth.
_GUESS = {"d": 0.02, "h": 0.25, "l": 0.55, "H": 0.04, "U": 0.08, "s": 0.02, "p": 0.03, "e": 0.01}
_GUESS_WORTH = 50.0


def classes(value: str) -> str:
    return "".join([_CLASSES.get(c, "p") for c in value])


def class_pairs(text: str, spans: Iterable[tuple[str, int, int, str]] = ()) -> np.ndarray:
    """How often each class follows each other one outside the spans, as a square table."""
    data = np.frombuffer(text.encode("latin-1", "replace").replace(b"?", b" "), dtype=np.uint8)
    number = _NUMBER[np.concatenate([[32], data])].astype(np.int64)
    for _, start, end, _ in spans:
        number[start + 1: end + 1] = len(_SYMBOLS) - 1
    size = len(_SYMBOLS)
    return np.bincount(number[:-1] * size + number[1:], minlength=size * size)


class Ordinary:
    """The log-likelihood of each class after each other one in ordinary text."""

    def __init__(self, pairs: np.ndarray | None = None):
        size = len(_SYMBOLS)
        seen = np.zeros((size, size)) if pairs is None else np.asarray(pairs, dtype=float).reshape(size, size)
        guess = np.array([_GUESS.get(s, 0.0) for s in _SYMBOLS])
        shares = (seen[:, :-1] + _GUESS_WORTH * guess[:-1]) / (seen[:, :-1].sum(axis=1, keepdims=True) + _GUESS_WORTH)
        self.log = {a + b: math.log(max(shares[j, k], 1e-6)) for j, a in enumerate(_SYMBOLS) for k, b in enumerate(_SYMBOLS[:-1])}


class Automaton:
    """A probabilistic automaton: per state, the count of words that end there and of each
    symbol's way out."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        for word in words:
            state = 0
            for symbol in word:
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = self._new()
                state = self.next[state][symbol]
            self.ends[state] += 1
        self._merge()

    def _new(self) -> int:
        self.next.append({})
        self.count.append({})
        self.ends.append(0)
        return len(self.next) - 1

    def _total(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states, and all that follow both, differ by chance only."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = self._total(a), self._total(b)
            if not m or not n:
                continue
            bound = self.alpha * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.ends[a] / m - self.ends[b] / n) > bound:
                return False
            for symbol in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(symbol, 0) / m - self.count[b].get(symbol, 0) / n) > bound:
                    return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[b] if s in self.next[a]]
        return True

    def _fold(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            into, state = todo.pop()
            self.ends[into] += self.ends[state]
            for symbol, n in self.count[state].items():
                self.count[into][symbol] = self.count[into].get(symbol, 0) + n
                if symbol in self.next[into]:
                    todo.append((self.next[into][symbol], self.next[state][symbol]))
                else:
                    self.next[into][symbol] = self.next[state][symbol]

    def _merge(self) -> None:
        """Merge each new state with the first settled state like it, nearest to the root first."""
        settled, edge = [0], sorted((s, 0) for s in self.next[0])
        while edge:
            symbol, parent = edge.pop(0)
            state = self.next[parent][symbol]
            if state in settled:
                continue
            for old in settled:
                if self._alike(old, state):
                    self.next[parent][symbol] = old
                    self._fold(old, state)
                    break
            else:
                settled.append(state)
            edge = [(s, p) for p in settled for s in sorted(self.next[p]) if self.next[p][s] not in settled]

    def advantage(self, word: str, ordinary: Ordinary) -> float:
        """Mean log-likelihood per symbol over that of ordinary text."""
        state, total, before = 0, 0.0, " "
        for symbol in word:
            n = self._total(state) if state is not None else 0
            p = self.count[state].get(symbol, 0) / n if n else 0.0
            total += math.log(max(p, _FLOOR)) - ordinary.log[before + symbol]
            before = symbol
            state = self.next[state].get(symbol, 0) if state is not None else 0
        return total / max(1, len(word))


class Grammar:
    """One automaton per kind that has labelled credentials, each with its least advantage
    over ordinary text, given as a table of class pairs."""

    def __init__(self, labelled: Mapping[str, list[str]], pairs: np.ndarray | None = None):
        self.ordinary = Ordinary(pairs)
        self.automata: dict[str, tuple[Automaton, float]] = {}
        for kind, values in sorted(labelled.items()):
            words = [classes(v) for v in values]
            automaton = Automaton(words)
            scores = sorted(automaton.advantage(w, self.ordinary) for w in words)
            self.automata[kind] = (automaton, max(LEAST_ADVANTAGE, scores[int(KEEP * len(scores))]))

    def score(self, value: str) -> float:
        """How far the best format's advantage lies above its least; 0 or more: a credential."""
        return self.score_classes(classes(value))

    def score_classes(self, word: str) -> float:
        return max((a.advantage(word, self.ordinary) - least for a, least in self.automata.values()), default=-math.inf)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the contract's patterns, per kind leftmost and not overlapping."""
    found = []
    if _KEYWORDS.search(text):
        found += [("assign", m.start(), m.end(), m.group(3)) for m in _ASSIGN.finditer(text) if len(m.group(3)) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.group()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m.group()) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that no base span touches; full stops at their ends are not part of them."""
    taken = sorted((start, end) for _, start, end, _ in base)
    found, k = [], 0
    for match in _CANDIDATE.finditer(text):
        value = match.group().rstrip(".")
        end = match.start() + len(value)
        value = value.lstrip(".")
        if len(value) < LEAST:
            continue
        start = end - len(value)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            found.append((start, end, value))
    return found


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    order = {kind: k for k, kind in enumerate((*KINDS, "format"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]])))


def observed(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Pass one: (kind, value, n). Labelled credentials by their kind, and pairs of classes
    in the text around them under the kind ``pair``, added up per partition and then by
    Spark."""
    schema = T.StructType([
        T.StructField("kind", T.StringType(), False), T.StructField("value", T.StringType(), False), T.StructField("n", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def rows(found: Mapping[tuple[str, str], int]) -> pa.RecordBatch:
        columns = list(zip(*((k, v, n) for (k, v), n in found.items()), strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(len(_SYMBOLS) ** 2, dtype=np.int64)
        for batch in rows_of(batches):
            found: Counter[tuple[str, str]] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    pairs += class_pairs(text, base)
                    found.update((kind, value) for kind, _, _, value in base)
            if found:
                yield rows(found)
        yield rows({("pair", str(k)): int(n) for k, n in enumerate(pairs) if n})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema).groupBy("kind", "value").agg(F.sum("n").alias("n"))


def learned(docs: DataFrame, *, sample: int = SAMPLE, characters: int = SAMPLE_CHARACTERS, text_col: str = "text") -> Grammar:
    """The grammar of the labelled credentials in ``docs``, from at most ``sample`` distinct
    values and ``characters`` characters of each of the three kinds; ordinary text is
    counted whole."""
    seen = stored(observed(docs, text_col=text_col), "secrets")
    labelled = {}
    for kind in KINDS:
        rows = (
            seen.where(F.col("kind") == kind).where(F.length("value") <= characters)
            .orderBy(F.xxhash64("value"), "value").limit(sample).select("value").collect()
        )
        left, values = characters, []
        for r in rows:
            if len(r.value) <= left:
                left -= len(r.value)
                values.append(r.value)
        if values:
            labelled[kind] = values
    pairs = np.zeros(len(_SYMBOLS) ** 2)
    for r in seen.where("kind = 'pair'").collect():  # as many as there are pairs of classes
        pairs[int(r.value)] = r.n
    return Grammar(labelled, pairs)


def scan(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets in each text; one row per row of ``docs``.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format (the learned
    formats' own spans, kind "format" in spans). Null or empty text: no spans, the digest
    of the empty string. A corpus without labelled credentials learns no format and adds
    none. Whole texts are read, twice. Spans that start together stand in the order assign,
    access, hex, format. Repeated rows and null ids stay as they are; an empty table gives
    no rows. Other columns are not read.
    """
    grammar = learned(docs, sample=sample, text_col=text_col)
    counts = [f"n_{kind}" for kind in (*KINDS, "format")]
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        *(T.StructField(name, T.LongType(), False) for name in counts),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField("spans", T.StringType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = lru_cache(maxsize=1 << 17)(grammar.score_classes)
        for batch in rows_of(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                own = [s[:3] for s in base]
                tokens = candidates(text or "", base) if grammar.automata else []
                more = [("format", start, end) for start, end, value in tokens if score(classes(value)) >= 0]
                kinds = Counter(s[0] for s in own + more)
                digest = hashlib.sha256(_joined(own).encode()).hexdigest()
                out.append((*(kinds[k] for k in (*KINDS, "format")), digest, _joined(own + more)))
            columns = list(zip(*out, strict=True)) or [()] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))],
                schema=arrow,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
