"""Toxicity by a weighted finite-state pattern grammar.

Words are tagged with their class (insult word, verb of harm, first person or intent,
target, negation, report, quotation mark, boundary or other). Six weighted transducers over
these classes are composed into one, the weights of their arcs multiplied: the first two
find insults and threats, the others rewrite them to aimed, negated or reported ones and
weigh them by how near the target, the negation or the report stands. A document's score
follows from its matched clauses, not from its words one by one. The words of the insult
class and their weights, and the weights of the outcomes, are learned from labelled
documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of, stored
from slotwise.llm.shingles import shingles, sketch

#: Labelled documents the grammar is learned from, at most (those with the smallest hash).
TRAINING_ROWS = 12_000
#: A term must be in so many labelled documents of either half, and so many times as likely in a toxic one.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 6.0
PREFIXES = (4, 5, 6, 7)

#: A contracted negation, another word, a mark that ends a sentence or a paragraph, a quotation mark.
_TOKEN = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[^\W\d_]+|[.!?;\n]|[\"“”„«»]")

# Classes with a closed list, in the four languages of the corpus.
_LISTS = {
    "H": """kill kills hurt destroy beat stab shoot murder burn crush töten umbringen schlagen vernichten tuer frapper
            détruire brûler matar golpear destruir quemar""",
    "F": """i we my our gonna will shall ich wir werde werden wollen je nous vais allons yo nosotros voy vamos""",
    "Y": """you your yours yourself he him his she her they them their u du dich dir dein deine ihr euch sie tu toi ton
            ta vous votre vos il elle ils elles tú ti usted ustedes él ella ellos ellas vosotros""",
    "N": """not never no none nobody neither nor without cannot nicht nie niemals kein keine keinen ohne pas jamais aucun
            aucune sans ne nunca jamás ningún ninguna sin tampoco""",
    "R": """said says say told tells wrote writes called calls claimed claims quoted quotes according reported reports
            sagte sagt schrieb nannte laut behauptete dit disait écrit appelait selon dijo dice escribió llamó según""",
}
_CLOSED = {word: symbol for symbol, words in _LISTS.items() for word in words.split()}
_TAGS = {symbol: (symbol, 1.0) for symbol in (*_LISTS, "o")}
_MARKS = {**dict.fromkeys("\"“”„«»", "Q"), **dict.fromkeys(".!?;", "B"), "\n": "P"}

#: What is read: W insult word, H verb of harm, F first person or intent, Y target, N negation, R report,
#: Q quotation mark, B end of a sentence, P end of a paragraph, o other.
INPUT = frozenset("WHFYNRQBPo")
#: What is written besides: I insult, T threat, J and U the same aimed at someone, each with - if negated, = if reported.
HITS = ("I", "T", "J", "U")


class Transducer(NamedTuple):
    """Deterministic and weighted: (state, symbol) to (state, output, weight); a pair that
    is missing keeps both, with weight 1."""

    arcs: dict[tuple[str, str], tuple[str, str, float]]
    start: str = "0"

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def _insults() -> Transducer:
    """Insult words are insults; one right after another weighs more."""
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}
    for symbol in INPUT:
        for state in ("0", "1"):
            arcs[state, symbol] = ("0", symbol, 1.0)
    return Transducer(arcs | {("0", "W"): ("1", "I", 1.0), ("1", "W"): ("1", "I", 1.5)})


def _near(trigger: str, window: int, rewrite: dict[str, str], nearest: float, farthest: float, symbols: frozenset[str]) -> Transducer:
    """Rewrites symbols that follow the trigger within ``window`` symbols, weighed from
    ``nearest`` down (or up) to ``farthest``; sentences and paragraphs end its reach."""
    arcs = {}
    for left in range(window + 1):
        state = str(left)
        weight = farthest + (nearest - farthest) * (left - 1) / max(1, window - 1)
        for symbol in symbols:
            if symbol == trigger:
                arcs[state, symbol] = (str(window), symbol, 1.0)
            elif symbol in "BP":
                arcs[state, symbol] = ("0", symbol, 1.0)
            elif left and symbol in rewrite:
                arcs[state, symbol] = (str(left - 1), rewrite[symbol], weight)
            else:
                arcs[state, symbol] = (str(max(0, left - 1)), symbol, 1.0)
    return Transducer(arcs)


def _threats(symbols: frozenset[str]) -> Transducer:
    """Verbs of harm are threats; after a first person or an intent they weigh more."""
    near = _near("F", 3, {"H": "T"}, 2.0, 1.5, symbols)
    return Transducer({key: ((state, "T", 0.75) if key == ("0", "H") else (state, out, w)) for key, (state, out, w) in near.arcs.items()})


def _quoted(rewrite: dict[str, str], weight: float) -> Transducer:
    """Rewrites symbols between quotation marks. A quotation may hold several sentences, but
    ends with the paragraph."""
    arcs = {("0", "Q"): ("1", "Q", 1.0), ("1", "Q"): ("0", "Q", 1.0), ("1", "P"): ("0", "P", 1.0)}
    return Transducer(arcs | {("1", s): ("1", out, weight) for s, out in rewrite.items()})


def compose(first: Transducer, second: Transducer, symbols: frozenset[str]) -> tuple[Transducer, frozenset[str]]:
    """The transducer that passes the first one's output to the second, weights multiplied,
    and what it writes."""
    arcs, out, names = {}, set(), {(first.start, second.start): "0"}
    todo = [(first.start, second.start)]
    while todo:
        a, b = todo.pop()
        for symbol in symbols:
            na, middle, one = first.step(a, symbol)
            nb, written, two = second.step(b, middle)
            out.add(written)
            if (na, nb) not in names:
                names[na, nb] = str(len(names))
                todo.append((na, nb))
            arcs[names[a, b], symbol] = (names[na, nb], written, one * two)
    return Transducer(arcs), frozenset(out)


def stages() -> list[Transducer]:
    """Insult, threat, target, negation, report and quotation, each over what those before it write."""
    found, symbols = [], INPUT
    reported = {x: f"{x[0]}=" for h in HITS for x in (h, f"{h}-")}
    for build in (
        lambda s: _insults(), _threats,
        lambda s: _near("Y", 4, {"I": "J", "T": "U"}, 1.6, 1.1, s),
        lambda s: _near("N", 3, {h: f"{h}-" for h in HITS}, 0.2, 0.5, s),
        lambda s: _near("R", 8, reported, 0.3, 0.6, s),
        lambda s: _quoted(reported, 0.4),
    ):
        stage = build(symbols)
        found.append(stage)
        symbols = frozenset(stage.step(state, symbol)[1] for state in {stage.start, *(s for s, _ in stage.arcs)} for symbol in symbols)
    return found


def grammar() -> Transducer:
    """All stages, composed."""
    machine = Transducer({})
    for stage in stages():
        machine, _ = compose(machine, stage, INPUT)
    return machine


GRAMMAR = grammar()
#: The outcomes that are weighed apart: plain, aimed, negated, reported; insults and threats.
_OUTCOMES = {"I": 0, "J": 1, "I-": 2, "J-": 2, "I=": 3, "J=": 3, "T": 4, "U": 5, "T-": 6, "U-": 6, "T=": 6, "U=": 6}
#: By state and symbol: the next state, the outcome (or None) and the weight.
_TABLE = {
    state: {s: (GRAMMAR.arcs[state, s][0], _OUTCOMES.get(GRAMMAR.arcs[state, s][1]), GRAMMAR.arcs[state, s][2]) for s in INPUT}
    for state in {state for state, _ in GRAMMAR.arcs}
}
FEATURES = (
    "plain", "aimed", "negated", "reported", "threat", "aimed_threat", "mild_threat",
    "heaviest", "clauses", "share", "length",
)


class Lexicon:
    """Weights of insult terms: whole words (ended by a space) and beginnings of words."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self._known: dict[str, tuple[str, float]] = {}

    def tag(self, word: str) -> tuple[str, float]:
        found = self._known.get(word)
        if found is None:
            weights = [self.terms[t] for t in _terms(word) if t in self.terms]
            negated = word.endswith(("n't", "n’t"))
            found = ("W", max(weights)) if weights else _TAGS["N" if negated else _CLOSED.get(word, "o")]
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = found
        return found


def _terms(word: str) -> list[str]:
    return [f"{word} ", *(word[:n] for n in PREFIXES if len(word) >= n)]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """What the matched clauses of a whole text amount to."""
    sums, heaviest, matched, total, n_words = [0.0] * 7, 0.0, 0, 1, 0
    row, clause, tag = _TABLE[GRAMMAR.start], 0.0, lexicon.tag
    for token in _TOKEN.findall((text or "").lower()):
        mark = _MARKS.get(token)
        if mark is None:
            symbol, own = tag(token)
            n_words += 1
        else:
            symbol, own = mark, 1.0
            if mark != "Q":
                total += 1
                matched += clause > 0
                heaviest, clause = max(heaviest, clause), 0.0
        state, outcome, weight = row[symbol]
        row = _TABLE[state]
        if outcome is not None:
            sums[outcome] += own * weight
            clause += own * weight
    matched += clause > 0
    heaviest = max(heaviest, clause)
    return [
        *(math.log1p(s) for s in sums), math.log1p(heaviest), math.log1p(matched), math.sqrt(matched / total), math.log1p(n_words),
    ]


class Model(NamedTuple):
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant

    def score(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, dtype="float64").reshape(-1, len(FEATURES)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic regression; the constant is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge * weights
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS) -> Model:
    """The model from labelled documents whose id's crc32 modulo 5 is not 0.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (null labels are left out). Near
    copies count once, and so do rows that repeat an id. The insult terms come from one half of the sample, the outcomes'
    weights from the other.
    """
    taken = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most TRAINING_ROWS rows of two numbers; of rows that repeat an id one is learned from.
    sample = docs.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )
    sample = stored(_without_copies(stored(sample, "toxicity-sample")), "toxicity-training")
    half = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2))
    counts = {bool(r.toxic): r["count"] for r in sample.where(half == 0).groupBy("toxic").count().collect()}
    lexicon = Lexicon(_learned_terms(sample.where(half == 0), counts))

    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    arrow = arrow_schema(schema)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            x = [features(text, lexicon) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, arrow.field("x").type)], schema=arrow)

    # TRAINING_ROWS rows of some ten numbers each at most.
    known = sample.where(half == 1).select("toxic", "text").mapInArrow(described, schema).collect()
    if not known:
        return Model(lexicon, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(len(FEATURES)), -3.0))
    x, y = np.array([r.x for r in known]), np.array([r.toxic for r in known], dtype="float64")
    order = np.lexsort((*x.T, y))  # rows come in any order; sums shall not depend on it
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(lexicon, mean, scale, _logistic((x - mean) / scale, y))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One of the documents that share any of four pairs of numbers of their sketch."""
    fields = [*sample.schema.fields, *(T.StructField(f"s{k}", T.LongType()) for k in range(4))]
    schema = T.StructType(fields)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [shingles(text) for text in batch.column(2).to_pylist()]
            lows = np.array([sketch(s) if len(s) else np.zeros(8, dtype="uint64") for s in found]).reshape(-1, 8)
            marks = (lows[:, 0::2] * np.uint64(0x9E3779B97F4A7C15) ^ lows[:, 1::2]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(marks[:, k], pa.int64()) for k in range(4))], schema=arrow
            )

    marked = stored(sample.mapInArrow(run, schema), "toxicity-marked")
    kept = marked.select("doc_id", "s0", "s1", "s2", "s3")
    for k in range(4):
        kept = kept.join(kept.groupBy(f"s{k}").agg(F.min("doc_id").alias("first")), f"s{k}").where("doc_id = first").drop("first")
    return marked.join(kept.select("doc_id").distinct(), "doc_id").select("doc_id", "toxic", "text")


def _learned_terms(sample: DataFrame, counts: dict[bool, int]) -> dict[str, float]:
    """Insult terms by their log ratio of toxic to clean documents; a beginning is taken
    only if it says more than any shorter one."""
    schema = "term string, toxic int, n long"
    arrow = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            seen: Counter = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _TOKEN.findall((text or "").lower()) if w[0].isalpha() and w not in _CLOSED}
                seen.update({(t, toxic) for w in words for t in _terms(w)})
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in seen]), pa.array([x for _, x in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                    schema=arrow,
                )

    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    ratio = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    found = (
        sample.select("toxic", "text").mapInArrow(count, schema).groupBy("term").agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("good"),
        )
        .where(F.col("bad") >= LEAST_DOCUMENTS).withColumn("ratio", ratio).where(F.col("ratio") >= math.log(LEAST_RATIO))
        .select("term", "ratio").collect()  # terms of TRAINING_ROWS documents that several toxic ones share
    )
    weights = {r.term: float(r.ratio) for r in found}
    return {
        term: weight for term, weight in weights.items()
        if all(weights.get(shorter, -math.inf) + 0.2 < weight for shorter in _terms(term.rstrip())[1:] if shorter != term)
    }


def clean(docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; learned as
    in ``score``, from the labelled among these documents. Null or empty texts stay."""
    model = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), rows=rows)
    at, arrow = docs.columns.index("text"), arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            scores = model.score([features(text, model.lexicon) for text in batch.column(at).to_pylist()])
            kept = batch.filter(pa.array(scores < 0.5))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def score(
    docs: DataFrame, labels: DataFrame, *, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null or empty text: the score of a text without matches. Null ids are never held out
    and never learned from; rows that repeat an id are scored each. Without labelled
    documents all scores are low. Very long texts are read whole. An empty table gives no
    rows. Labels repeated for an id: toxic if any says so. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = learn(docs, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), rows=rows)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType(), False)])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            scores = model.score([features(text, model.lexicon) for text in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], schema=arrow)

    return docs.mapInArrow(run, schema).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
