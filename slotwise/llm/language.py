"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every n-gram of one to four characters is hashed to a bucket. Spark adds up how often each
language uses each bucket over all rows to learn from; the logarithms of the smoothed shares
form a matrix of buckets by languages that is broadcast. A batch of texts is scored at once:
the matrix rows of all its n-grams are added up between the texts' edges.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of, stored

LONGEST = 4
BUCKETS = 1 << 15
#: Added to every count before the logarithm.
SMOOTHING = 0.5
#: The matrix has BUCKETS rows and this many columns at most (32 MB); a column with more
#: values than that is no language column, and learning from it is refused.
MOST_LANGUAGES = 256
UNDETERMINED = "und"
#: Characters counted or scored at a time, and languages a worker counts before it hands on.
STEP, HELD = 1 << 18, 32

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case words between single blanks; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


def _hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """Per length, the bucket of the n-gram that starts at each character; those that would
    cross the end of ``points`` are left out."""
    value = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        if n > len(points):
            return
        value = value[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1:]
        mixed = value * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        yield (mixed >> np.uint32(16)) ^ (mixed & np.uint32(0xFFFF))


def _pieces(words: str) -> Iterator[np.ndarray]:
    """The code points, a step at a time, each step with the characters that its last
    n-grams reach into."""
    for start in range(0, len(words), STEP):
        yield np.frombuffer(words[start: start + STEP + LONGEST - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(words: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of ``words``, some at a time; each n-gram once."""
    for points in _pieces(words):
        for hashed in _hashes(points):
            # A step's own n-grams are those that start in it.
            yield hashed[:STEP] & np.uint32(buckets - 1)


def counted(docs: DataFrame, *, text_col: str, lang_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows, and per language its rows as bucket -1."""
    schema = T.StructType([
        T.StructField("lang", T.StringType(), False), T.StructField("bucket", T.IntegerType(), False),
        T.StructField("n", T.LongType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        rows: Counter[str] = Counter()

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(used) + 1), arrow.field("lang").type),
                     pa.array(np.append(used, -1).astype("int32")), pa.array(np.append(counts[used], rows[lang]))],
                    schema=arrow,
                )
            held.clear()
            rows.clear()

        for batch in rows_of(batches, 64):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = letters(text)
                if not words:
                    continue
                if lang not in held and len(held) >= HELD:
                    yield from handed_on()
                counts = held.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                rows[lang] += 1
                for found in grams(words, buckets):
                    counts += np.bincount(found, minlength=buckets)
        yield from handed_on()

    learned = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    return learned.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages in order, the logarithm of each one's share of the rows, and per bucket
    and language the logarithm of the bucket's share."""
    languages: list[str]
    prior: np.ndarray
    table: np.ndarray


def learn(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS,
    smoothing: float = SMOOTHING, most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Naive Bayes from every row with a language and a letter in its text.

    All rows are counted, on the executors; what reaches the driver is one number per
    bucket and language. More than ``most_languages`` values: ValueError. No row to learn
    from: a model without languages.
    """
    counts = stored(counted(docs, text_col=text_col, lang_col=lang_col, buckets=buckets), "language-counts")
    languages = [r.lang for r in counts.where("bucket = -1").select("lang").orderBy("lang").limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    languages.sort()
    totals = np.zeros((buckets + 1, len(languages)))
    if languages:
        found = counts.toArrow()
        code = found.column("lang").combine_chunks().dictionary_encode()
        place = {lang: k for k, lang in enumerate(languages)}
        column = np.array([place[x] for x in code.dictionary.to_pylist()])[code.indices.to_numpy()]
        totals[found.column("bucket").to_numpy(), column] = found.column("n").to_numpy()
    rows, used = totals[buckets], totals[:buckets] + smoothing
    return Model(
        languages, np.log(rows / max(rows.sum(), 1.0)) if languages else rows, np.log(used / used.sum(axis=0)).astype(np.float32)
    )


def log_likelihoods(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Per text (as ``letters`` returns it) and language, the sum of its n-grams' rows."""
    sums = np.zeros((len(texts), table.shape[1]))
    buckets = table.shape[0]
    start = 0
    while start < len(texts):
        # Neighbours that make up a step together are one run of characters.
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= STEP):
            size += len(texts[end])
            end += 1
        group = [k for k in range(start, end) if texts[k]]
        if len(group) == 1:
            for found in grams(texts[group[0]], buckets):
                for lang in range(table.shape[1]):
                    sums[group[0], lang] += table[:, lang][found].sum(dtype=np.float64)
        elif group:
            points = np.frombuffer("".join([texts[k] for k in group]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            edges = np.cumsum([0, *[len(texts[k]) for k in group]])
            for n, hashed in enumerate(_hashes(points), 1):
                hashed = hashed & np.uint32(buckets - 1)
                # A text's n-grams are those that end inside it; the others between weigh 0.
                own = np.repeat(edges[1:], np.diff(edges))[: len(hashed)] >= np.arange(n, n + len(hashed))
                for lang in range(table.shape[1]):
                    weighed = np.append(np.where(own, table[:, lang][hashed], 0.0), np.zeros(n - 1))
                    sums[group, lang] += np.add.reduceat(weighed.astype(np.float64), edges[:-1])
        start = end
    return sums


def predict(
    docs: DataFrame, model: Model, *, keep: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, the columns of ``keep``, lang_pred and score; one row per row of ``docs``.

    The score is the posterior probability of the predicted language; on a tie the first in
    order is taken. ``und`` with score 0 for a text that is null or has no letter, and with
    a model that knows no language. Texts of any length are scored whole, a step at a time;
    null and repeated ids stay as they are; an empty table gives no rows. Other columns are
    not read. One scan, no shuffle.
    """
    keep = keep or {}
    head = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(name) for name, c in keep.items()]).schema.fields
    schema = T.StructType([*head, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    arrow = arrow_schema(schema)
    # Buckets times MOST_LANGUAGES floats at most.
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, table = held.value
        table = np.asfortranarray(table)
        for batch in rows_of(batches, 128):
            texts = [letters(t or "") if languages else "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if languages:
                logs = log_likelihoods(texts, table) + prior
                best = logs.argmax(axis=1)
                share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for k, words in enumerate(texts):
                    if words:
                        found[k], scores[k] = languages[best[k]], share[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, arrow.field("lang_pred").type), pa.array(scores)], schema=arrow
            )

    columns = [F.col(id_col).alias("doc_id"), *[c.alias(name) for name, c in keep.items()], F.col(text_col).alias("text")]
    return docs.select(*columns).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from; a null id belongs to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for all of ``docs``, learned from its rows outside the held-out fold:
    doc_id, held_out, lang_pred, score. See ``learn`` and ``predict``."""
    fold = held_out(id_col)
    model = learn(docs.where(~fold), text_col=text_col, lang_col=lang_col)
    return predict(docs, model, keep={"held_out": fold}, id_col=id_col, text_col=text_col)
