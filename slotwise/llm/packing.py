"""Concatenate and cut: documents as one long run of token ids, cut into fixed windows.

Pass one encodes every document once, writes the ids and notes where each document starts
inside its partition. A prefix sum over the partition totals (one row per partition) then
gives every document its global offset, and pass two cuts the run at multiples of the
window: a document that crosses a window's edge gives one record on either side of it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of, stored

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Words, and their parts, remembered by one worker; at the bound the memory is emptied and filled anew.
REMEMBERED = 1_600_000

_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Python's split() takes these for white space, the vocabulary's own rules do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others for letters from 256 on, in their order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTER = _byte_letters()
#: Latin letters that the vocabulary's normalization does nothing to but lower them, one by one.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")


class _Memory(dict):
    """Values by key, made when first asked for; emptied at the bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The vocabulary never joins characters across white space, nor a run of letters with
    the ASCII punctuation beside it (but for apostrophes), so a text's ids are those of its
    words in order, and each word is encoded once and remembered. A word of letters alone
    is one unit to the vocabulary: its merges are applied to its bytes at once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._normalized = self._tokenizer.normalizer.normalize_str
        self._merged = self._tokenizer.model.tokenize
        self._words = _Memory(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, plain: str) -> bytes:
        unit = plain if plain.isascii() else "".join([_LETTER[b] for b in plain.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self._merged(unit)])

    def _word(self, word: str) -> bytes:
        """Leading punctuation, letters, trailing punctuation; or the word as it is, also
        where lower-casing gives a mark, which the vocabulary joins with the punctuation."""
        core = word.strip(_PUNCTUATION)
        if core.isalpha() if core.isascii() else _LATIN.fullmatch(core):
            letters = plain = core.lower()
        elif core.isalpha() and (plain := self._normalized(core)).isalpha():
            letters = core
        else:
            return self._whole(word)
        if letters == word:
            return self._unit(plain)
        known, size = self._words, len(core)
        if size == len(word):
            return known[letters]
        start = word.index(core)
        return b"".join([known[p] for p in (word[:start], letters, word[start + size:]) if p])

    def encode(self, text: str) -> bytes:
        if "<|" in text or _SEPARATORS.search(text):
            return self._whole(text)
        return b"".join(map(self._words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Encoder(vocabulary)


def encoded(
    docs: DataFrame, *, vocabulary: str = VOCABULARY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, part (partition), at (ids before it in its partition), n, ids.

    A null text counts as empty; every document ends with ``end_id``.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("at", T.LongType(), False),
        T.StructField("n", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),
    ])
    arrow, last = arrow_schema(schema), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in rows_of(batches):
            ids = [encode(text or "") + last for text in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], dtype="int64")
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n),
                 pa.array(ids, arrow.field("ids").type)], schema=arrow,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(
    docs: DataFrame, *, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents in sequences of ``window`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row per
    piece; every sequence but the last is full. Rows are packed in the order of the input's
    partitions. Null or empty text: one piece with the end id alone. Repeated rows, null or
    repeated ids: each row is packed by itself. Very long texts give one piece per window.
    An empty table gives no rows. Other columns are not read.
    """
    tokens = stored(encoded(docs, vocabulary=vocabulary, end_id=end_id, id_col=id_col, text_col=text_col), "packing")
    totals = tokens.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row of two numbers per partition of the input: its size is bound by their number.
    placed = tokens.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("first"), "ids"
    )
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        *(T.StructField(name, T.LongType(), False)
          for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
    ])
    arrow = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            owner, out = [], []
            for row, (first, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                data = memoryview(ids.as_buffer())
                n, start = len(data) // 4, 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    owner.append(row)
                    out.append((start, length, zlib.crc32(data[4 * start: 4 * (start + length)]), n, sequence, offset))
                    start += length
            if out:
                columns = np.array(out, dtype="int64").T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), *(pa.array(c) for c in columns)], schema=arrow
                )

    return placed.mapInArrow(cut, schema)
