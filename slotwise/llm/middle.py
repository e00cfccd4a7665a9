"""Fill-in-the-middle: a text's middle is moved to its end, in place, and back.

A scan over the UTF-8 bytes counts the tokens and finds the two cuts. The sentinels are
inserted into one bytearray, which then holds ``<P>`` prefix ``<M>`` middle ``<S>`` suffix,
and a rotation by three reversals exchanges two neighbouring segments: middle and suffix
(prefix, suffix, middle: ``psm``), or suffix and everything before it (``spm``). To restore,
the same rotation is inverted and the sentinels are taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.common import arrow_schema, rows_of

SEED = 42
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are cut; of 100 cut ones, so many put the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 50, 80
#: Bytes that one step of a scan or of a reversal looks at.
STEP = 1 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _token_ends(data: bytes | bytearray) -> Iterator[np.ndarray]:
    """The ends of the tokens, by steps: white space belongs to the word after it, and at
    the end of the text it is a token by itself."""
    view = np.frombuffer(data, dtype=np.uint8)
    for start in range(0, len(view), STEP):
        part = view[start: start + STEP + 1]
        white = _WHITE[part]
        last = start + STEP >= len(view)
        follows = np.append(white[1:], True) if last else white[1:]
        here = white if last else white[:-1]
        ends = np.flatnonzero(~here & follows) + start + 1
        yield np.append(ends, len(view)) if last and white[-1] else ends


def token_count(data: bytes) -> int:
    return sum(len(ends) for ends in _token_ends(data))


def offsets(data: bytes, first: int, second: int) -> tuple[int, int]:
    """The bytes before token number ``first`` and ``second`` (first <= second)."""
    found, seen = [0 if k == 0 else -1 for k in (first, second)], 0
    for ends in _token_ends(data):
        for k, wanted in enumerate((first, second)):
            if seen < wanted <= seen + len(ends):
                found[k] = int(ends[wanted - seen - 1])
        seen += len(ends)
        if seen >= second:
            break
    return found[0], found[1]


def _reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverses buffer[start:end], exchanging mirrored steps from both ends."""
    while end - start > 2 * STEP:
        left = buffer[start: start + STEP].copy()
        buffer[start: start + STEP] = buffer[end - STEP: end][::-1]
        buffer[end - STEP: end] = left[::-1]
        start, end = start + STEP, end - STEP
    buffer[start:end] = buffer[start:end][::-1].copy()


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the neighbours buffer[start:middle] and buffer[middle:end] in place."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, end)
    _reverse(view, start, end)


def arranged(data: bytes, first: int, second: int, form: str) -> bytearray:
    """``data`` cut at the two byte offsets, in the order of ``form``."""
    buffer = bytearray(data)
    if form == "plain":
        return buffer
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return buffer


def rebuilt(data: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given, from its output and form alone."""
    if form == "plain":
        return bytes(data)
    buffer = bytearray(data)
    if form == "spm":
        # Suffix, prefix and middle: the suffix goes behind them.
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    else:
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    # Last sentinel first, as each one taken out moves what is behind it.
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at: at + len(sentinel)]
    return bytes(buffer)


def _code_points(data: bytes) -> int:
    view = np.frombuffer(data, dtype=np.uint8)
    return sum(int(((view[at: at + STEP] & 0xC0) != 0x80).sum()) for at in range(0, len(view), STEP))


def cut_text(data: bytes, draws: list[int], cut_share: int, suffix_first_share: int) -> tuple:
    """(n, form, prefix characters, middle characters, output) of one text."""
    n = token_count(data)
    plain = not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= cut_share
    if plain:
        return n, "plain", None, None, data
    form = "spm" if draws[3] % 100 < suffix_first_share else "psm"
    first, second = offsets(data, *sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    view = memoryview(data)
    return n, form, _code_points(view[:first]), _code_points(view[first:second]), bytes(arranged(data, first, second, form))


def _draws(seed: int, id_col: str) -> Column:
    """The first four 8-digit groups of the hashed id, as an array of numbers."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    digits = F.sha2(name.cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(
    docs: DataFrame, *, seed: int = SEED, cut_share: int = CUT_SHARE, suffix_first_share: int = SUFFIX_FIRST_SHARE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each text with its middle moved to the end: doc_id, n (tokens), form, prefix_chars,
    middle_chars, output; one row per row of ``docs``.

    ``form`` is ``psm``, ``spm`` or ``plain``; a plain output is the text itself, and its
    two lengths are null. A null or empty text, and one that holds a sentinel, is plain.
    White space alone is one token. A null id is drawn as the word ``null``; rows that
    repeat an id draw alike. Texts of any length are read whole, a step at a time, and held
    twice. An empty table gives no rows. Other columns are not read. One scan, no shuffle.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n", T.LongType(), False),
        T.StructField("form", T.StringType(), False),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType(), False),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            draws = batch.column(1).to_pylist()
            made = [
                cut_text(memory.as_buffer().to_pybytes() if memory.is_valid else b"", drawn, cut_share, suffix_first_share)
                for memory, drawn in zip(batch.column(2), draws, strict=True)
            ]
            n, form, prefix, middle, output = (list(c) for c in zip(*made, strict=True)) if made else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, arrow.field("form").type),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                 pa.array(output, pa.binary()).cast(arrow.field("output").type)], schema=arrow,
            )

    columns = [F.col(id_col).alias("doc_id"), _draws(seed, id_col).alias("draws"), F.col(text_col).alias("text")]
    return docs.select(*columns).mapInArrow(run, schema)


def restore(arranged_rows: DataFrame, *, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The rows of ``transform`` with ``restored``, the text rebuilt from output and form.

    A null output stays null; a form other than ``psm`` and ``spm`` counts as plain, and so
    does a cut output from which a sentinel has gone. Another column named ``restored`` is
    replaced.
    """
    kept = arranged_rows.drop("restored")
    schema = T.StructType([*kept.schema.fields, T.StructField("restored", T.StringType())])
    arrow, form_at, output_at = arrow_schema(schema), kept.columns.index(form_col), kept.columns.index(output_col)

    def text(output, form) -> bytes | None:
        if not output.is_valid:
            return None
        data = output.as_buffer().to_pybytes()
        whole = form in ("psm", "spm") and all(s in data for s in (PREFIX, SUFFIX, MIDDLE))
        return rebuilt(data, form if whole else "plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            forms = batch.column(form_at).to_pylist()
            texts = [text(o, f) for o, f in zip(batch.column(output_at), forms, strict=True)]
            restored = pa.array(texts, pa.binary()).cast(arrow.field("restored").type)
            yield pa.RecordBatch.from_arrays([*batch.columns, restored], schema=arrow)

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` and ``restore`` as sha256 of the output and of the restored text."""
    return restore(transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS t,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM hashed),
cut AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {CUT_SHARE}
              THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM split),
parts AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(t[b + 1:n], ''), '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
