"""Slots that the stream closed before all of their records had come.

The stream drops a record whose slot its watermark has passed. The record itself is kept:
samples and frames are also appended in long form, which no watermark limits. Slots counted
from these are held against what the stream wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators.slots import KEYS

#: Counts of a slot row, and what the records beyond them are called.
COUNTS = {"frame_count": "late_frames", "speed_count": "late_samples"}


def late_slots(stored: DataFrame, streamed: DataFrame) -> DataFrame:
    """The rows of ``stored`` that tell more than those of ``streamed``, in their closed slots.

    ``stored`` holds slot rows over all records (the streaming aggregation, run over the
    stored records as a batch), ``streamed`` what the stream wrote. Each row comes with the
    number of its late records (``late_frames``, ``late_samples``) and ``missed``: the
    stream has no row of that slot. A late weather document changes ``weather`` alone. As a
    watermark closes slots in order, a slot is closed when the stream wrote it or a later
    one; where it wrote nothing, none is. Restrict both sides to the days of interest: they
    are joined once, by camera and slot.
    """
    counts = [c for c in COUNTS if c in stored.columns]
    seen = [*counts, *(["weather"] if "weather" in stored.columns else [])]
    old = streamed.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in seen], F.lit(True).alias("_seen"))
    # One row: the newest slot that was written.
    closed = streamed.agg(F.max("slot").alias("_upto"))
    both = stored.join(closed, F.col("slot") <= F.col("_upto")).join(old, KEYS, "left")
    late = {COUNTS[c]: F.col(c) - F.coalesce(f"_{c}", F.lit(0)) for c in counts}
    differs = F.col("_seen").isNull()
    for name in late.values():
        differs = differs | (name > 0)
    if "weather" in seen:
        differs = differs | ~F.col("weather").eqNullSafe(F.col("_weather"))
    return both.where(differs).select(
        *stored.columns, *[value.alias(name) for name, value in late.items()], F.col("_seen").isNull().alias("missed")
    )


def mended(streamed: DataFrame, late: DataFrame) -> DataFrame:
    """``streamed`` with the rows of :func:`late_slots` in place of its own."""
    return streamed.join(late.select(*KEYS), KEYS, "left_anti").select(*streamed.columns).unionByName(late.select(*streamed.columns))
