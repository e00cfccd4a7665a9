"""Exact quantiles that never gather or order a column in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.session import fresh_dir

# How many bits of a value's rank-preserving form, 64 in all, the first pass looks at, and each
# further one that has to narrow.
LEADING, FURTHER = 24, 20
# Rows under the wanted bins that a last pass may tell apart value by value.
FEW = 1 << 20


def ordered_bits(value: Column) -> Column:
    """A long that rises with the double; equal doubles, and only they, give equal longs."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: list[float],
    by: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group: columns ``by``, ``prob``, ``quantile``.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here
    a histogram over the leading bits of the values, combined on the map side, brackets each
    wanted rank by one bin. Where every such bin holds a single value, as with whole or
    rounded numbers, that is the answer. Otherwise one more pass counts the values inside
    the brackets; where these hold more than ``FEW`` rows they are written once and narrowed
    by histograms of the bits that follow. What is put in order is bins, of which a pass has
    a fixed number at most, however the values lie.

    ``by`` must name a fixed small set of groups (weekdays, say): the wanted bins of all
    groups, two per group and probability at most, pass through the driver between the
    passes. ``df`` is read by two passes, or once and for the write, and must give the same
    rows each time. Rows with a NULL group or value are left out. ``weight`` names a column
    that says how many times a row counts.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).dropna(subset=by) if by else df.where(F.col(value).isNotNull())
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    rows = rows.withColumn("_o", ordered_bits(F.col("_v")))
    found, wanted = _bracketed(rows, by, 64 - LEADING, probs=probs)
    shift, written = 64 - LEADING, False
    while shift and not all(r["_single"] for r in found):
        held = {(*(r[b] for b in by), r["_bin"]): r["_rows"] for r in found}
        step = shift if sum(held.values()) <= FEW else min(shift, FURTHER)
        if step < shift and not written:
            inside = _inside(rows, by, wanted, shift).groupBy(*by, "_v").agg(F.sum("_w").alias("_w"))
            path, written = fresh_dir(df.sparkSession, "quantiles"), True
            inside.withColumn("_o", ordered_bits(F.col("_v"))).write.parquet(path)
            rows = df.sparkSession.read.parquet(path)
        found, wanted = _bracketed(rows, by, shift - step, wanted=wanted, step=step)
        shift -= step
    pos = F.any_value("_pos")
    return (
        wanted.groupBy(*by, "prob")
        .agg((F.min("_v") + (F.max("_v") - F.min("_v")) * (pos - F.floor(pos))).alias("quantile"))
        .select(*by, "prob", "quantile")
    )


def _inside(rows: DataFrame, by: list[str], wanted: DataFrame, shift: int) -> DataFrame:
    """The rows that share their bits above ``shift`` with a wanted bin, as ``_parent``."""
    # At most two bins per group and probability are wanted.
    parents = F.broadcast(wanted.select(*by, F.col("_bin").alias("_parent")).distinct())
    return rows.withColumn("_parent", F.shiftright("_o", shift)).join(parents, [*by, "_parent"])


def _bracketed(rows, by, shift, probs=None, wanted=None, step=0) -> tuple[list[Row], DataFrame]:
    """The bins of the bits above ``shift`` that hold the wanted ranks, collected and as a
    frame; ranks are those of ``probs``, or the ranks inside the bins ``wanted`` before."""
    rows = rows if wanted is None else _inside(rows, by, wanted, shift + step)
    group = by if wanted is None else [*by, "_parent"]
    bins = rows.groupBy(*group, F.shiftright("_o", shift).alias("_bin")).agg(
        F.sum("_w").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_v"),
        (F.min("_v") == F.max("_v")).alias("_single"),
    )
    bins = bins.withColumn("_last", F.sum("_n").over(W.partitionBy(*group).orderBy("_bin")))
    if wanted is None:
        total = F.sum("_n").over(W.partitionBy(*group))
        bins = bins.withColumn("_total", total).withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        bins = bins.withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
        bins = bins.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    else:
        asked = wanted.select(*by, "prob", "_pos", "_rank", F.col("_bin").alias("_parent"))
        bins = bins.join(F.broadcast(asked), group)
    # Ranks are counted from the bin's start on.
    before = F.col("_last") - F.col("_n")
    kept = bins.where((F.col("_rank") < F.col("_last")) & (F.col("_rank") >= before)).select(
        *by, "prob", "_pos", "_bin", "_v", "_rows", "_single", (F.col("_rank") - before).alias("_rank")
    )
    found = kept.collect()
    return found, rows.sparkSession.createDataFrame(found, kept.schema)
