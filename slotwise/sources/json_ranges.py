"""Large JSON arrays read in ranges, by many tasks.

Spark's text reader splits a file where a separator stands; the separator here is the
closing brace, which also stands inside strings and after nested objects. Each piece of
text between two braces therefore says how it changes the reading: whether it leaves the
reader inside a string, and how many objects it opens and closes. Running sums of that
inside each range, and over one summary row per range, give the state before every piece;
pieces are joined to records where the depth comes back to zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGE = ["path", "start"]


def _pieces(spark: SparkSession, prefix: str, pattern: str, larger_than: int) -> DataFrame:
    """path, start (of the range), place (in the file's order), text up to the next brace."""
    about = F.col("_metadata")
    return (
        spark.read.option("lineSep", "}").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .text(prefix)
        .where(about["file_size"] > larger_than)
        .select(
            about["file_path"].alias("path"), about["file_block_start"].alias("start"), about["file_size"].alias("size"),
            F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
        )
    )


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)


def _opened(plain: Column) -> Column:
    """Objects opened outside strings, when the text starts outside one."""
    every, first = _count(plain, "{"), _count(F.substring_index(plain, '"', 1), "{")
    strings_cut = F.regexp_replace(plain, r'"[^"]*+(?:"|$)', "")
    # Braces before the first quotation mark need no look at strings.
    return F.when(every == first, first).otherwise(_count(strings_cut, "{"))


def _facts(pieces: DataFrame) -> DataFrame:
    """Per piece: bytes, flips (whether it ends in the other state of being inside a string),
    and by how much the depth changes when it starts outside of one (change0) or inside (change1).

    All that the text tells is noted here, so that windows need not hold the text."""
    plain = _unescaped(F.col("text"))
    seen = pieces.withColumn("plain", plain).withColumns({"flips": _count(F.col("plain"), '"') % 2, "opened": _opened(F.col("plain"))})
    # What is outside strings in one reading is inside them in the other. The brace after a
    # piece closes an object where it stands outside a string.
    return seen.withColumns({
        "change0": F.col("opened") - (1 - F.col("flips")),
        "change1": _count(F.col("plain"), "{") - F.col("opened") - F.col("flips"),
        "bytes": F.octet_length("text") + 1,
    }).drop("plain", "opened")


def _change(inside: Column) -> Column:
    return F.when(inside, F.col("change1")).otherwise(F.col("change0"))


def _ranges(facts: DataFrame) -> DataFrame:
    """One row per range: the state before it (inside, depth), and the bytes of its file."""
    order = W.partitionBy(*_RANGE).orderBy("place")
    before = F.coalesce(F.sum("flips").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2
    seen = facts.withColumn("before", before)
    summary = seen.groupBy(*_RANGE).agg(
        (F.sum("flips") % 2).alias("flips"),
        F.sum(_change(F.col("before") == 1)).alias("change0"), F.sum(_change(F.col("before") == 0)).alias("change1"),
        F.sum("bytes").alias("bytes"),
    )
    earlier = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    stated = summary.withColumn("inside", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2 == 1)
    return stated.withColumn("change", _change(F.col("inside"))).select(
        *_RANGE, "inside", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"),
        F.sum("bytes").over(W.partitionBy("path")).alias("bytes"), (F.max("start").over(W.partitionBy("path")) == F.col("start")).alias("last"),
    )


def _numbered(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces with whether a record ends behind them, how many of the range ended before
    (number) and end in it (count)."""
    order = W.partitionBy(*_RANGE).orderBy("place")
    upto, before = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, -1)
    known = (
        facts.drop("bytes").withColumns({
            "before": F.coalesce(F.sum("flips").over(before), F.lit(0)), "final": F.lead("place").over(order).isNull(),
        })
        .join(ranges.withColumnRenamed("inside", "begins"), _RANGE)
        .withColumn("inside", (F.col("begins").cast("int") + F.col("before")) % 2 == 1)
        # Behind the last piece there is a brace only if the file ends with one; a byte
        # order mark is no part of the text.
        .withColumn("cut", F.col("final") & F.col("last") & (F.col("size") - F.col("bytes")).isin(-1, 2))
        .withColumn("change", _change(F.col("inside")))
    )
    closed = ((F.col("inside").cast("int") + F.col("flips")) % 2 == 0) & ~F.col("cut")
    deep = known.withColumn("after", F.col("depth") + F.sum("change").over(upto)).withColumn(
        "ends", closed & (F.col("after") == 0) & ((F.col("after") - F.col("change") > 0) | (F.col("change") >= 0))
    )
    return deep.withColumns({
        "number": F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)),
        "count": F.sum(F.col("ends").cast("int")).over(W.partitionBy(*_RANGE)),
    })


def array_records(spark: SparkSession, prefix: str, pattern: str, larger_than: int) -> DataFrame:
    """The objects of every file above ``larger_than`` bytes under a prefix: path, record
    (its text), whole (false for what is no record: text that is left open, or stands
    between records).

    The files are read three times: twice for numbers about each piece, which tell the state
    before each range, and once for the text. Windows hold the pieces of one range, and one
    row per range of a file. A brace inside a record that is no JSON is
    taken at its word, so such a record costs itself as long as its braces and quotation
    marks pair up; what does not pair up costs the rest of its file.
    """
    facts = _facts(_pieces(spark, prefix, pattern, larger_than))
    ranges = _ranges(facts)
    numbered = _numbered(facts, ranges)
    # A range's last, unended record goes on in the ranges after it. It is named by where it
    # began: the last range that ended a record, or the file's start.
    went_on = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ends_of = numbered.groupBy(*_RANGE).agg(F.max("count").alias("count"))
    owners = ends_of.select(
        *_RANGE, F.last(F.when(F.col("count") > 0, F.col("start")), ignorenulls=True).over(went_on).alias("owner"),
    )
    keyed = numbered.join(owners, _RANGE).select(
        "path", "place", "text", "ends",
        F.when(F.col("number") == 0, F.coalesce("owner", F.lit(-1))).otherwise(F.col("start")).alias("owner"),
        F.when((F.col("number") == F.col("count")) | (F.col("number") == 0), F.lit(-1)).otherwise(F.col("number")).alias("number"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "}")
    joined = keyed.groupBy("path", "owner", "number").agg(text.alias("text"), F.max("ends").alias("whole"))
    # What stands before a record are brackets, commas and blanks.
    lead = r"^[\s\[\],\x{FEFF}]*+"
    return joined.select(
        "path", F.concat(F.regexp_replace("text", lead, ""), F.when(F.col("whole"), "}").otherwise("")).alias("record"), "whole",
    ).where(F.col("whole") | (F.col("record") != ""))
