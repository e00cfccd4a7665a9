"""Mixing sources to target weights by Poisson replication.

A source's target share of the mixture over its own share of the corpus is the mean number
of copies of its documents. Each document draws its number of copies by inverting a Poisson
distribution with that mean at a uniform number hashed from the seed and its id, so a
re-run, or a lost task, draws the same; the copies are then shuffled globally.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

SEED = 17
#: A larger mean is drawn as a sum of Poisson numbers with at most this mean each, as the
#: distribution is inverted in doubles.
LARGEST_MEAN = 256.0
#: The sources' rates are broadcast up to so many of them (some 40 MB at most); beyond it
#: texts are shuffled by source first.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(X <= k) for k from 0 until the rest is below double precision."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda acc, k: F.struct(
            (acc["p"] * mean / k).alias("p"),
            F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["p"] * mean / k)).alias("sums"),
        ),
        lambda acc: acc["sums"],
    )


def rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, size: float = 1.0,
    source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per source: source, mass, rate (mean copies), parts, sums (of one part).

    Mass is the characters of a source's texts, and one more per document. ``weights`` are
    its target weights; a source not named there has weight 0. Without them the weights are
    the square roots of the masses, between even and natural shares. ``size`` is the
    mixture's expected mass over the corpus's.
    """
    mass = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1).alias("mass")
    )
    if weights is None:
        weight = F.sqrt(F.col("mass").cast("double"))
    else:
        named = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else None
        weight = F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = mass.withColumn("weight", weight)
    totals = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(
        F.col("all_weight") > 0,
        F.lit(float(size)) * F.col("weight") * F.col("all_mass").cast("double") / (F.col("all_weight") * F.col("mass").cast("double")),
    ).otherwise(F.lit(0.0))
    rated = weighed.join(totals).select("source", "mass", rate.alias("rate"))  # one row of totals
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")
    return rated.withColumn("parts", parts).withColumn("sums", _distribution(F.col("rate") / F.col("parts")))


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, size: float = 1.0, seed: int = SEED,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "mix_",
) -> DataFrame:
    """``docs`` mixed to the target weights, in a global random order.

    Returns every column of ``docs`` and mix_rate (mean copies of its source), mix_copy
    (from 1) and mix_key (hex digits; rows are in its order inside each partition, and a
    row's partition is drawn by it). A document with no copies is left out. A null source
    is a source of its own (named "" in ``weights``); null or empty texts count one
    character; null ids draw as one id does, and rows that repeat an id draw alike. No
    weight at all, or an empty table: no rows. Columns of ``docs`` that carry these names
    already are kept if another ``prefix`` is given.
    """
    own, table = docs.columns, stored(rates(docs, weights, size=size, source_col=source_col, text_col=text_col), "mixing-rates")
    names = {c: f"__{prefix}{c}" for c in table.columns}
    few = table.count() <= BROADCAST_SOURCES
    table = table.select(*[F.col(c).alias(n) for c, n in names.items()])
    table = F.broadcast(table) if few else table
    joined = docs.join(table, docs[source_col].eqNullSafe(table[names["source"]]))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col(names["parts"])),
        lambda p: F.size(F.filter(
            F.col(names["sums"]), lambda s: s <= _uniform(F.lit(str(seed)), p.cast("string"), key)
        )),
    )
    copies = F.aggregate(drawn, F.lit(0), lambda total, n: total + n)
    kept = joined.withColumn(f"__{prefix}n", copies).where(F.col(f"__{prefix}n") > 0)
    out = kept.select(
        *own, F.col(names["rate"]).alias(f"{prefix}rate"),
        F.explode(F.sequence(F.lit(1), F.col(f"__{prefix}n"))).alias(f"{prefix}copy"),
    )
    out = out.withColumn(
        f"{prefix}key", F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), key, F.col(f"{prefix}copy"))), 1, 16)
    )
    return out.repartition(F.col(f"{prefix}key")).sortWithinPartitions(f"{prefix}key")


ORACLE = f"""
WITH mass AS (SELECT source, sum(coalesce(length(text), 0) + 1) AS mass FROM documents GROUP BY source),
rated AS (
  SELECT source, sqrt(CAST(mass AS DOUBLE)) * CAST(sum(mass) OVER () AS DOUBLE)
         / (sum(sqrt(CAST(mass AS DOUBLE))) OVER () * CAST(mass AS DOUBLE)) AS rate FROM mass),
most AS (SELECT CAST(ceil(max(rate) + 12 * sqrt(max(rate)) + 40) AS BIGINT) AS k FROM rated),
terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rated, unnest(range(0, (SELECT k FROM most) + 1)) AS r(k)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms),
drawn AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.text, d.lang, d.source, d.n_chars,
         CAST('0x' || substr(md5(concat_ws(':', '{SEED}', '1', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 1, 13) AS BIGINT)
         / 4503599627370496.0::DOUBLE AS u FROM documents d),
counted AS (
  SELECT r, doc_id, text, lang, d.source, n_chars, any_value(rate) AS rate, count(*) FILTER (WHERE s <= u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY r, doc_id, text, lang, d.source, n_chars)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, CAST(copy AS INTEGER) AS mix_copy,
       substr(md5(concat_ws(':', '{SEED}', 'order', coalesce(CAST(doc_id AS VARCHAR), 'null'), CAST(copy AS VARCHAR))), 1, 16) AS mix_key
FROM counted, unnest(range(1, n + 1)) AS c(copy)
"""
