"""Rows that every operator must take: nulls, empty and very long texts, repeated rows,
clashing extra columns."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"wort{k % 977}x{k % 31}" for k in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts):
    """Texts, or (id, text) pairs, as rows of documents."""
    pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return [(k, t, "en", f"src{(k or 0) % 3}", len(t or "")) for k, t in pairs]


def documents(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def odd(spark, more=()):
    """The awkward rows, with columns whose names the operators use for their results."""
    texts = [None, "", "   \n\t ", "é", LONG, (5, "same text in two rows"), (5, "same text in two rows"), (None, "no id here"), *more]
    df = documents(spark, texts)
    names = ("score", "n_words", "ids", "spans", "n", "grp", "component_id", "value", "part", "held_out", "rate", "id", "row")
    return df.select("*", *[F.lit("x").alias(name) for name in names])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
