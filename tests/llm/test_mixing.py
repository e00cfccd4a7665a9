"""Mixing against SQL, and its distribution."""

import math
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slotwise.llm import mixing
from tests.llm import cases
from tools.check import compare


def test_query_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    same, text, _ = compare(spark, con, "op1_mixing", cases.SF, entry.queries(), entry.oracle_sql())
    assert same, text


def test_weights_are_reached(spark):
    df = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("source")
    )
    mixed = mixing.mix(df, {"a": 1.0, "b": 3.0}, size=2.0)
    n = Counter(r.source for r in mixed.select("source").collect())
    assert abs(n["a"] - 30_000) < 900 and abs(n["b"] - 90_000) < 1500
    copies = Counter(mixed.where("source = 'b'").groupBy("doc_id").count().select("count").toPandas()["count"])
    mean = 90_000 / 18_000
    for k in (3, 5, 8):
        assert abs(copies[k] / 18_000 - math.exp(-mean) * mean**k / math.factorial(k)) < 0.012


def test_large_means_are_sums(spark):
    df = cases.documents(spark, ["x"] * 3)
    n = mixing.mix(df, size=1000.0).groupBy("doc_id").count().toPandas()["count"]
    assert len(n) == 3 and all(abs(k - 1000) < 200 for k in n)


def test_awkward_rows(spark):
    df = cases.odd(spark).withColumn("source", F.when(F.col("doc_id") == 3, None).otherwise(F.col("source")))
    once = mixing.mix(df, size=4.0)
    assert once.columns == [*df.columns, "mix_rate", "mix_copy", "mix_key"]
    assert sorted(map(str, once.collect())) == sorted(map(str, mixing.mix(df, size=4.0).collect()))
    twice = Counter(r.mix_copy for r in once.where("doc_id = 5").collect())
    assert all(n % 2 == 0 for n in twice.values())
    assert mixing.mix(df, {}).count() == 0 and mixing.mix(cases.empty(spark)).count() == 0
    assert {r.source for r in mixing.mix(df, {"": 1.0}, size=9.0).collect()} <= {None}
    clash = mixing.mix(df.withColumn("mix_rate", F.lit(1)), prefix="own_")
    assert "mix_rate" in clash.columns and "own_rate" in clash.columns
