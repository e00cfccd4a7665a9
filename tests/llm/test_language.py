"""Language identification against a plain reading of the model, and on held-out rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import language, queries
from tests.llm import cases


def bucket(gram, buckets):
    value = 0
    for c in gram:
        value = (value * 0x01000193 + ord(c)) % 2**32
    mixed = (value * 0x9E3779B1 + len(gram) * 0x85EBCA6B) % 2**32
    return ((mixed >> 16) ^ (mixed & 0xFFFF)) & (buckets - 1)


def plain_grams(words, buckets=language.BUCKETS):
    return Counter(
        bucket(words[k: k + n], buckets) for n in range(1, language.LONGEST + 1) for k in range(len(words) - n + 1)
    )


class Plain:
    def __init__(self, rows, buckets=language.BUCKETS):
        self.counts, self.rows = defaultdict(Counter), Counter()
        for text, lang in rows:
            words = language.letters(text or "")
            if words and lang is not None:
                self.counts[lang] += plain_grams(words, buckets)
                self.rows[lang] += 1
        self.sizes = {lang: sum(c.values()) + language.SMOOTHING * buckets for lang, c in self.counts.items()}
        self.buckets = buckets

    def __call__(self, text):
        words = language.letters(text or "")
        if not words or not self.rows:
            return "und", 0.0
        logs = {
            lang: math.log(self.rows[lang] / sum(self.rows.values())) + sum(
                n * math.log((c[b] + language.SMOOTHING) / self.sizes[lang]) for b, n in plain_grams(words, self.buckets).items()
            ) for lang, c in self.counts.items()
        }
        best = max(sorted(logs), key=logs.get)
        return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def test_query_matches_a_plain_reading(spark):
    rows = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    plain = Plain([(r.text, r.lang) for r in rows if crc(r.doc_id) != 2])
    found = {r.doc_id: r for r in queries.op12_language(spark, cases.SF).collect()}
    assert len(found) == len(rows)
    for r in rows:
        lang, score = plain(r.text)
        assert (found[r.doc_id].lang_pred, found[r.doc_id].held_out) == (lang, crc(r.doc_id) == 2)
        assert abs(found[r.doc_id].score - score) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op12_language(spark, "/root/testdata/sf0.01").where("held_out")
    judged = found.join(docs.where("lang is not null"), "doc_id").select((F.col("lang_pred") == F.col("lang")).cast("int").alias("right"))
    row = judged.agg(F.avg("right").alias("share"), F.count("*").alias("n")).first()
    assert row.n > 150 and row.share > 0.97


@pytest.mark.parametrize("step", [5, 64, 1 << 18])
def test_steps_change_nothing(monkeypatch, step):
    monkeypatch.setattr(language, "STEP", step)
    rng = np.random.default_rng(2)
    table = rng.normal(size=(64, 3)).astype(np.float32)
    texts = ["", " a ", " ab ", " the quick brown fox jumps ", " é ", "", " " + "lorem ipsum " * 30, " z " * 7]
    sums = language.log_likelihoods(texts, np.asfortranarray(table))
    for text, row in zip(texts, sums, strict=True):
        want = sum((n * table[b].astype(float) for b, n in plain_grams(text, 64).items()), np.zeros(3))
        assert np.allclose(row, want, atol=1e-4)
        assert Counter(int(b) for part in language.grams(text, 64) for b in part) == plain_grams(text, 64)


def test_awkward_rows(spark):
    texts = [(300 + k, "der hund und die katze") for k in range(20)] + [(400 + k, "the dog and the cat") for k in range(20)]
    texts += [(500, "1234 ... 漢字"), (501, "12 34 !?"), (502, "_")]
    df = cases.odd(spark, texts).withColumn(
        "lang", F.when(F.col("text").contains("hund"), "de").when(F.col("text").contains("dog"), "en")
    ).withColumn("lang_pred", F.lit("x")).withColumn("bucket", F.lit("x"))
    out = language.identify(df.repartition(3)).collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out}
    assert all(by[300 + k].lang_pred == "de" and by[400 + k].lang_pred == "en" for k in range(20))
    assert (by[0].lang_pred, by[0].score) == (by[1].lang_pred, by[1].score) == (by[2].lang_pred, by[2].score) == ("und", 0.0)
    assert by[501].lang_pred == by[502].lang_pred == "und" and by[500].lang_pred != "und"
    assert by[None].held_out and all(0 <= r.score <= 1 for r in out)
    assert language.identify(cases.empty(spark)).count() == 0
    none = {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()}
    assert none == {"und"}


def test_ties_take_the_first_language(spark):
    rows = [(k, "same words", lang) for k, lang in ((1, "b"), (2, "a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert model.languages == ["a", "b"]
    assert {(r.lang_pred, r.score) for r in language.predict(df, model).collect()} == {("a", 0.5)}


def test_more_languages_than_a_worker_holds(spark, monkeypatch):
    rows = [(k, "abc " * (k % 7 + 1), f"l{k % 90:02}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = {(r.lang, r.bucket): r.n for r in language.counted(df, text_col="text", lang_col="lang").collect()}
    plain = Plain([(t, lang) for _, t, lang in rows])
    want = {(lang, b): n for lang, c in plain.counts.items() for b, n in c.items()} | {(lang, -1): n for lang, n in plain.rows.items()}
    assert got == want
    with pytest.raises(ValueError):
        language.learn(df, most_languages=50)
