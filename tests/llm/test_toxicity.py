"""The toxicity grammar, and accuracy on documents held out of the learning."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm import queries, toxicity
from tests.llm import cases

LEXICON = toxicity.Lexicon({"idiot ": 3.0, "foul": 2.0})
KIND = {name: k for k, name in enumerate(toxicity.FEATURES)}


def said(text):
    x = toxicity.features(text, LEXICON)
    return {name for name in toxicity.FEATURES[:7] if x[KIND[name]] > 0}


@pytest.mark.parametrize("text, kinds", [
    ("what an idiot", {"plain"}), ("you are an idiot", {"aimed"}), ("that is not an idiot", {"negated"}),
    ("he said: idiot", {"reported"}), ("he said: you are an idiot", {"reported"}), ("papers wrote that idiot thing", {"reported"}), ('a word like "idiot" here', {"reported"}),
    ("the foulness of it", {"plain"}), ("they kill", {"aimed_threat"}), ("never kill", {"mild_threat"}), ("kill", {"threat"}),
    ("you are kind. an idiot", {"plain"}), ("don't be an idiot", {"negated"}), ("he isn’t an idiot", {"negated"}),
    ("he wrote \u201cit's raining.\u201d you are an idiot", {"aimed"}), ("\u201cit is raining. you idiot. go.\u201d he said", {"reported"}),
    ("an open \u201c quotation\nyou are an idiot", {"aimed"}), ("c'est l'idiot", {"plain"}), ("the students' idiot", {"plain"}), ("nothing at all", set()), ("", set()), (None, set()),
])
def test_grammar(text, kinds):
    assert said(text) == kinds


def one_after_another(word):
    """What the stages write, each reading the whole output of the one before it."""
    weights = [1.0] * len(word)
    for stage in toxicity.stages():
        state, out = stage.start, []
        for k, symbol in enumerate(word):
            state, written, weight = stage.step(state, symbol)
            out.append(written)
            weights[k] *= weight
        word = out
    return list(zip(word, weights))


def test_the_composed_grammar_is_one_stage_after_another():
    rng = np.random.default_rng(4)
    for _ in range(600):
        word = list(rng.choice(sorted(toxicity.INPUT), rng.integers(0, 40)))
        state, got = toxicity.GRAMMAR.start, []
        for symbol in word:
            state, written, weight = toxicity.GRAMMAR.step(state, symbol)
            got.append((written, weight))
        want = one_after_another(word)
        assert [w for w, _ in got] == [w for w, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want])


def by_hand(word):
    """A plain reading of the grammar: each hit by looking back in its clause."""
    out = []
    for k, symbol in enumerate(word):
        if symbol not in "WH":
            continue
        start = max((j + 1 for j in range(k) if word[j] in "BP"), default=0)

        def back(trigger, window):
            """Symbols since the last trigger of the clause, if within the window."""
            at = max((j for j in range(start, k) if word[j] == trigger), default=None)
            return k - at if at is not None and k - at <= window else None

        def weight(d, window, nearest, farthest):
            return farthest + (nearest - farthest) * (window - d) / (window - 1)

        hit, total = ("I", 1.5 if k and word[k - 1] == "W" else 1.0) if symbol == "W" else ("T", 0.75)
        if symbol == "H" and (d := back("F", 3)):
            total = weight(d, 3, 2.0, 1.5)
        if d := back("Y", 4):
            hit, total = {"I": "J", "T": "U"}[hit], total * weight(d, 4, 1.6, 1.1)
        if d := back("N", 3):
            hit, total = hit + "-", total * weight(d, 3, 0.2, 0.5)
        if d := back("R", 8):
            hit, total = hit[0] + "=", total * weight(d, 8, 0.3, 0.6)
        paragraph = max((j for j in range(k) if word[j] == "P"), default=-1)
        if "=" not in hit and sum(s == "Q" for s in word[paragraph + 1: k]) % 2:
            hit, total = hit[0] + "=", total * 0.4
        out.append((hit, round(total, 9)))
    return out


def test_the_grammar_against_a_plain_reading():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        word = list(rng.choice(sorted(toxicity.INPUT), rng.integers(1, 25)))
        state, got = toxicity.GRAMMAR.start, []
        for symbol in word:
            state, written, weight = toxicity.GRAMMAR.step(state, symbol)
            if symbol in "WH":
                got.append((written, round(weight, 9)))
        assert got == by_hand(word), word


def test_nearer_targets_and_intents_weigh_more():
    def score(text):
        return toxicity.features(text, LEXICON)

    assert score("you idiot")[KIND["aimed"]] > score("you are such an idiot")[KIND["aimed"]]
    assert score("i will kill you")[KIND["threat"]] > score("to kill time")[KIND["threat"]]
    assert score("foul idiot")[KIND["heaviest"]] > score("foul and idiot")[KIND["heaviest"]]


def test_one_row_of_a_repeated_id_is_learned_from(spark):
    rows = [(7, f"idiot number {k}") for k in range(500)] + [(k, f"wort{k} idiot scum" if k % 2 else f"kind{k} day") for k in range(50, 250)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labelled(spark, [7, *range(50, 250)]))
    once = toxicity.learn(spark.createDataFrame(
        [r for r in rows if r[0] != 7] + [min((r for r in rows if r[0] == 7), key=lambda r: r[1])], "doc_id long, text string"
    ), labelled(spark, [7, *range(50, 250)]))
    assert set(model.lexicon.terms) == set(once.lexicon.terms)


def roc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    sf = cases.SF.replace("0.001", "0.1")
    found = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(found.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in found.doc_id])
    held = found[found.held_out]
    assert roc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.93
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.02 * (held.toxic == 0).sum()
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() >= 0.8 * held.toxic.sum()


def labelled(spark, ids):
    return spark.createDataFrame([(k, 1, k % 2) for k in ids], "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    texts = [(k, f"wort{k} idiot scum nice{k}" if k % 2 else f"wort{k} kind{k} day nice{k}") for k in range(50, 250)]
    df = cases.odd(spark, texts)
    labels = labelled(spark, range(50, 250)).unionByName(spark.createDataFrame(
        [(None, 1, 1), (60, None, None), (61, 1, 1), (61, 1, 1)], "doc_id long, quality int, toxic int"
    )).withColumn("score", F.lit("x"))
    found = toxicity.score(df, labels).collect()
    assert len(found) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by = {r.doc_id: r for r in found}
    assert not by[None].held_out and by[0].score == by[1].score == by[2].score < 0.5
    assert sum(by[k].predicted == k % 2 for k in range(50, 250)) >= 190
    assert toxicity.score(cases.empty(spark), labels).count() == 0
    none = toxicity.score(df, labels.limit(0)).collect()
    assert all(r.score < 0.5 for r in none)
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id is null").count() == 1
    assert kept.count() == sum(not r.predicted for r in found)


def test_labels_of_held_out_rows_are_not_read(spark):
    sf = cases.SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.score(docs, x).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
