"""A repeated id visits a group if any of its texts can link there."""

from slotwise.llm import ngram_join
from tests.llm import cases

CLOUD = " ".join(f"w{k}" for k in range(60))


def other(k):
    return " ".join(f"o{k}x{j}" for j in range(60))


def test_visits_of_repeated_ids(spark):
    """Ids 100 to 109 hold a text near the group of 0 and 1, before or after one that is far from it."""
    texts = [(0, CLOUD), (1, CLOUD + " end")]
    for k in range(100, 110):
        texts += [(k, t) for t in ([CLOUD + f" e{k}", other(k)] if k % 2 else [other(k), CLOUD + f" e{k}"])]
    texts += [(110, other(110))]
    rows = [(rep, 0 if rep < 2 else rep, 56, 56, 57, 1, text) for rep, text in texts]
    frame = spark.createDataFrame(rows, "rep long, grp long, n long, low long, high long, blocks int, text string").coalesce(1)
    visits = spark.createDataFrame([(k, 0) for k in range(100, 111)], "a long, grp long")
    opened = ngram_join._opened(visits, frame, ngram_join.WORDS, ngram_join.PERCENT)
    assert sorted(r.a for r in opened.collect()) == list(range(100, 110))


def test_repeated_ids_link_by_any_text(spark):
    texts = [(k, CLOUD + f" e{k}") for k in range(20)]
    for k in range(100, 106):
        texts += [(k, other(k)), (k, CLOUD.replace("w30 w31", f"n{k}"))]
    found = ngram_join.linked(cases.documents(spark, texts)).collect()
    assert {r.component_id for r in found} == {0} and len(found) == len(texts)
