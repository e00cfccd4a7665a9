"""Awkward rows through the five stages: nulls, empty and long texts, repeats, clashing names, no rows."""

import corpus_pipeline
from slotwise.llm.common import stored
from tests.llm import cases
from tests.llm.test_packing import check as check_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(60_000))
ROWS = [
    (1, None, None, None, None), (2, "", "en", "web", 0), (3, " \n\t", "en", "web", 3), (4, "four words stand here", None, "web", 21),
    (5, "the same text stands in two rows of this table", "en", "books", 46), (5, "the same text stands in two rows of this table", "en", "books", 46),
    (6, "one id has several texts and this is the first of them", "en", "web", 54), (6, "quite another text under the id that was given before", "en", "web", 53),
    (7, "the same text stands in two rows of this table", "de", "web", 46), (None, "a text without any id at all", "en", None, 28),
    (8, LONG, "en", "books", len(LONG)), (9, "write to someone@example.org or call +49 30 1234567 today", "en", "web", None),
]
EXTRA = ", score double, rep long, grp long, cell string, copies int, bits string, source_ string"


def through(spark, docs):
    """What each stage keeps, and the pieces of the last."""
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stored(stage(spark, docs, cases.SF), f"awkward-{name}")
        assert docs.columns == columns
        seen.append(docs.collect())
    return seen, corpus_pipeline.STAGES[-1][1](spark, docs, cases.SF).collect()


def test_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    (clean, one, free, mixed), pieces = through(spark, docs)
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(clean) == order(ROWS)
    # One row of an id, the smallest; 7 has the words of 5; rows without words or id stay.
    assert sorted((r.doc_id or 0) for r in one) == [0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert next(r.text for r in one if r.doc_id == 6) == min(r[1] for r in ROWS if r[0] == 6)
    by_id = {r.doc_id: r for r in free}
    assert by_id[1].text is None and by_id[1].n_chars is None and by_id[2].text == "" and by_id[8].text == LONG
    assert "@" not in by_id[9].text and "1234567" not in by_id[9].text and by_id[9].n_chars == len(by_id[9].text)
    assert all(r == by_id[r.doc_id] for r in mixed)
    check_pieces(pieces, [(r.doc_id, r.text) for r in mixed])


def test_clashing_columns(spark):
    wide = [(*r, 0.5, 7, 8, "c", 2, "b", "s") for r in ROWS]
    (_, one, _, mixed), pieces = through(spark, spark.createDataFrame(wide, SCHEMA + EXTRA))
    assert len(one) == 9 and all(tuple(r)[5:] == (0.5, 7, 8, "c", 2, "b", "s") for r in mixed)
    check_pieces(pieces, [(r.doc_id, r.text) for r in mixed])


def test_no_rows(spark):
    seen, pieces = through(spark, spark.createDataFrame([], SCHEMA))
    assert seen == [[], [], [], []] and pieces == []
