"""The pipeline against its stages done by hand on a small table."""

import math
from hashlib import md5

import corpus_pipeline
from slotwise.llm import mixing, toxicity
from slotwise.llm.common import table
from tests.llm import cases
from tests.llm.test_join import brute
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_personal import base

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_named_in_order():
    assert list(STAGES) == ["toxicity", "ngram_join", "personal", "mixing", "packing"]


def test_every_stage(spark):
    docs = table(spark, cases.SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    clean = STAGES["toxicity"](spark, docs, cases.SF)
    scores = {r.doc_id: r.predicted for r in toxicity.score(docs, table(spark, cases.SF, "labels")).collect()}
    kept = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and kept == {k: r for k, r in rows.items() if not scores[k]}

    one = STAGES["ngram_join"](spark, clean, cases.SF)
    parts, _ = brute([(k, r.text) for k, r in kept.items()])
    kept = {k: r for k, r in kept.items() if parts[k] == k}
    assert one.columns == docs.columns and {r.doc_id: r for r in one.collect()} == kept

    free = STAGES["personal"](spark, one, cases.SF)
    assert free.schema == docs.schema or free.columns == docs.columns
    redacted = {r.doc_id: r for r in free.collect()}
    assert set(redacted) == set(kept)
    for k, r in redacted.items():
        assert base(r.text) == "" and r.n_chars == len(r.text) and (r.lang, r.source) == (kept[k].lang, kept[k].source)
        if not any(c.isdigit() for c in kept[k].text):
            assert r.text == kept[k].text

    mixed = STAGES["mixing"](spark, free, cases.SF)
    assert mixed.columns == docs.columns
    mass = {}
    for r in redacted.values():
        mass[r.source] = mass.get(r.source, 0) + len(r.text) + 1
    weight = sum(map(math.sqrt, mass.values()))
    want = {}
    for k, r in redacted.items():
        rate = math.sqrt(mass[r.source]) * sum(mass.values()) / (weight * mass[r.source])
        u, p, n = int(md5(f"{mixing.SEED}:1:{k}".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), 0
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        if n:
            want[k] = n
    copies = {}
    for r in mixed.collect():
        assert r == redacted[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == want

    pieces = corpus_pipeline.run(spark, cases.SF).collect()
    check_pieces(pieces, [(k, redacted[k].text) for k, n in want.items() for _ in range(n)])
