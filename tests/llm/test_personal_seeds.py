"""E-mail addresses in texts without a digit are seeds like any other."""

from slotwise.llm import personal
from tests.llm import cases

NAMES = [f"{a}{b}@example.org" for a in "abcdefgh" for b in "vwxyz"]
TEXTS = [f"please reach {name} about this" for name in NAMES] + ["please reach agent-7731x about this", "no agent-8842y here"]


def test_seeds_without_digits_make_a_context_trusted(spark):
    docs = cases.documents(spark, TEXTS)
    found = {r.doc_id: r for r in personal.find(docs).collect()}
    assert all(found[k].n_email == 1 for k in range(len(NAMES)))
    assert found[len(NAMES)].spans == "context:13:24" and found[len(NAMES) + 1].n_context == 0
    redacted = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert redacted[len(NAMES)] == "please reach <CONTEXT> about this" and redacted[0] == "please reach <EMAIL> about this"
