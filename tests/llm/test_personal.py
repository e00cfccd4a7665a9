"""Personal data against a plain reading of the contract."""

import hashlib
import re

from pyspark.sql import functions as F

from slotwise.llm import personal, queries
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text):
    found = [("email", m) for m in EMAIL.finditer(text)] if "@" in text else []
    found += [("ip", m) for m in IP.finditer(text) if all(float(x) <= 255 for x in m.group().split("."))]
    found += [("card", m) for m in CARD.finditer(text) if luhn(re.sub("[^0-9]", "", m.group()))]
    found += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in found)


TEXTS = [
    "a@b.c_d@e.f x@y a.b@c..d é+%@-.-.x", "1.2.3.4.5.6.7.8 999.1.1.1 0001.00000255.3.4 1.2.3", "+1 (743) 555-3824 +49301234567 +1- 2",
    "4111 1111 1111 1111", "4111-1111-1111-1111, 4111111111111111 é 4111  1111 1111 1111", "\x01 x@y.zz \x02 \x01 10.0.0.1",
    "$1 $0 \\ 10.0.0.1 \\1", "1 " * 5000, "a@" + "b." * 6000 + "c", "9" * 30_000, "x" * 60_000, "10.0.0.1 " * 1500, "😀 a@b.cd 😀 1.1.1.1",
]


def check(found, texts):
    by = {r.doc_id: r for r in found}
    for k, text in texts:
        want = base(text or "")
        assert by[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (k, (text or "")[:60])
        assert f"{by[k].spans},".startswith(f"{want}," if want else "")
        assert [by[k][f"n_{kind}"] for kind in personal.KINDS] == [want.count(kind) for kind in personal.KINDS]


def test_query_matches_brute_force(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op6_personal(spark, cases.SF).collect(), texts)


def test_awkward_rows(spark):
    df = cases.odd(spark, TEXTS)
    found = personal.find(df).collect()
    assert len(found) == df.count()
    check(found, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert personal.find(cases.empty(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = personal.find(cases.documents(spark, TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


CONTEXT = [f"name{k} member number 10.0.{k}.7 please" for k in range(40)] + ["other member number QX-88-1234 please", "order code QX-99-5678 now"]


def test_trusted_patterns_find_unseen_identifiers(spark):
    found = {r.doc_id: r for r in personal.find(cases.documents(spark, CONTEXT)).collect()}
    assert found[40].n_context == 1 and found[40].spans == "context:20:30"
    assert found[41].n_context == 0


def contexts(left, second, right, values):
    seeds = [f"{second}{k} {second} {left} 10.0.{k}.7 {right}" for k in range(40)]
    return seeds + [f"other {second} {left} {v} {right}" for v in values]


def test_identifiers_and_words_of_any_length(spark):
    long_id, late_digit = "QX" + "Ab-_c" * 14 + "9", "q" * 200 + "-1"
    texts = contexts("m" * 100, "s" * 120, "é" * 90, [long_id, late_digit, "x" * 70 + "no-digit"])
    # Words that only end alike are other contexts.
    texts += [f"other {'s' * 120} x{'m' * 100} QX-11-2222 {'é' * 90}x", "x" * 60_000 + " " * 60_000 + "QX-1234 " + "y" * 60_000]
    found = {r.doc_id: r for r in personal.find(cases.documents(spark, texts)).collect()}
    for k, value in ((40, long_id), (41, late_digit)):
        start = texts[k].index(value)
        assert found[k].spans == f"context:{start}:{start + len(value)}"
    assert found[42].spans == found[43].spans == found[44].spans == ""


def plain_words(text, start, end):
    before, after = text[:start].split(), text[end:].split()
    return (before[-1:] or [""])[0].lower(), (before[-2:-1] or [""])[0].lower(), (after[:1] or [""])[0].lower()


def test_context_words_match_a_plain_reading(spark):
    """The words between an identifier and the one before and after it."""
    texts = [
        "one Two 12345 three", "12345", " 12345 \n", "a\tb\n c  12345\u3000d AB-12 e", "x" * 300 + " y 99999 " + "z" * 300, "a@b.cd 12345 é ÀB1 x",
    ]
    df = personal.extracted(cases.documents(spark, texts), id_col="doc_id", text_col="text")
    for r in df.collect():
        text, at = texts[r["__id"]], 0
        spans = sorted((m.start, m.end) for m in r["__identifiers"])
        for m in sorted(r["__identifiers"], key=lambda m: m.start):
            k = spans.index((m.start, m.end))
            end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            left, second, right = plain_words(text[at:end], m.start - at, m.end - at)
            if "\u3000" not in text:
                assert (m.left, m.second, m.right) == (left, second, right)
            at = m.end


def test_redaction(spark):
    df = cases.odd(spark, ["mail a@b.cd now +1 (743) 555-3824", "10.0.0.1\x01", "nothing"] + CONTEXT[:41])
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    redacted = personal.redact(df)
    assert redacted.columns == df.columns and redacted.count() == df.count()
    found = {r.doc_id: r.text for r in redacted.select("doc_id", "text").collect()}
    assert found[8] == "mail <EMAIL> now <PHONE>" and found[9] == "<IP>\x01" and found[10] == "nothing"
    assert found[51] == "other member number <CONTEXT> please"
    assert found[0] is None and found[4] == texts[4]
    assert personal.redact(cases.empty(spark)).count() == 0
    assert redacted.select(F.max("score")).first()[0] == "x"
