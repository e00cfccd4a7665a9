"""Fill-in-the-middle against its SQL, a plain reading and exact round trips."""

import hashlib
import re

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slotwise.llm import middle
from tests.llm import cases
from tools.check import compare

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k: 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{cases.SF}/documents.parquet'")
    same, text, _ = compare(spark, con, "op11_middle", cases.SF, entry.queries(), entry.oracle_sql())
    assert same, text


def test_awkward_rows(spark):
    texts = [
        "a <S> b", "<P>", "<", "<P", "x <P y> z", "trailing white  \n", " \t leading", "\x1c 　 no blanks  ",
        "é ü 漢字 😀 " * 50, *[f"w{k} " * (k % 9) for k in range(60)],
    ]
    rows = list(enumerate(texts, start=100))
    df = cases.odd(spark, rows)
    given_rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    out = middle.restore(middle.transform(df.repartition(3))).collect()
    want = sorted((str(d), *map(str, plainly(d, t)), t or "") for d, t in given_rows)
    assert sorted((str(r.doc_id), *map(str, r[1:])) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert middle.digests(cases.empty(spark)).count() == 0


def test_forms_of_other_rows(spark):
    df = spark.createDataFrame(
        [("psm", "<P>a<S>c<M>b", "x"), ("spm", "<S>c<P>a<M>b", "x"), ("plain", "<P>a<S>c<M>b", "x"), ("psm", None, "x"), (None, "t", "x"),
         ("spm", "no sentinel", "x")],
        "form string, output string, restored string",
    )
    found = [r.restored for r in middle.restore(df).collect()]
    assert found == ["abc", "abc", "<P>a<S>c<M>b", None, "t", "no sentinel"]


@pytest.mark.parametrize("step", [1, 2, 7, 1 << 20])
def test_steps_change_nothing(monkeypatch, step):
    monkeypatch.setattr(middle, "STEP", step)

    @given(st.text(alphabet=" \t\nab<PSM>é漢", max_size=60), st.integers(0, 10**9), st.integers(0, 10**9))
    def holds(text, first, second):
        data, tokens = text.encode(), TOKEN.findall(text)
        n = len(tokens)
        assert middle.token_count(data) == n
        a, b = sorted((first % (n + 1), second % (n + 1)))
        cuts = middle.offsets(data, a, b)
        assert cuts == (len("".join(tokens[:a]).encode()), len("".join(tokens[:b]).encode()))
        if not any(s in text for s in ("<P>", "<S>", "<M>")):
            p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
            for form, want in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}"), ("plain", text)):
                output = middle.arranged(data, *cuts, form)
                assert output.decode() == want
                assert middle.rebuilt(bytes(output), form) == data

    holds()


def test_rotation():
    for size in range(12):
        for start in range(size + 1):
            for end in range(start, size + 1):
                for cut in range(start, end + 1):
                    buffer = bytearray(range(size))
                    middle.rotate(buffer, start, cut, end)
                    plain = bytes(range(size))
                    assert bytes(buffer) == plain[:start] + plain[cut:end] + plain[start:cut] + plain[end:]


def test_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    forms = {r.form: r["count"] for r in middle.transform(df).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 150 and abs(forms["spm"] - 1600) < 150
    forms = {r.form for r in middle.transform(df, cut_share=100, suffix_first_share=0).select("form").distinct().collect()}
    assert forms == {"psm"}
