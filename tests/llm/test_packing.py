"""Packing against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from slotwise.llm import packing, queries
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))


def ids(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(pieces, texts, window=2048):
    """Each row's ids in consecutive pieces; sequences gapless and full."""
    want, seen = defaultdict(list), defaultdict(int)
    for k, text in texts:
        want[k].append(ids(text))
    ordered, place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), 0
    while ordered:
        whole, at = ordered[0], 0
        matching = [w for w in want[whole.doc_id] if len(w) == whole.doc_tokens]
        while at < whole.doc_tokens:
            p = ordered.pop(0)
            assert (p.doc_id, p.start, p.doc_tokens) == (whole.doc_id, at, whole.doc_tokens)
            assert (p.sequence_id, p.offset) == divmod(place, window) and p.length <= window - p.offset
            matching = [w for w in matching if zlib.crc32(w[at: at + p.length].tobytes()) == p.ids_crc32]
            at, place = at + p.length, place + p.length
        assert matching and at == whole.doc_tokens
        seen[whole.doc_id] += 1
    assert seen == {k: len(v) for k, v in want.items()}


def test_query(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op5_packing(spark, cases.SF).collect(), [tuple(r) for r in docs])


def test_awkward_rows(spark):
    more = ["It's a <|endoftext|> mark", "Ünïcode ΣΑΣ. «x» don't we'll", "a\x1cb\x85c​d 　 e", "12,345.67!? (x) --- '", "日本語 text", "İstanbul ΣΊΣΥΦΟΣ ǅ ﬁn ＡＢ ª º ß ŉ ı K", "e\u0301a \u0301x A\u030a. ÇÃO! naïve's"]
    df = cases.odd(spark, more).repartition(3)
    texts = [(r.doc_id, r.text) for r in df.collect()]
    pieces = packing.pack(df).collect()
    check(pieces, texts)
    assert sum(p.length for p in pieces) == sum(len(ids(t)) for _, t in texts)
    assert packing.pack(cases.empty(spark)).count() == 0


def test_small_window(spark):
    texts = ["one two three", None, "four", " ".join(["five"] * 40)]
    check(packing.pack(cases.documents(spark, texts), window=7).collect(), list(enumerate(texts)), 7)


def test_words_are_forgotten_at_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    for text in ("a b c d", "e f g a", "one two three four five six seven", "a"):
        assert encoder.encode(text) + ids("")[-1:].tobytes() == ids(text).tobytes()


def test_random_strings_have_the_ids_of_the_tokenizer():
    """Letters, marks, punctuation, digits and special signs, all words of 100,000 texts."""
    draw = random.Random(20)
    signs = [
        *"abcxyzABCXYZ", *"İIıiŞÇÖÜßǅﬁŉKΣςσÅéñ", *"\u0301\u0307\u030a\u0338\u20e3", *".,;:!?'\"-_()[]<>=%$#&*+/|~^`@\\{}", *"0179²½Ⅷ٣",
        *"漢字かなกี한", *"😀♥€«»—…", " ", " ", " ", "\t", "\u00a0", "\x85", "'s", "'ll",
    ]
    encoder = packing.encoder(packing.VOCABULARY)
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 12))) for _ in range(100_000)]
    texts += ["GAZİ.", "SAHİBİ, BELEDİYESİ!", "(İ)", "İ\u0307.", "'İ'", "İ's"]
    for text, whole in zip(texts, TOKENIZER.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == whole.ids, text
