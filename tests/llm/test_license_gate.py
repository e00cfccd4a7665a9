"""No license rule is kept from a text that it matches, however the text is wrapped."""

import random
import re
from re import _parser

import pytest

from slotwise.llm import licenses

GNU = "GNU General\nPublic License, version 3"


def forms(parsed):
    """Texts that a parsed pattern may match: each branch, without and with what is optional."""
    found = [""]
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(value)]
        elif name == "IN":
            kind, of = value[0]
            more = [" "] if "CATEGORY" in str(kind) or str(kind) == "NEGATE" else [chr(of if str(kind) == "LITERAL" else of[0])]
        elif name == "SUBPATTERN":
            more = forms(value[-1])
        elif name == "BRANCH":
            more = [text for branch in value[1] for text in forms(branch)]
        elif "REPEAT" in name:
            low, high, inner = value
            more = [text * n for text in forms(inner) for n in {low, max(low, min(high, 1))}]
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            more = [""]
        else:
            raise AssertionError(name)
        if len(found) * len(more) <= 48:
            found = [text + part for text in found for part in more]
        else:  # each choice at least once
            n = max(len(found), len(more))
            found = [found[k % len(found)] + more[k % len(more)] for k in range(n)]
    return found


def examples(rule):
    """Of each rule, its forms of one blank for each run of white space, as far as it matches them."""
    parsed = _parser.parse(rule.pattern.pattern.replace(r"(?:\S|\s++)", "(?:-| )"))
    return [text for text in forms(parsed) if rule.pattern.fullmatch(text)]


@pytest.mark.parametrize("blank", [" ", "\n", "  ", " \r\n\t "])
def test_gate_holds_no_rule_back(blank):
    for rule in licenses.rules():
        texts = examples(rule)
        assert texts, rule
        for text in texts:
            wrapped = text.replace(" ", blank)
            assert rule.pattern.search(wrapped), (rule.label, wrapped)
            assert rule in licenses.candidates(wrapped), (rule.label, rule.keyword, wrapped)


@pytest.mark.parametrize("text, labels", [
    (GNU, "gpl,gpl-3.0"), ("all\nrights  reserved", "proprietary"), ("Beer-Ware License", "beerware"),
    ("Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted", "bsd"),
    ("You may not use this file except\n   in compliance with the License", "apache-2.0"),
    ("Permission is hereby granted,\nfree of charge, to any person obtaining a copy", "mit"),
    ("Neither the name of the\ncopyright holder nor the names of its contributors\n  may be used to endorse or promote\nproducts", "bsd-3-clause"),
    ("Unauthorized copying of this file,\nvia any medium is\nstrictly prohibited", "proprietary"),
    ("Mozilla\nPublic License 2.0", "mpl-2.0"), ("Open RAIL license", "openrail"), ("CC\nBY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("This software is provided 'as-is', without any express\n or implied warranty", "zlib"),
    ("built with\tLlama", "llama"), ("with no Invariant Sections, no Front-Cover Texts,\nand no Back-Cover Texts", "gfdl"),
    ("As a special exception, the copyright holders\nof this library give you permission to link", "classpath-exception"),
    ("NASA Open Source\nAgreement v1.3", "nasa-1.3"), ("Sous licence\nCreative Commons", "creative-commons"),
    ("No part of this book\nmay be reproduced", "proprietary"), ("He accepts, by and by, that no part of it is his", ""),
    ("NCSA Open Source License", "ncsa"), ("Attribution-No Derivatives 4.0", "cc-by-nd-4.0"),
])
def test_wrapped_licenses(text, labels):
    assert licenses.scan_text(text)[5] == labels


def test_offsets_are_those_of_the_text_as_it_stands():
    text = "x " + GNU + " y"
    (start, end, rule), = licenses.detections(text.lower())
    assert text[start:end] == GNU and rule.label == "gpl-3.0"


def test_gaps_take_long_white_space_in_linear_time():
    text = "neither the name of " + "a b " * 30 + " " * 100_000 + "may be used to endorse or promote"
    assert licenses.detections(re.sub("$", " x", text)) == []


def plain(text):
    """Detections read plainly: every rule without a gate, each interval against all kept ones."""
    found = [(m.start(), m.end(), rule) for rule in licenses.rules() for m in rule.pattern.finditer(text)]
    kept = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, rule))
    return sorted((start, end, rule.label) for start, end, rule in kept)


def test_detections_match_a_plain_reading():
    rng = random.Random(11)
    texts = [text for rule in licenses.rules() for text in examples(rule)[:3]]
    filler = ["and", "the", "version", "2.0", "accept by", "public", "or later", "licensed under", ",", "(c)", "share", "é"]
    for _ in range(120):
        parts = [rng.choice(texts) if rng.random() < 0.4 else rng.choice(filler) for _ in range(rng.randint(1, 14))]
        text = rng.choice([" ", "\n", ", ", " \t "]).join(parts).lower()
        assert sorted((start, end, rule.label) for start, end, rule in licenses.detections(text)) == plain(text)
