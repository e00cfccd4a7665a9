"""Pages that leave out end tags, and names that wrap the article."""

import pytest

from slotwise.llm.main_text import main_text

TEXT = "The council met on Tuesday to talk about the new bridge over the river and the money it will take to build it."
ARTICLE = f"<article><h1>A bridge</h1><p>{TEXT}</p></article>"
WANT = f"A bridge\n{TEXT}"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title><body>{ARTICLE}", f"<html><head><title>t</title><meta charset=x><div>{ARTICLE}</div></html>",
    f"<head><title>t<body>{ARTICLE}</body>", f"<head><script>if (a < b) x('<body>')</script><link href=x>{ARTICLE}",
    f"<head><noscript><img src=x></noscript><title>a</title></head><body>{ARTICLE}",
    f"<body><div><form action=/s><input>Search</div>{ARTICLE}</body>", f"<body><form><input><div>{ARTICLE}</div></body>",
    f"<body><div><select><option>One<option>Two</div>{ARTICLE}", f"<body><map name=m><area>{ARTICLE}",
    f"<body><object data=x>{ARTICLE}", f"<body><video src=x>{ARTICLE}</body></html>", f"<div><button>Menu</div>{ARTICLE}",
    f"<body><form><input>{ARTICLE}<form>mail <button>Send</button></form></body>",
    f"<table><tr><form><td>{TEXT}</td></tr></form></table>{ARTICLE}", f"<form><div>{TEXT}</form>{ARTICLE}",
    f"<select><option>One<option>Two</select>{ARTICLE}",
])
def test_missing_end_tags_lose_nothing(page):
    assert main_text(page) == WANT


def test_text_in_an_unclosed_head():
    assert main_text(f"<head><title>t</title>{TEXT}") == TEXT


def test_deep_and_many_unclosed_elements():
    assert main_text("<form><option>" * 20_000 + "</div>" * 20_000 + ARTICLE) == WANT
