"""Page furniture by its names, markup and links, and the blocks that stay."""

import random
import re

import pytest

from slotwise.llm.main_text import FEATURES, Tree, blocks, labelled_rows, main_text, tree

TEXT = "The council met on Tuesday to talk about the new bridge over the river and the money it will take to build it."
BODY = f"<h1>A bridge</h1><p>{TEXT}</p><p>{TEXT}</p>"
WANT = f"A bridge\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("page", [
    f"<div class='site has-sidebar'><article>{BODY}</article></div>", f"<article class='post comments-open'>{BODY}</article>",
    f"<div id='page' class='nav-open'><main>{BODY}</main></div>", f"<main id='search' class='modal'>{BODY}</main>",
    f"<div class='widget'><div class='sidebar'><div class='promo'><article class='share'>{BODY}</article></div></div></div>",
    f"<main><div class='overlay'><article>{BODY}</article></div></main>",
    f"<div class='modal'><article>{BODY}<div class='comments'><p>I like this very much</p></div></article></div>",
    f"<article>{BODY}<div class='comments'><article class='comment'><p>I like this very much</p></article></div></article>",
])
def test_names_do_not_drop_the_article(page):
    assert main_text(f"<html><body>{page}</body></html>") == WANT


LONG = " ".join([TEXT] * 12)
FURNITURE = """sidebar-right left-sidebar primary-sidebar post-comments commentlist user-comments entry-comments reader-comments
 ad-slot adbox ad_unit advert-300x250 global-nav social-icons disqus_thread sidebar main-nav site-footer cookie-notice ad ad2 comment-list
 share-buttons footer-links cookie-consent-banner newsletter-signup breadcrumbs related-posts topNav sideBar widget_search tag-cloud__tags
 tagcloud menu-main navbar comments comment-12 respond copyright masthead site-header alert alert-box modal promo-box""".split()


def test_an_articles_own_header_holds_its_title():
    for start, end in (("<header>", "</header>"), ("<div class=header>", "</div>"), ("<div class='entry-header'>", "</div>")):
        assert main_text(f"<article>{start}<h1>A bridge</h1>{end}<p>{TEXT}</p><p>{TEXT}</p></article>") == WANT


def test_states_do_not_count():
    assert not any(b.furniture for b in blocks(f"<div class='layout has-sidebar no-ads nav-open comments-closed'>{BODY}</div>"))
    for name in ("address", "commentary", "adventure", "navy", "entry-header", "content", "headline", "notice-period-law", "searching-for-gold"):
        assert not any(b.furniture for b in blocks(f"<div class='{name}'>{BODY}</div>")), name


@pytest.mark.parametrize("name", FURNITURE)
@pytest.mark.parametrize("kind", ["class", "id"])
def test_named_furniture_goes_whatever_its_length(name, kind):
    for text in (TEXT, LONG, "short"):
        part = f"<div {kind}='{name}'><p>{text}</p><p>{text}</p></div>"
        assert main_text(f"<body>{part}<article>{BODY}</article>{part}</body>") == WANT
        assert main_text(f"<body>{part}<div>{BODY}</div>{part}</body>") == WANT
        if "header" not in name:
            assert main_text(f"<article>{BODY}{part}</article>") == WANT
        assert main_text(part) == ""


@pytest.mark.parametrize("part", [
    f"<footer><p>{LONG}</p></footer>", "<nav>" + "<a href=x>A link</a> " * 200 + "</nav>", f"<aside>{LONG}<p>{TEXT}</p></aside>",
    "<nav>" + "<li><a href=x>Entry</a></li>" * 40 + "</nav>", f"<header>{LONG}</header>", f"<section role='contentinfo'>{LONG}</section>",
    f"<div hidden>{LONG}</div>", "<div>" + "<a href=x>tag</a> " * 25 + "</div>", "<ul>" + "<li><a href=x>tag word</a></li>" * 25 + "</ul>",
    f"<form><p>{LONG}</p></form>", f"<div class=comments><article class=comment id=comment-1><p>{LONG}</p></article></div>",
])
@pytest.mark.parametrize("page", ["<body>{part}<article>{body}</article>{part}</body>", "<body>{part}<div class=page>{body}</div>{part}</body>"])
def test_furniture_by_markup_and_by_links(part, page):
    assert main_text(page.format(part=part, body=BODY)) == WANT


def test_tag_clouds_and_comments_in_the_article():
    for cloud in ("<p>" + "<a href=x>tag</a> " * 25 + "</p>", "<ul>" + "<li><a href=x>tag</a></li>" * 25 + "</ul>"):
        assert main_text(f"<article>{BODY}{cloud}</article>") == WANT
        assert main_text(f"<article>{BODY}{cloud}<p>{TEXT}</p></article>") == f"{WANT}\n{TEXT}"
    comment = f"<section id=comments><article class='comment even'><p>{LONG}</p></article></section>"
    assert main_text(f"<article>{BODY}{comment}</article>") == main_text(f"<article>{BODY}</article>{comment}") == WANT


MENU = "<div><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul></div>"
PIECES = [
    "<h1>A bridge for the city</h1>", "<p>By Jane Doe</p>", "<p>It is done.</p>", f"<p>{TEXT}</p>", "<h2>Money</h2>",
    "<ul><li>one arch</li><li>two lanes for bicycles</li><li>trees</li></ul>", f"<p>{TEXT} <a href=x>Read the plan</a>.</p>", "<p>End</p>",
]


@pytest.mark.parametrize("wrapper", ["<div>{}</div>", "<div class=site><div class='content has-sidebar'>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "{}"])
def test_short_blocks_of_pages_without_an_article_stay(wrapper):
    """Titles, bylines, short first paragraphs, subheadings and list items, between plain menus."""
    draw = random.Random(7)
    for _ in range(300):
        chosen = [PIECES[0], *draw.choices(PIECES[1:], k=draw.randint(2, 9))]
        if not any(TEXT in piece for piece in chosen):
            chosen.append(PIECES[3])
        want = re.sub(r"<[^>]*>", "", re.sub(r"</(?:p|li|h1|h2)>(?!</ul>$)", "\n", "".join(chosen)))
        page = f"<html><body>{MENU}{wrapper.format(''.join(chosen))}{MENU}<div>&copy; City news</div></body></html>"
        assert main_text(page).split("\n") == [line for line in want.split("\n") if line], page
        assert main_text(f"<html><body>{MENU}<article>{''.join(chosen)}</article>{MENU}<div>&copy; City news</div></body></html>") == main_text(page)


def test_the_tree_reads_the_block_and_both_neighbours():
    used, todo = set(), [tree()]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            used.add(FEATURES[node.feature])
            todo += [node.left, node.right]
    assert used == set(FEATURES)
    rows, labels = labelled_rows()
    for k, name in enumerate(FEATURES):  # no feature tells the classes apart by itself
        stump = Tree(rows[:, [k]], labels, depth=1)
        wrong = sum((stump(tuple(r)) >= 0.5) != bool(label) for r, label in zip(rows[:, [k]], labels, strict=True))
        assert wrong > 0.1 * len(labels) or name == "links" and wrong > 0.05 * len(labels), name


def test_neighbours_decide():
    lone = f"<p>{TEXT}</p><p><a href=x>The plan of the bridge</a></p><p>{TEXT}</p>"
    many = f"<p>{TEXT}</p>" + "<p><a href=x>The plan of the bridge</a></p>" * 4 + f"<p>{TEXT}</p>"
    assert "The plan" in main_text(f"<div>{lone}</div>") and "The plan" not in main_text(f"<div>{many}</div>")
    assert main_text(f"<div><p><a href=x>Old</a></p><p>Links</p><p><a href=x>New</a></p></div><div>{BODY}</div>") == WANT
