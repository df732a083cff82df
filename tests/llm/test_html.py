"""Main text of varied pages, written by hand with the text that a reader would keep."""

import itertools
import random
import time
import tracemalloc

import pytest

from hexcast.llm.htmltext import main_text, min_cut, name_score

A = "The river rose for three days before the town council met, and by then the lower road was already under water up to the fences."
B = "Nobody had expected the old bridge to hold, yet it stood through the night while the fields on both sides turned into one lake."
C = "When the water fell, people found their tools, chairs and doors a mile away, and most of them carried everything home again."
TITLE = "The week of the flood"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ul></nav>'
FOOT = '<footer><p>Copyright 2024 The Valley Times. All rights reserved by the owners of this paper and its licensors.</p></footer>'
BODY = f"<h1>{TITLE}</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
WANT = "\n\n".join((TITLE, A, B, C))


def page(inner: str, head: str = "<head><title>T</title></head>", body: str = "<body>") -> str:
    return f"<!DOCTYPE html><html>{head}{body}{inner}</body></html>"


PAGES = {
    "plain article": (page(f"{NAV}<article>{BODY}</article>{FOOT}"), WANT),
    "no end of head": (page(f"{NAV}<article>{BODY}</article>{FOOT}", head="<head><meta charset=utf-8><title>T</title>"), WANT),
    "no head or body tags": (f"<title>T</title>{NAV}<article>{BODY}</article>{FOOT}", WANT),
    "custom elements": (page(f"<article><title-bar></title-bar><script-note></script-note>{BODY}</article>{FOOT}"), WANT),
    **{
        f"class {c}": (page(f'{NAV}<div class="{c}">{BODY}</div>{FOOT}'), WANT)
        for c in (
            "overflow-hidden", "has-sidebar", "post-content no-comments", "social-post", "with-nav", "modal-open", "notice-board", "share-enabled", "category-legal",
            "entry-content tag-cookies", "post type-post status-publish category-search", "articleBody", "story__body story__body--promo", "page-header-less", "js-menu-closed",
        )
    },
    "article about a topic": (page(f'<article class="legal">{BODY}</article>{FOOT}'), WANT),
    "body with modal class": (page(f"{NAV}<main>{BODY}</main>{FOOT}", body='<body class="modal-open sidebar">'), WANT),
    "main in table layout": (page(f'<table><tr><td class="sidebar"><a href=x>Archive</a><td><div class="content">{BODY}</div></table>{FOOT}'), WANT),
    "unclosed paragraphs": (page(f"{NAV}<article><h1>{TITLE}</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}"), WANT),
    "comments": (page(f'<article>{BODY}</article><section id="comments"><h2>3 comments</h2><article class="comment"><p>{A} I was there and saw it all, and it was worse.</p></article></section>'), WANT),
    "comments inside the article": (page(f'<article>{BODY}<div class="comment-list"><p>{B} Thanks for writing this down for all of us.</p></div></article>'), WANT),
    "advert between paragraphs": (page(f'<article><h1>{TITLE}</h1><p>{A}</p><div class="ad">Buy two, pay one.</div><p>{B}</p><div class="advert-slot"><p>Boots for every flood, now cheaper.</p></div><p>{C}</p></article>'), WANT),
    "cookie notice": (page(f'<div class="cookie-notice"><p>We use cookies to give you the best experience of our site, to measure its use and to show adverts that suit you.</p><button>Accept</button></div><article>{BODY}</article>'), WANT),
    "sidebar with prose": (page(f'<main>{BODY}</main><div id="sidebar"><p>About the author: a reporter for thirty years in this valley, who lives at the river with two dogs and a boat.</p></div>'), WANT),
    "hidden parts": (page(f'<article><div hidden><p>{C} Draft.</p></div><p style="display: none">{B} Old.</p>{BODY}</article>'), WANT),
    "newsletter form": (page(f'<article>{BODY}<form><p>Get our letter every week, with all the news of the valley and its towns.</p><input name=mail></form></article>'), WANT),
    "related stories": (page(f'<article>{BODY}</article><div class="related-posts"><h3>More to read</h3><ul><li><a href=1>The drought of last year</a></li><li><a href=2>Who pays for the bridge</a></li></ul></div>'), WANT),
    "article header and footer": (page(f'<header class="site-header"><h2>The Valley Times</h2></header><article><header class="entry-header"><h1>{TITLE}</h1></header><p>{A}</p><p>{B}</p><p>{C}</p><footer class="entry-footer">Filed under weather</footer></article>'), WANT),
    "scripts and styles": (page(f'<article><script>if (a < b) document.write("<p>no</p>")</script ><style>p > a {{}}</style>{BODY}<noscript><p>Please enable scripts to see this page as it was meant to be.</p></noscript></article>'), WANT),
    "svg without an end": (page(f"<article><svg><text>logo<p>{A}</p><p>{B}</p></article>"), "\n\n".join((A, B))),
    "references and white space": (page(f"<article><p>Fish &amp; chips&nbsp;&#8212; caf&eacute;,\n\t  “fresh” &lt;daily&gt;</p><p>{A}</p></article>"), f"Fish & chips — café, “fresh” <daily>\n\n{A}"),
    "inline tags and breaks": (page(f"<article><p>{A[:20]}<b>{A[20:40]}</b><i>{A[40:]}</i><p>one<br>two {B}</article>"), f"{A}\n\none two {B}"),
    "a quote that stays open": (page(f'<article><p title="it\'s>{A}</p><p class="x">{B}</p><p>{C}</p></article>'), f"{A}\n\n{B}\n\n{C}"),
    "list of prose": (page(f"<article><h1>{TITLE}</h1><ul><li>{A}<li>{B}</ul></article>"), f"{TITLE}\n\n{A}\n\n{B}"),
    "only menus": (page(NAV + FOOT), ""),
    "role names": (page(f'<div role="banner"><p>The Valley Times, since 1901, for the towns of the valley and for its hills.</p></div><div role="main">{BODY}</div><div role="contentinfo">{C}</div>'), WANT),
}


@pytest.mark.parametrize("name", PAGES)
def test_gold_pages(name):
    html, want = PAGES[name]
    assert main_text(html) == want


def test_smoothness_overrules_a_weak_cost():
    assert min_cut([2.0, -0.5, 2.0], [(0, 1, 0.6), (1, 2, 0.6)]) == [True] * 3
    assert min_cut([2.0, -5.0, 2.0], [(0, 1, 0.6), (1, 2, 0.6)]) == [True, False, True]


def test_cut_is_least_of_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.choice([-2.0, -0.75, 0.0, 0.5, 1.25]) + rng.random() / 8 for _ in range(n)]
        edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda yes: sum(abs(s) for s, y in zip(scores, yes, strict=True) if (s > 0) != y and s) + sum(c for a, b, c in edges if yes[a] != yes[b])  # noqa: B023, E731
        best = min(cost(yes) for yes in itertools.product([False, True], repeat=n))
        assert cost(min_cut(scores, edges)) == pytest.approx(best)


@pytest.mark.parametrize("page", ["<div>some words " * 8_000, "<div>" * 8_000 + "</p></td>" * 8_000, "<article>" + "<p>words of prose<div class=ad>buy</div>" * 4_000])
def test_deep_and_long_pages_are_linear(page):
    took = []
    for part in (page[: len(page) // 4], page):
        tracemalloc.start()
        began = time.process_time()
        main_text(part)
        took.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert took[1][1] < 8 * took[0][1] and took[1][1] < 700 * len(page)
    assert took[1][0] < 12 * took[0][0] + 1


def test_states_and_topics_say_nothing():
    assert name_score("has-sidebar") == name_score("category-legal") == name_score("modal-open") == 0
    assert name_score("site-footer") < 0 and name_score("commentList") < 0 and name_score("post-content") > 0


LONG = "word " * 80


def test_page_wide_forms_plain_bodies_and_readers():
    from hexcast.llm.htmltext import main_text

    whole = f"<h1>Title</h1>\n<p>{LONG}</p>"
    for wrapped in (f"<form id=aspnet><article>{whole}</article></form>", f"<form>{whole}</form>", f"<FORM>{whole}"):
        assert main_text(f"<html><body>{wrapped}</body></html>").startswith("Title\n\nword")
    asked = f"<article>{whole}</article><form><label>Name</label><p>Send us your message</p></form>"
    assert "message" not in main_text(f"<html><body>{asked}</body></html>")
    plain = "<html><body><h1>Short title</h1><p>A short paragraph.</p><ul><li>one</li><li>two</li></ul></body></html>"
    assert main_text(plain) == "Short title\n\nA short paragraph.\n\none\n\ntwo"
    readers = "".join(f"<div class='{c}'><p>I liked it very much, said one who had read all of this page.</p></div>" for c in ("feedback", "user-post", "reader-reviews", "guestbook"))
    assert main_text(f"<html><body><article>{whole}</article>{readers}</body></html>") == "Title\n\n" + LONG.strip()


def test_the_cut_takes_close_nodes_along():
    """A list beside prose goes with it although its own score speaks for boilerplate; far from it, it does not."""
    from hexcast.llm.htmltext import _edges, _nodes, blocks_of, main_text, min_cut

    page = f"<html><body><div><p>{LONG}</p><ul><li>first of a few</li><li>second of a few</li></ul><p>{LONG}</p></div></body></html>"
    nodes = _nodes(blocks_of(page))
    labels = min_cut([n["score"] for n in nodes], _edges(nodes))
    assert [n["score"] > 0 for n in nodes] == [True, False, True] and labels == [True, True, True]
    links = page.replace("first of a few", "<a href=1>first of a few</a>").replace("second of a few", "<a href=2>second of a few</a>")
    assert "first of a few" in main_text(page) and "first of a few" not in main_text(links)
    assert main_text("<html><body><div>© 2020 Company</div><h1>Title</h1><p>Some text here.</p><nav><ul><li><a href=1>x</a></li></ul></nav></body></html>") == "Title\n\nSome text here."
