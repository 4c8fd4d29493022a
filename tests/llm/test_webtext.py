"""Main text of varied layouts, and of long broken pages."""

import itertools
import random
import time

import pytest

from loomspark.llm import webtext

LONG = ["The first paragraph of this article has a good number of words, and it ends with a full stop.", "A second paragraph goes on for a while about one thing and another, with commas, and ends.", "The third paragraph closes the whole story in a calm and measured tone for its readers."]
SHORT = [f"Short line {i}." for i in range(12)]
WRAPPERS = {
    "article": ("<article>", "</article>"),
    "main": ("<main>", "</main>"),
    "plain div": ("<div>", "</div>"),
    "good name": ('<div class="entry-content">', "</div>"),
    "state names": ('<article class="post tag-social category-news comments-open">', "</article>"),
    "open comments": ('<div class="comments-open hentry">', "</div>"),
    "whole-page form": ('<form id="aspnetForm"><div>', "</div></form>"),
    "nested": ("<div><div><section>", "</section></div></div>"),
    "table": ("<table><tr><td>", "</td></tr></table>"),
    "unclosed": ("<div><article>", ""),
}
AROUND = {
    "nothing": ("<body>", ""),
    "sidebar body": ('<body class="right-sidebar">', ""),
    "menu and footer": ('<body class="no-sidebar"><header><a href="/">Site name</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>', "<footer>&copy; 2020 Somebody. All rights reserved.</footer>"),
    "sidebar and cookies": ('<body><div class="cookie-banner">We use cookies to make this site better for all of you.</div>', '<div id="sidebar"><ul><li><a href=c>Some other story that you may like</a></ul></div>'),
    "comments": ("<body>", '<section id="comments"><p>I think this is very good, thanks.</p></section><script>var p="<p>no</p>";</script>'),
}


@pytest.mark.parametrize(("wrapper", "around"), list(itertools.product(WRAPPERS, AROUND)))
@pytest.mark.parametrize("texts", [LONG, SHORT], ids=["long", "short"])
def test_layouts(wrapper, around, texts):
    (a, b), (c, d) = WRAPPERS[wrapper], AROUND[around]
    page = f"<html><head><title>T</title></head>{c}{a}" + "".join(f"<p>{t}</p>" for t in texts) + f"{b}{d}</html>"
    assert webtext.main_text(page) == texts


BOXES = {
    "page builder": ('<div class="elementor-widget elementor-widget-text-editor">', "</div>"),
    "widget": ('<section class="widget">', "</section>"),
    "numbered widget": ('<section id="widget-{i}">', "</section>"),
    "history": ('<div class="social-history">', "</div>"),
    "paper": ('<div class="discussion-paper">', "</div>"),
    "aside": ("<aside>", "</aside>"),
    **{w: (f'<div class="{w}">', "</div>") for w in sorted(webtext._BAD_WORDS)},
}


@pytest.mark.parametrize("box", list(BOXES))
@pytest.mark.parametrize(("wrapper", "around"), [("plain div", "nothing"), ("main", "menu and footer"), ("article", "sidebar and cookies"), ("good name", "comments"), ("table", "sidebar body")])
def test_an_article_in_equal_boxes_is_kept_whole(box, wrapper, around):
    (a, b), (c, d), (e, f) = WRAPPERS[wrapper], AROUND[around], BOXES[box]
    if box == around == "comments":
        d = ""  # a page that gives its text and its readers' the same name tells them apart by nothing
    for n in (2, 3, 8):
        texts = [f"{LONG[i % 3]} {i}." for i in range(n)]
        page = f"<html><head><title>T</title></head>{c}{a}" + "".join(f"{e.replace('{i}', str(i))}<p>{t}</p>{f}" for i, t in enumerate(texts)) + f"{b}{d}</html>"
        assert webtext.main_text(page) == texts, n


def test_many_boxes_of_comments_under_a_short_text_go():
    comments = "".join(f'<div class="comment"><p>Reader {i} says at some length that this was a good piece, and that it was worth reading.</p></div>' for i in range(40))
    assert webtext.main_text(f"<body><div><p>{LONG[0]}</p></div><div>{comments}</div></body>") == LONG[:1]


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!-- a --!>", "<!---->", "<!-- a -- > b -->", "<!-- <p>no</p> -->"])
def test_comments_end_as_in_browsers(comment):
    assert webtext.main_text(f"<article><p>{LONG[0]}</p>{comment}<p>{LONG[1]}</p></article>") == LONG[:2]


def test_an_entry_keeps_its_heading_and_loses_its_comments_and_adverts():
    page = (
        '<article><header class="entry-header"><h1>A heading</h1></header><p>' + LONG[0] + '</p><div class="ad-box">Buy this now, it is very cheap.</div><p>'
        + LONG[1] + '</p><div class="post-comments">' + "<p>A reader says at some length that this was a good piece, and that it was worth reading.</p>" * 40 + "</div></article>"
    )
    assert webtext.main_text(page) == ["A heading", *LONG[:2]]


@pytest.mark.parametrize("piece", ["<div ", "<!-- ", '<a ="', "<div>", "<p>x", "<svg>", "<", "</x", '<a x="> ', "<li><a>b.</a> c. "])
def test_long_broken_pages_take_time_in_proportion(piece):
    n = 1_000_000 // len(piece)
    began = time.time()
    webtext.main_text(piece * n)
    assert time.time() - began < 20  # 1 MB; in proportion it takes about 3 s here, by the square hours


def test_broken_markup_keeps_the_text_behind_it():
    tail = "".join(f"<p>{t}</p>" for t in LONG)
    for start in ('<a title=don\'t x="1>2">', "<svg><g>", "</", "<a b='", "<>", "<!doctype html>", "<?x?>", "< p", "<br/><hr>"):
        assert webtext.main_text(f"<article>{start}{tail}</article>")[-2:] == LONG[-2:], start


def test_random_cuts_are_minimal_beyond_trees():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(2, 9)
        margins = [rng.randrange(-9, 10) for _ in range(n)]
        edges = {(a, b): rng.randrange(1, 8) for a in range(n) for b in range(a) if rng.random() < 0.6}
        cost = lambda side: sum(max(0, m) if not s else max(0, -m) for m, s in zip(margins, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])
        assert cost(webtext.minimum_cut(margins, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))
