"""Elements of pages: outlines against a recursive walk, selectors and readers against a walk of the tree, missed links by place."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.functions.pagetree import GONE, Picker, Selector, Tree, elements
from loomspark.operators import trees as T
from loomspark.plans.trees import SITES
from loomspark.sources.sites import Site, site_chapters


def kids(tree, e):
    return [x for x in tree.elements if x.parent == e.n and not x.gone]


def text_of(tree, e):
    return "".join(tree.parts)[e.start : e.end]


def collapse(s):
    return " ".join(s.split())


def recursive_outline(page, most=30_000, deepest=14):
    tree = Tree().read(page)
    body = next((e for e in tree.elements if e.tag == "body"), None)
    if body is None:
        return None
    lines, chars = [], 0

    def look(e, depth=2):
        a = dict(reversed(e.attrs))
        names = "{" + " ".join(sorted(k for k, _ in e.attrs)) + "}" if e.tag == "img" else ""
        return (e.tag, a.get("class", ""), names, tuple(look(k, depth - 1) for k in kids(tree, e)) if depth else ())

    def label(e):
        a = dict(reversed(e.attrs))
        out = e.tag + (f"#{a['id']}" if a.get("id") else "") + "".join("." + c for c in a.get("class", "").split()[:4])
        if e.tag == "a":
            out += f' href="{a.get("href", "")[:80]}"'
        if e.tag == "img":
            out += " " + " ".join(f'{k}="{"data:…" if v.startswith("data:") else v[:80]}"' for k, v in e.attrs if k not in ("class", "id"))
        own = collapse(" ".join(e.own))[:60]
        whole = text_of(tree, e)
        size = f" [{len(collapse(whole))} chars of text]" if kids(tree, e) and len(whole) > 500 else ""
        return f"<{out}>{' ' + own if own else ''}{size}"

    def walk(e, depth):
        nonlocal chars
        if chars > most or depth > deepest:
            return
        lines.append("  " * depth + label(e))
        chars += len(lines[-1])
        below = kids(tree, e)
        i = 0
        while i < len(below):
            run = 1
            while i + run < len(below) and look(below[i + run]) == look(below[i]):
                run += 1
            for k in below[i : i + min(run, 2)]:
                walk(k, depth + 1)
            if run > 2:
                lines.append("  " * (depth + 1) + f"… +{run - 2} similar <{below[i].tag}>")
            i += run

    walk(body, 0)
    return "\n".join(lines)


def random_page(rng, n=60):
    out = ["<html><head><title>T  t</title></head><body>"]
    open_ = []
    for _ in range(n):
        tag = rng.choice(["div", "ul", "li", "li", "li", "p", "a", "img", "span", "script", "section", "svg"])
        attrs = rng.choice(["", "", ' class="x"', ' class="x y z w v"', ' id="i"', ' href="/a"', ' src="data:xx" alt=t', ' class="y" src="/p.png"'])
        out.append(f"<{tag}{attrs}>" + rng.choice(["", "some  words ", "wörds &amp; more", "w " * 300]))
        if tag == "img":
            continue
        open_.append(tag)
        while open_ and rng.random() < 0.5:
            out.append(f"</{open_.pop()}>")
    return "".join(out)


def outlines(spark, pages, **limits):
    df = spark.createDataFrame([(i, "https://h.org/", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    return {r["id"]: r["outline"] for r in T.skeletons(elements(df).repartition(5), **limits).collect()}


def test_outlines_are_those_of_a_recursive_walk(spark):
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(30)] + ["<body>" + "<div>" * 20 + "deep", "<body>" + "".join(f'<p class="c{i}">word</p>' for i in range(400)), "<body><ul><li>a<li>b<li>c<li>d</ul>", "no body", "", None]
    for limits in ({}, {"most_chars": 300, "deepest": 5}):
        want = {i: w for i, p in enumerate(pages) if (w := recursive_outline(p or "", *limits.values())) is not None}
        assert outlines(spark, pages, **limits) == want


def test_outlines_of_all_given_pages(spark, sf="/root/testdata/sf0.001"):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r["id"]: r["outline"] for r in T.skeletons(elements(spark.read.parquet(f"{sf}/pages.parquet"))).collect()}
    assert got == {r["page_id"]: w for r in rows if (w := recursive_outline(r["html"] or "")) is not None}


def fits(tree, e, steps):
    """Whether an element completes a selector's steps [(combinator, tag, id, classes)], by its ancestors."""
    comb, tag, ids, classes = steps[-1]
    a = dict(e.attrs)
    if tag and tag != e.tag or not ids <= {a.get("id")} or not classes <= set(a.get("class", "").split()):
        return False
    if len(steps) == 1:
        return True
    above = []
    up = e.parent
    while up is not None:
        above.append(tree.elements[up])
        up = tree.elements[up].parent
    return any(fits(tree, x, steps[:-1]) for x in (above[:1] if comb == ">" else above))


SELECTORS = {
    "li": [[(" ", "li", set(), set())]],
    "div li": [[(" ", "div", set(), set()), (" ", "li", set(), set())]],
    "div > li": [[(" ", "div", set(), set()), (">", "li", set(), set())]],
    "ul>li.x": [[(" ", "ul", set(), set()), (">", "li", set(), {"x"})]],
    "#i .x > *": [[(" ", "", {"i"}, set()), (" ", "", set(), {"x"}), (">", "", set(), set())]],
    "p.y.x, section > div": [[(" ", "p", set(), {"x", "y"})], [(" ", "section", set(), set()), (">", "div", set(), set())]],
}


@pytest.mark.parametrize("text", list(SELECTORS))
def test_selectors_are_those_of_a_walk_up_the_tree(text):
    rng = random.Random(text)
    selector = Selector(text)
    for _ in range(30):
        tree = Tree().read(random_page(rng))
        sets = {}
        for e in tree.elements:
            sets[e.n] = selector.enter(sets.get(e.parent, (0, 0)), e.tag, dict(e.attrs))
            assert selector.hit(sets[e.n]) == any(fits(tree, e, option) for option in SELECTORS[text]), (text, e.tag, e.attrs)


def test_selectors_that_are_none_are_refused():
    for wrong in ("", "a[href]", "a > ", "> a >", "a:first-child", "a,,b"):
        with pytest.raises(ValueError):
            Selector(wrong)


def walked(page, selector):
    """The texts right in each block element inside what a selector takes, in order; for pages whose text is all in <p>, <li> and headings."""
    tree = Tree().read(page)
    sets, inside, out = {}, set(), []
    for e in tree.elements:
        sets[e.n] = selector.enter(sets.get(e.parent, (0, 0)), e.tag, dict(e.attrs))
        if selector.hit(sets[e.n]) or e.parent in inside:
            inside.add(e.n)
            if e.tag in ("p", "li", "h1", "h2") and not e.gone and collapse(text_of(tree, e)):
                out.append(collapse(text_of(tree, e)))
    return out


def test_readers_take_what_a_walk_takes(spark):
    rng = random.Random(9)
    part = lambda: "".join(f"<{t}>{rng.choice(['', 'Some <b>bold</b> words', 'Plain &amp; simple', '<a href=x>linked</a> text'])}</{t}>" for t in rng.choices(["p", "h2", "li"], k=5))
    page = lambda: f'<title>Head</title><nav><p>menu</p></nav><div class="title">The <i>name</i></div><p>before</p><article>{part()}<div class="ad"><p>advert</p></div>{part()}</article><div id="storytext">{part()}<script>no()</script></div><footer><p>foot</p></footer>'
    hosts = ["a.example.net", "example.org", "www.b.example.com", "elsewhere.de"]
    pages = [(i, f"https://{hosts[i % 4]}/x", page()) for i in range(40)] + [(100, "https://example.net/", None), (101, "https://example.net/y", "<article><p>Un<p>closed"), (102, None, "<article><p>x")]
    got = {r["page_id"]: r for r in site_chapters(spark.createDataFrame(pages, "page_id int, url string, html string"), SITES).collect()}
    assert set(got) == {i for i, u, _ in pages if u and "example" in u}
    for i, url, html in pages:
        if i in got:
            site = SITES[got[i]["reader"]]
            assert site.domain in url
            assert [b["text"] for b in got[i]["blocks"]] == walked(html or "", Selector(site.content)), i
    assert {got[i]["title"] for i in range(2, 40, 4)} == {"The name"} and {got[i]["title"] for i in range(0, 40, 4)} == {"Head"}
    assert got[0]["locked"] and not got[1]["locked"] and (got[100]["title"], got[100]["blocks"]) == ("https://example.net/", [])


def test_a_reader_keeps_the_whole_of_nested_content(spark):
    html = '<div id=a><div id=a><p>one</p></div>two<table><tr><td>x</td></tr></table></div><p>after</p>'
    title, locked, blocks = Picker("https://h.org/", Selector("#a"), Selector("h1"), Selector("#a #a")).read(html)
    assert (title, locked) == ("", True)
    assert [b["text"] for b in blocks] == ["one", "two", "<table><tr><td>x</td></tr></table>"]
    df = spark.createDataFrame([(1, "https://h.org/x", html)], "page_id int, url string, html string")
    assert site_chapters(df, {"h": Site("other.org", "p")}).count() == 0


def pages_of(spark, html):
    return spark.createDataFrame([(1, "https://h.org/story/", html)], "id int, url string, html string")


def test_links_count_only_where_listed_ones_are_unless_none_is_on_the_page(spark):
    html = '<body><nav><a href="/c/7">menu</a></nav><div id="l"><a href="/c/1">1</a><a href="/c/2"></a><a href="/c/2#x">two</a><a href="https://www.h.org/c/3">3</a><a href="https://o.org/c/4">4</a><a href="/about">x</a></div>'
    df = pages_of(spark, html)
    listed = lambda *urls: spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "id int, pos int, url string")
    got = {(r["url"], r["title"]) for r in T.missed_chapters(elements(df, "id"), listed("https://h.org/c/1"), df).collect()}
    assert got == {("https://h.org/c/2", "https://h.org/c/2"), ("https://www.h.org/c/3", "3")}
    far = {r["url"] for r in T.missed_chapters(elements(df, "id"), listed("https://h.org/c/100"), df).collect()}
    assert far == {f"https://h.org/c/{i}" for i in (1, 2, 7)} | {"https://www.h.org/c/3"}
    assert T.missed_chapters(elements(df, "id"), listed("https://h.org/c/1").limit(0), df).count() == 0


@pytest.mark.parametrize(
    ("pager", "listed", "unread"),
    [("<a href='?page=5'>next</a>", 2, 4), ("<a href='?page=2'>next</a>", 2, 0), ("<button>9</button>", 2, 8), ("<button>9</button>", 3, 0), ("<a href='/story?page=6'>x</a><button>4</button>", 2, 5), ("<button>12345</button>", 2, 0), ("</div></div></div></div></div><ol><ol><ol><ol><button>9</button>", 2, 0)],
)
def test_unread_pages(spark, pager, listed, unread):
    html = f'<body><div><div><div><div><div><a href="/c/1">1</a><a href="/c/2">2</a>{pager}'
    df = pages_of(spark, html)
    rows = spark.createDataFrame([(1, i, f"https://h.org/c/{i}") for i in range(1, listed + 1)], "id int, pos int, url string")
    assert [r["unread"] for r in T.unread_pages(elements(df, "id"), rows, df).collect()] == [unread]


def test_elements_of_broken_pages():
    for page in ("", "plain", "</p></div>", "<p>a<p>b<div>c", "<li>a<li>b", "<img><br/>x", "<div/>y", "<a b=c d"):
        tree = Tree().read(page)
        assert [e.n for e in tree.elements] == list(range(len(tree.elements)))
        for e in tree.elements:
            assert e.n < e.stop <= len(tree.elements) and e.start <= e.end <= tree.length
            assert e.parent is None or tree.elements[e.parent].n < e.n < e.stop <= tree.elements[e.parent].stop
    assert "script" in GONE


def sequential_calls(scripts, budget):
    literal = re.compile(r"[`\"']([^`\"'\s]*/[^`\"'\s]*(?:chuong|chapter)[^`\"'\s]*)[`\"']", re.I)
    seen, out, used = set(), [], 0
    for pos, code in scripts:
        if used >= budget:
            break
        for i, m in enumerate(literal.finditer(code)):
            own = m.group(1)
            if own in seen or re.search(r"\.(js|css|png|jpe?g|webp|svg|ico)\b|^/_next|^//", own, re.I):
                continue
            seen.add(own)
            snippet = collapse(code[max(0, m.start() - 220) : m.start() + len(own) + 260])
            if used + len(snippet) > budget:
                break
            out.append((pos, i, own, snippet))
            used += len(snippet)
    return out


def test_calls_are_those_of_a_reader_of_all_scripts(spark):
    rng = random.Random(12)
    piece = lambda: rng.choice(['"/api/chapter/%d"' % rng.randrange(6), "'/x/Chuong-1'", "`/chapters.css`", '"//cdn/chapter"', "'no chapter here'", " ; ", "\n  code()  ", "y" * rng.randrange(200), '"', "'/a/chapter"])
    pages = {p: [(s, "".join(piece() for _ in range(rng.randrange(30)))) for s in range(rng.randrange(5))] for p in range(30)}
    df = spark.createDataFrame([(p, s, c) for p, own in pages.items() for s, c in own] + [(99, 0, None)], "id int, pos int, code string")
    for budget in (5000, 900):
        got = {}
        for r in T.script_calls(df.repartition(3), budget).orderBy("id", "pos", "i").collect():
            got.setdefault(r["id"], []).append((r["pos"], r["i"], r["literal"], r["snippet"]))
        assert got == {p: w for p, own in pages.items() if (w := sequential_calls(own, budget))}


def test_scripts_are_shown_within_a_budget(spark):
    html = '<script src=/a.js></script><script>short</script><script type="application/json">{"a": "long enough data"}</script><script>' + "a" * 50 + "</script><script src=/b.js>x</script><script>" + "b " * 40 + "</script><script>" + "c" * 30 + "</script>"
    df = spark.createDataFrame([(1, "https://h.org/", html), (2, "https://h.org/", "<p>none")], "page_id int, url string, html string")
    got = {r["id"]: r["scripts"] for r in T.page_scripts(elements(df), budget=100, longest=60).collect()}
    assert got == {1: "External scripts: /a.js, /b.js\nInline script: " + "a" * 50 + "\nInline script: " + ("b " * 40)[:50] + " …", 2: "(none)"}
    assert T.page_scripts(elements(df.limit(0))).count() == 0
