"""Queries over the elements of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pagetree import elements
from ..operators import trees as T
from ..sources.sites import Site, site_chapters
from ..sources.tables import table
from .registry import query

#: Three sites of different build: paragraphs of an article, all of an article, and whatever is right below it.
SITES = {
    "net": Site("example.net", "article p", "article > h1", ".paywall, div.ad"),
    "org": Site("example.org", "body > article", "h1"),
    "com": Site("example.com", "article > p, article > ul, #storytext", "article h1, .title", "#locked"),
}


@query("src26_sites")
def sites(spark, d):
    """SRC-26: chapters by the readers of three sites."""
    got = site_chapters(table(spark, d, "pages"), SITES)
    return got.select("page_id", "reader", "title", "locked", F.posexplode_outer("blocks").alias("i", "b")).select("page_id", "reader", "title", "locked", "i", "b.type", "b.level", "b.text")


@query("txt09_skeleton")
def skeleton(spark, d):
    """TXT-09: each page's outline."""
    return T.skeletons(elements(table(spark, d, "pages"))).select(F.col("id").alias("page_id"), "outline")


def _listed(spark, d):
    """``pages`` with a list of seven chapters put in front, as links in a box; the fifth and some others are listed already.

    Links of the same shape stand in the page's menu too, a pager of numbered buttons beside every third page's list and of
    addresses below others', and pictures of which some load late.
    """
    p = table(spark, d, "pages")
    n = F.col("page_id").cast("string")
    link = lambda i: F.concat(F.lit(f'<li><a href="/c/{i}-'), n, F.lit(f'#top"> Part\n{i} </a></li>'))
    items = F.concat(*[link(i) for i in range(7)])
    menu = F.concat(F.lit('<nav id="menu"><ul><li><a href="/c/99-'), n, F.lit('">Menu</a></li></ul></nav>'))
    buttons = F.when(F.col("page_id") % 3 == 0, F.lit("<p><button>2</button><button>12</button></p>")).otherwise(F.concat(F.lit('<p><a href="?page=4">last</a> <a href="/x">77</a></p>')))
    pictures = F.concat(*[F.concat(F.lit(f'<img src="/i/{i}-'), n, F.lit('.png">')) if i < 2 else F.concat(F.lit('<img src="data:," data-late="/i/'), F.lit(f"{i}-"), n, F.lit('.png 2x">')) for i in range(4)])
    advert = F.concat(F.lit('<aside><img src="/i/50-'), n, F.lit('.png"></aside>'))
    body = F.concat(F.lit('<div id="toc"><ul>'), items, F.lit("</ul>"), buttons, F.lit('</div><div id="pics">'), pictures, F.lit("</div>"), advert)
    html = F.concat(menu, body, F.coalesce("html", F.lit("")))
    host = F.concat(F.lit("https://www.h"), n, F.lit(".org"))
    made = p.select(F.col("page_id").alias("id"), F.concat(host, F.lit("/list/")).alias("url"), html.alias("html"))
    had = lambda kind, nums, end: made.select("id", F.explode(F.array(*[F.lit(i) for i in nums])).alias("pos")).select("id", "pos", F.concat(F.lit("https://www.h"), F.col("id").cast("string"), F.lit(f".org/{kind}/"), F.col("pos").cast("string"), F.lit("-"), F.col("id").cast("string"), F.lit(end)).alias("url"))
    return made, had


@query("txt08_missed_in_place", """SELECT page_id AS id, 'https://www.h' || page_id || '.org/c/' || i || '-' || page_id AS url, 'Part ' || i AS title FROM pages, (SELECT unnest([2, 4, 6]) AS i)""")
def missed(spark, d):
    """TXT-08: chapters that a list left out, but none of the menu's."""
    made, had = _listed(spark, d)
    return T.missed_chapters(elements(made, "id"), had("c", [0, 1, 3, 5], ""), made)


@query("txt08_unread", """SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 11 ELSE 76 END AS unread FROM pages""")
def unread(spark, d):
    """TXT-08: pages of a list that were not read, by numbered buttons and links beside it."""
    made, had = _listed(spark, d)
    return T.unread_pages(elements(made, "id"), had("c", [0, 1, 3, 5], ""), made)


@query("txt08_pictures", """SELECT page_id AS id, 'https://www.h' || page_id || '.org/i/' || i || '-' || page_id || '.png' AS url FROM pages, (SELECT unnest([2, 3]) AS i)""")
def pictures(spark, d):
    """TXT-08: pictures that load late, but not the advert's."""
    made, had = _listed(spark, d)
    return T.missed_pictures(elements(made, "id"), had("i", [0, 1], ".png"))


@query("txt10_scripts", r"""WITH h AS (SELECT page_id AS id, '<script src="/s' || page_id || '.js"></script><script>' || repeat('x = 1; ', 700) || '</script>' || html AS html FROM pages),
s AS (SELECT id, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1), 1) AS n FROM h),
t AS (SELECT id, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM s),
u AS (SELECT id, n, text, least(length(text), 4000) AS size FROM t WHERE length(text) >= 20),
v AS (SELECT *, 8000 - coalesce(sum(size) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM u),
w AS (SELECT id, n, text, text[:CAST(least(size, room) AS BIGINT)] AS part FROM v WHERE room > 0)
SELECT id, 'External scripts: /s' || id || '.js' || chr(10) || string_agg('Inline script: ' || part || CASE WHEN length(part) < length(text) THEN ' …' ELSE '' END, chr(10) ORDER BY n) AS scripts FROM w GROUP BY id""")
def scripts(spark, d):
    """TXT-10: each page's script files and the beginnings of its scripts, behind a long one."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<script src="/s'), n, F.lit('.js"></script><script>' + "x = 1; " * 700 + "</script>"), F.col("html"))
    return T.page_scripts(elements(table(spark, d, "pages").withColumn("html", html)).withColumnRenamed("page_id", "id"))


@query("txt34_calls", r"""WITH t AS (SELECT doc_id AS id, text || ' fetch("/api/chapter/' || doc_id || '?p=" + n); get(''/js/chapter.js''); fetch(`/api/chapter/' || doc_id || '?p=`) ' || text AS code, '/api/chapter/' || doc_id || '?p=' AS literal FROM documents),
p AS (SELECT id, code, literal, strpos(code, '"' || literal || '"') - 1 AS at0 FROM t)
SELECT id, literal, trim(regexp_replace(code[greatest(at0 - 220, 0) + 1:at0 + length(literal) + 260], '\s+', ' ', 'g')) AS snippet FROM p""")
def calls(spark, d):
    """TXT-34: the request in code made of whole documents, once, with what stands around it."""
    n = F.col("doc_id").cast("string")
    code = F.concat(F.col("text"), F.lit(' fetch("/api/chapter/'), n, F.lit("?p=\" + n); get('/js/chapter.js'); fetch(`/api/chapter/"), n, F.lit("?p=`) "), F.col("text"))
    return T.script_calls(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), code.alias("code"))).select("id", "literal", "snippet")
