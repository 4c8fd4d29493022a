"""Queries over pages, blocks and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pagehtml import blocks_to_html, edited_blocks, import_sanitized, parsed, plain_text, sanitized
from ..functions.text import split_text
from ..operators import documents as D
from ..sources.tables import table
from .registry import query


@query("txt02_blocks")
def blocks(spark, d):
    """SRC-13, TXT-01, TXT-02, TOP-06: each page's title and blocks."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html")
    return got.select("page_id", "title", F.posexplode("blocks").alias("i", "b")).select("page_id", "title", "i", "b.type", "b.level", "b.text")


@query("txt03_edited", r"""WITH x AS (SELECT doc_id, string_split(replace(text, chr(13), ' '), chr(10)) AS p FROM documents),
y AS (SELECT doc_id, unnest(list_filter(list_transform(p, lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: length(t) > 0)) AS text, generate_subscripts(list_filter(list_transform(p, lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: length(t) > 0), 1) AS i FROM x)
SELECT doc_id, CAST(i - 1 AS INT) AS i, 'paragraph' AS type, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM y""")
def edited(spark, d):
    """TXT-03: texts as an editor holds them, a line break after each line and markup escaped, back to paragraphs."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<div><script>x</script>"), F.regexp_replace(F.replace(safe, F.lit("\r"), F.lit(" ")), "\n", "<br>"), F.lit("</div>"))
    got = table(spark, d, "documents").select("doc_id", edited_blocks(html).alias("blocks"))
    return got.select("doc_id", F.posexplode("blocks").alias("i", "b")).select("doc_id", "i", "b.type", "b.text")


@query("txt04_html")
def rendered(spark, d):
    """TXT-04: blocks back to HTML."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html")
    return got.select("page_id", blocks_to_html(F.col("blocks")).alias("html"))


@query("txt05_sanitized", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:script|style|iframe|object|embed|template)\b.*?</(?:script|style|iframe|object|embed|template)\s*>', '', 'gis') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '<(/?)(b|strong|i|em|u|s|sub|sup|br|a|span)(?:[^\w>][^>]*)?>', chr(1) || '\1\2' || chr(2), 'g') AS h FROM a)
SELECT page_id, replace(replace(regexp_replace(h, '</?[a-zA-Z]\w*[^>]*>', '', 'g'), chr(1), '<'), chr(2), '>') AS text FROM b""")
def clean(spark, d):
    """TXT-05, SNK-11: whole pages cut down to inline markup."""
    return table(spark, d, "pages").select("page_id", sanitized("html").alias("text"))


@query("txt06_imported", r"""WITH a AS (SELECT page_id, regexp_replace(html, '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<form\b.*?</form\s*>', '', 'gis') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(h, '</?(?:link|meta|base|input|source|track)\b[^>]*>', '', 'gi') AS h FROM a)
SELECT page_id, regexp_replace(h, '<a href="/[^">]*">', '<a>', 'g') AS html FROM b""")
def imported(spark, d):
    """TXT-06: pages of an untrusted book without what can run, load files or restyle the reader."""
    return table(spark, d, "pages").select("page_id", import_sanitized("html").alias("html"))


@query("txt07_links", r"""WITH x AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, regexp_extract_all(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<a href="[^"]+">[^<]*</a>') AS h FROM pages),
y AS (SELECT page_id, o, unnest(h) AS a FROM x)
SELECT page_id, o || regexp_extract(a, '"([^"]+)"', 1) AS url, trim(regexp_replace(replace(replace(replace(regexp_extract(a, '>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM y""")
def links(spark, d):
    """TXT-07, FN-26: each link's address and title."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html").select("page_id", F.explode("links").alias("l"))
    return got.select("page_id", "l.url", "l.title")


@query("txt11_plain", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&middot;', '·'), '&quot;', '"'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS text FROM pages""")
def plain(spark, d):
    """TXT-11: tags dropped, references decoded, white space collapsed, over whole pages."""
    return table(spark, d, "pages").select("page_id", plain_text("html").alias("text"))


@query("txt12_parts")
def parts(spark, d):
    """TXT-12, TXT-13, AGG-19: narration parts with their block; headings equal to the title are not read."""
    got = parsed(table(spark, d, "pages"), "page_id", "url", "html").select("page_id", "title", F.posexplode("blocks").alias("block", "b"))
    read = got.filter(F.col("b.text").isNotNull() & ~((F.col("b.type") == "heading") & (F.col("b.text") == F.col("title"))))
    return read.select("page_id", "block", F.posexplode(split_text(F.col("b.text"))).alias("part", "text"))


@query("flt08_page_lines", r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), k AS (SELECT * FROM l WHERE trim(raw) <> ''),
e AS (SELECT *, seq = min(seq) OVER (PARTITION BY id) OR seq = max(seq) OVER (PARTITION BY id) AS edge FROM k)
SELECT id, seq, trim(raw) AS text, max(length(trim(raw))) OVER (PARTITION BY id) AS width FROM e WHERE NOT (edge AND regexp_matches(trim(raw), '^[-–—\s]*\d+[-–—\s]*$'))""")
def page_lines(spark, d):
    """SRC-12, FLT-08, AGG-10: each line with its page's width."""
    from pyspark.sql.window import Window

    got = D.page_lines(table(spark, d, "documents"), "doc_id", "text")
    return got.select("id", "seq", "text", F.max(F.length("text")).over(Window.partitionBy("id", "page")).alias("width"))


@query("win12_paragraphs", r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents), k AS (SELECT * FROM l WHERE trim(raw) <> ''),
e AS (SELECT *, seq = min(seq) OVER (PARTITION BY id) OR seq = max(seq) OVER (PARTITION BY id) AS edge FROM k),
p AS (SELECT id, seq, trim(raw) AS text, regexp_matches(raw, '^\s') AS indented FROM e WHERE NOT (edge AND regexp_matches(trim(raw), '^[-–—\s]*\d+[-–—\s]*$'))),
q AS (SELECT *, max(length(text)) OVER (PARTITION BY id) AS width, lag(text) OVER (PARTITION BY id ORDER BY seq) AS prev FROM p),
b AS (SELECT *, prev IS NULL OR indented OR (regexp_matches(prev, '[.!?…:;"''”’»)\]]$') AND (length(prev) < width * 0.9 OR length(text) < width * 0.9)) AS br FROM q),
n AS (SELECT id, seq, text, sum(br::INT) OVER (PARTITION BY id ORDER BY seq) AS paragraph FROM b)
SELECT id, CAST(paragraph AS BIGINT) AS paragraph, replace(regexp_replace(string_agg(text, chr(1) ORDER BY seq), '([A-Za-zÀ-ỹ])-\x01([a-zà-ỹ])', '\1\2', 'g'), chr(1), ' ') AS text FROM n GROUP BY id, paragraph""")
def paragraphs(spark, d):
    """WIN-12, TXT-21, TXT-28, FN-08: each paragraph's text."""
    return D.paragraphs(D.page_lines(table(spark, d, "documents"), "doc_id", "text")).select("id", "paragraph", "text")


_LETTERS = ["a", "e", "i", "o", "u"]


@query("agg12_votes", r"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark) GROUP BY 1),
allw AS (SELECT word, n FROM w UNION ALL SELECT replace(word, 'e', '|'), n FROM w WHERE length(word) - length(replace(word, 'e', '')) = 1),
broken AS (SELECT word, sum(n) AS n FROM allw WHERE instr(word, '|') > 0 AND word <> '|' GROUP BY 1),
tried AS (SELECT b.word, l.letter, k.n AS found FROM broken b CROSS JOIN (SELECT unnest(['a','e','i','o','u']) AS letter) l JOIN w k ON k.word = replace(b.word, '|', l.letter)),
votes AS (SELECT letter, sum(v) AS votes FROM (SELECT letter, found / sum(found) OVER (PARTITION BY word) AS v FROM tried) GROUP BY 1)
SELECT '|' AS symbol, arg_max(letter, votes) AS letter, round(max(votes), 4) AS votes, (SELECT CAST(sum(n) AS BIGINT) FROM broken) AS seen FROM votes""")
def votes(spark, d):
    """AGG-12, AGG-14, TXT-24, TXT-25: words with e replaced by | vote for e."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    once = F.length("word") - F.length(F.replace("word", F.lit("e"), F.lit(""))) == 1
    broken = words.filter(once).select(F.replace("word", F.lit("e"), F.lit("|")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    got = D.symbol_letters(words.unionByName(broken), "|{}", _LETTERS)
    return got.select("symbol", "letter", F.round("votes", 4).alias("votes"), "seen")
