"""What the elements of pages tell: an outline, and links and pictures that a reader has missed. Rows come from `elements`."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapsed
from ..functions.values import address_shape, host_name
from ..sources.tables import stored

UPTO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def _attribute(name: str):
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def skeletons(elements: DataFrame, most_chars: int = 30_000, deepest: int = 14) -> DataFrame:
    """(id, outline): a page's tags, ids, classes, links, picture addresses and beginnings of texts, a line each, indented.

    Of neighbours that look alike two levels down only two are shown, with the number of the others. Lines deeper than
    ``deepest`` below the body, and all that follow once over ``most_chars`` characters are out (lines of numbers don't
    count), are left out. Looks are compared by joins of children to parents, runs by windows, and what is inside a line
    that is left out by the numbers of its descendants; no page is walked.
    """
    x = elements.filter("not gone")
    top = x.filter("tag = 'body'").groupBy("id").agg(F.min(F.struct("n", "stop", "depth")).alias("b"))
    x = x.join(top, "id").filter("n >= b.n and n < b.stop").withColumn("level", F.col("depth") - F.col("b.depth"))
    cls = F.coalesce(_attribute("class"), F.lit(""))
    names = F.when(F.col("tag") == "img", F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform("attrs", lambda a: a["name"])), " "), F.lit("}"))).otherwise("")
    x = x.withColumn("look0", F.concat_ws(".", "tag", cls, names))
    for depth in (0, 1):
        kids = x.select("id", F.col("parent").alias("_up"), F.struct(F.col("n"), F.col(f"look{depth}").alias("look")).alias("kid")).groupBy("id", "_up").agg(F.transform(F.array_sort(F.collect_list("kid")), lambda k: k["look"]).alias("kids"))
        below = kids.select("id", F.col("_up").alias("n"), F.md5(F.to_json("kids")).alias("inner"))
        x = x.join(below, ["id", "n"], "left").withColumn(f"look{depth + 1}", F.concat_ws("/", "look0", F.coalesce("inner", F.lit("")))).drop("inner")
    among = Window.partitionBy("id", "parent").orderBy("n")
    x = x.withColumn("new", F.coalesce(F.col("look2") != F.lag("look2").over(among), F.lit(True)).cast("int"))
    x = x.withColumn("run", F.sum("new").over(among.rowsBetween(*UPTO)))
    inside = Window.partitionBy("id", "parent", "run")
    x = x.withColumn("nth", F.row_number().over(inside.orderBy("n"))).withColumn("alike", F.count("*").over(inside))
    page = Window.partitionBy("id").orderBy("n")
    folded = F.coalesce(F.max(F.when((F.col("nth") > 2) & (F.col("level") > 0), F.col("stop"))).over(page.rowsBetween(*BEFORE)), F.lit(0)) > F.col("n")
    x = x.withColumn("hidden", folded | ((F.col("nth") > 2) & (F.col("level") > 0)) | (F.col("level") > deepest))

    id_ = F.when(F.coalesce(_attribute("id"), F.lit("")) != "", F.concat(F.lit("#"), _attribute("id"))).otherwise("")
    classes = F.array_join(F.transform(F.slice(F.filter(F.split(cls, r"\s+"), lambda c: c != ""), 1, 4), lambda c: F.concat(F.lit("."), c)), "")
    href = F.when(F.col("tag") == "a", F.concat(F.lit(' href="'), F.substring(F.coalesce(_attribute("href"), F.lit("")), 1, 80), F.lit('"'))).otherwise("")
    shown = F.filter("attrs", lambda a: ~a["name"].isin("class", "id"))
    value = lambda a: F.when(a["value"].startswith("data:"), F.lit("data:…")).otherwise(F.substring(a["value"], 1, 80))
    picture = F.when(F.col("tag") == "img", F.concat(F.lit(" "), F.array_join(F.transform(shown, lambda a: F.concat(a["name"], F.lit('="'), value(a), F.lit('"'))), " "))).otherwise("")
    own = F.substring("own", 1, 60)
    size = F.when((F.col("children") > 0) & (F.col("raw") > 500), F.concat(F.lit(" ["), F.col("chars").cast("string"), F.lit(" chars of text]"))).otherwise("")
    label = F.concat(F.lit("<"), "tag", id_, classes, href, picture, F.lit(">"), F.when(own != "", F.concat(F.lit(" "), own)).otherwise(""), size)
    x = x.withColumn("line", F.concat(F.repeat(F.lit("  "), F.col("level")), label))
    used = F.coalesce(F.sum(F.when(~F.col("hidden"), F.char_length("line"))).over(page.rowsBetween(*BEFORE)), F.lit(0))
    x = x.withColumn("told", ~F.col("hidden") & (used <= most_chars))
    rest = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("… +"), (F.col("alike") - 2).cast("string"), F.lit(" similar <"), "tag", F.lit(">"))
    told = x.filter("told").select("id", "n")
    lines = x.filter("told").select("id", "n", "line")
    numbers = x.filter("nth = 3 and level > 0").join(told.select("id", F.col("n").alias("parent")), ["id", "parent"], "left_semi").select("id", "n", rest.alias("line"))
    both = lines.unionByName(numbers)
    # the budget bounds what is gathered of a page, but for a line to each run
    return both.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda t: t["line"]), "\n").alias("outline"))


def _common_shape(urls: DataFrame) -> DataFrame:
    """(id, shape) that most of a page's addresses have; of equals the one seen first. urls: id, pos, url."""
    shapes = urls.withColumn("shape", address_shape(F.col("url"))).groupBy("id", "shape").agg(F.count("*").alias("n"), F.min("pos").alias("s"))
    return shapes.groupBy("id").agg(F.max_by("shape", F.struct("n", (-F.col("s")).alias("s"))).alias("shape"))


def missed_chapters(elements: DataFrame, listed: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, url, title): links like those of a list, in the same place on the page, that the list lacks; each once.

    listed: id, pos, url; pages: id, url. A link counts if it leads to the page's host, has the shape that most listed
    addresses have, and sits where a listed one sits (its ancestors have the same tags and ids); where no listed address is
    on the page, all places count. Fragments don't count. A title is the link's text, or else its address.
    """
    links = elements.filter("tag = 'a' and address is not null").select("id", "n", "place", F.regexp_replace("address", "#.*$", "").alias("url"), collapsed(F.col("text")).alias("title"))
    links = stored(links)  # pages are parsed once
    own = listed.select("id", "url").distinct()
    places = links.join(own, ["id", "url"], "left_semi").select("id", "place").distinct()
    anywhere = own.select("id").distinct().join(places, "id", "left_anti")
    near = links.join(pages.select("id", host_name(F.col("url")).alias("host")), "id").filter(host_name(F.col("url")) == F.col("host")).withColumn("shape", address_shape(F.col("url")))
    near = near.join(_common_shape(listed), ["id", "shape"]).join(own, ["id", "url"], "left_anti").select("id", "n", "place", "url", "title")
    seated = near.join(places, ["id", "place"], "left_semi").unionByName(near.join(anywhere, "id", "left_semi").select("id", "place", "n", "url", "title"))
    first = seated.groupBy("id", "url").agg(F.min_by("title", "n").alias("title"))
    return first.select("id", "url", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")).alias("title"))


def unread_pages(elements: DataFrame, listed: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, unread): how many further pages a page's list has, where the list read so far holds no more than this page shows.

    The last page is the largest page= of links back to the page, or number on a button or link beside the list: one of the
    four elements around it holds at least half of the page's listed links. Fewer than three pages are none.
    """
    pressed = F.col("tag").isin("a", "button") & F.trim("text").rlike(r"^\d{1,4}$")
    elements = stored(elements.select("id", "n", "stop", "tag", "address", F.when(pressed, F.trim("text").cast("int")).alias("number"), F.when(pressed, F.col("around")).alias("around")))  # pages are parsed once
    links = elements.filter("tag = 'a' and address is not null").select("id", "n", F.regexp_replace("address", "#.*$", "").alias("url"), "address")
    own = listed.select("id", "url").distinct()
    chapters = links.join(own, ["id", "url"], "left_semi").select("id", "n", F.lit(1).alias("hit"))
    total = chapters.groupBy("id").agg(F.count("*").alias("links"))
    path = lambda c: F.regexp_replace(F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), "/+$", "")
    here = links.join(pages.select("id", path(F.col("url")).alias("path")), "id").filter(path(F.col("address")) == F.col("path"))
    number = F.coalesce(F.try_parse_url("address", F.lit("QUERY"), F.lit("page")).try_cast("int"), F.lit(1))
    by_link = here.groupBy("id").agg(F.max(number).alias("last"))

    page = Window.partitionBy("id").orderBy("n").rowsBetween(*UPTO)
    counted = elements.select("id", "n", "stop").join(chapters, ["id", "n"], "left").withColumn("upto", F.sum(F.coalesce("hit", F.lit(0))).over(page))
    ends = counted.select(F.col("id").alias("_id"), F.col("n").alias("_n"), F.col("upto").alias("through"))
    boxes = counted.join(ends, (F.col("id") == F.col("_id")) & (F.col("stop") - 1 == F.col("_n"))).select("id", F.col("n").alias("box"), (F.col("through") - F.col("upto")).alias("inside"))
    buttons = elements.filter("number is not null").join(chapters.select("id", "n"), ["id", "n"], "left_anti")
    buttons = buttons.select("id", "number", F.explode("around").alias("box"))
    beside = buttons.join(boxes, ["id", "box"]).join(total, "id").filter(F.col("inside") >= F.greatest(F.lit(1.0), F.col("links") / 2))
    by_button = beside.groupBy("id").agg(F.max("number").alias("number"))

    shown = listed.join(links.select("id", "url").distinct(), ["id", "url"], "left_semi").groupBy("id").agg(F.count("*").alias("shown"))
    size = listed.groupBy("id").agg(F.count("*").alias("size"))
    x = pages.select("id").join(by_link, "id", "left").join(by_button, "id", "left").join(shown, "id", "left").join(size, "id", "left")
    last = F.greatest(F.coalesce("last", F.lit(1)), F.coalesce("number", F.lit(1)))
    ends_here = F.coalesce("size", F.lit(0)) <= F.coalesce("shown", F.lit(0))
    return x.select("id", F.when((last >= 3) & ends_here, last - 1).otherwise(0).alias("unread"))


def missed_pictures(elements: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, url): pictures like those a reader kept, in the same place on the page, that it left out. kept: id, pos, url.

    An image's addresses are those in any of its attributes, as pages that load late keep the real one elsewhere.
    """
    images = elements.filter(F.size("pictures") > 0).select("id", "place", F.explode("pictures").alias("url"))
    images = stored(images)  # pages are parsed once
    own = kept.select("id", "url").distinct()
    places = images.join(own, ["id", "url"], "left_semi").select("id", "place").distinct()
    once = kept.groupBy("id", "url").agg(F.min("pos").alias("pos"))
    near = images.join(places, ["id", "place"], "left_semi").withColumn("shape", address_shape(F.col("url"))).join(_common_shape(once), ["id", "shape"])
    return near.join(own, ["id", "url"], "left_anti").select("id", "url").distinct()


def page_scripts(elements: DataFrame, budget: int = 8000, longest: int = 4000, files: int = 20) -> DataFrame:
    """(id, scripts): the first ``files`` addresses of a page's script files, and the beginnings of its own scripts, a line each.

    Scripts of under 20 characters and data are left out. Each shows at most ``longest`` characters, all together at most
    ``budget``; the one that reaches it is cut and is the last. A page with neither says "(none)".
    """
    script = F.col("tag") == "script"
    told = elements.filter(script | (F.col("n") == 0)).select("id", "n", script.alias("script"), F.when(script, _attribute("src")).alias("src"), F.when(script, F.coalesce(_attribute("type"), F.lit(""))).alias("type"), F.when(script, F.coalesce("text", F.lit(""))).alias("text"))
    told = stored(told)  # pages are parsed once; each has an element 0
    x = told.filter("script").drop("script")
    given = x.filter("src <> ''").withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("n"))).filter(F.col("i") <= files)
    outer = given.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "src"))), lambda s: s["src"]), ", ").alias("files"))
    own = x.filter("src is null").filter((F.char_length("text") >= 20) & ~(F.col("text").rlike(r"^[{\[]") & F.contains("type", F.lit("json"))))
    size = F.least(F.char_length("text"), F.lit(longest))
    own = own.withColumn("room", budget - F.coalesce(F.sum(size).over(Window.partitionBy("id").orderBy("n").rowsBetween(*BEFORE)), F.lit(0))).filter("room > 0")
    part = F.substring("text", F.lit(1), F.least(size, F.col("room")).cast("int"))
    line = F.concat(F.lit("Inline script: "), part, F.when(F.char_length(part) < F.char_length("text"), " …").otherwise(""))
    inner = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))  # within the budget
    both = told.filter("n = 0").select("id").distinct().join(outer, "id", "left").join(inner, "id", "left")
    text = F.concat_ws("\n", F.concat(F.lit("External scripts: "), "files"), F.array_join(F.transform("lines", lambda s: s["line"]), "\n"))
    return both.select("id", F.when(text == "", "(none)").otherwise(text).alias("scripts"))


# An address in quotes that names a chapter, addresses of files, and how much is shown around one.
_CALL = r"(?i)[`\"']([^`\"'\s]*/[^`\"'\s]*(?:chuong|chapter)[^`\"'\s]*)[`\"']"
_FILE = r"(?i)\.(?:js|css|png|jpe?g|webp|svg|ico)\b|^/_next|^//"
_AHEAD, _BEHIND = 220, 260


def script_calls(scripts: DataFrame, budget: int = 5000) -> DataFrame:
    """(id, pos, i, literal, snippet): where a page's scripts name addresses of chapters, with what stands around them.

    scripts: id, pos (their order on the page), code. Each address counts where it comes first; those of files don't. A
    snippet that would exceed the page's ``budget`` of characters ends its script; the next goes on with what is left.
    Places are found by cutting the code at them and adding lengths up; what is kept of a page depends on what was kept
    before, so its snippets are read in order as a stream that remembers addresses and a sum.
    """
    cut = F.arrays_zip(F.split("code", _CALL, -1).alias("between"), F.regexp_extract_all("code", F.lit(_CALL), F.lit(0)).alias("whole"), F.regexp_extract_all("code", F.lit(_CALL), F.lit(1)).alias("literal"))
    each = scripts.select("id", "pos", "code", F.posexplode(cut).alias("i", "x")).select("id", "pos", "code", "i", "x.*").filter("whole is not null")
    length = F.char_length("between") + F.char_length("whole")
    upto = Window.partitionBy("id", "pos").orderBy("i")
    at = F.coalesce(F.sum(length).over(upto.rowsBetween(*BEFORE)), F.lit(0)) + F.char_length("between")  # from 0
    start = F.greatest(at - _AHEAD, F.lit(0))
    around = F.substring("code", (start + 1).cast("int"), (at + F.char_length("literal") + _BEHIND - start).cast("int"))
    named = each.withColumn("snippet", collapsed(around)).filter(~F.col("literal").rlike(_FILE)).select("id", "pos", "i", "literal", "snippet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, used, ended = None, set(), 0, None
        for batch in batches:
            keep = []
            for key, pos, literal, snippet in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if now is None or key != now[0]:
                    now, seen, used, ended = (key,), set(), 0, None
                fits = pos != ended and used < budget and literal not in seen
                if fits:
                    seen.add(literal)
                    if used + len(snippet) > budget:
                        fits, ended = False, pos
                    else:
                        used += len(snippet)
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)
    return named.repartition("id").sortWithinPartitions("id", "pos", "i").mapInArrow(run, kinds)
