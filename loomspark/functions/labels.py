"""Titles, labels and generated texts of works and chapters, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, hashtag, title_author, title_only

# The entities that chapter titles use.
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded_title(raw: Column) -> Column:
    """Numeric and six named references decoded once, white space collapsed; other references stay.

    The text is cut at its references, so what one of them decodes to is not decoded again.
    """
    parts = F.split(F.regexp_replace(raw, r"(?i)(&(?:#x[0-9a-f]+|#\d+|[a-z]+);)", "\u0001$1\u0001"), "\u0001")
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(p):
        code = F.regexp_extract(p, r"(?i)^&(#x[0-9a-f]+|#\d+|[a-z]+);$", 1)
        number = F.when(code.rlike("(?i)^#x"), F.conv(F.substring(code, 3, 20), 16, 10)).otherwise(F.substring(code, 2, 20)).try_cast("int")
        point = F.when(code.startswith("#") & (number > 0) & (number <= 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(point, names[F.lower(code)], p)

    return collapsed(F.array_join(F.transform(parts, one), ""))


def feed_label(volume: Column, chapter: Column, title: Column) -> Column:
    """Vol. 1 Ch. 2 – Title; without numbers Oneshot."""
    some = lambda c, tag: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(tag), c))
    label = F.concat_ws(" ", some(volume, "Vol. "), some(chapter, "Ch. "))
    label = F.when(label == "", "Oneshot").otherwise(label)
    name = F.trim(F.coalesce(title, F.lit("")))
    return F.when(name != "", F.concat(label, F.lit(" – "), name)).otherwise(label)


def part_label(word: Column, part: Column, parts: Column, first: Column, last: Column) -> Column:
    """Word Phần 2 (Chương 5-9); a single part is not numbered."""
    reach = F.format_string("Chương %d-%d", first, last)
    return F.when(parts > 1, F.format_string("%s Phần %d (%s)", word, part, reach)).otherwise(F.format_string("%s (%s)", word, reach))


def story_tags(title: Column, author: Column) -> Column:
    """The work's hashtag and its author's, where there are any, each once."""
    who = F.coalesce(F.when(F.trim(author) != "", F.trim(author)), title_author(title), F.lit(""))
    tags = F.filter(F.array(hashtag(title_only(title)), hashtag(who)), lambda t: t != "")
    return F.transform(F.array_distinct(tags), lambda t: F.concat(F.lit("#"), t))


def intro(template: Column, default: str, channel: Column, title: Column, longest: int = 400) -> Column:
    """{channel} and {title} filled in, collapsed, cut."""
    text = F.when(F.trim(F.coalesce(template, F.lit(""))) != "", F.trim(template)).otherwise(F.lit(default))
    text = F.replace(F.replace(text, F.lit("{channel}"), F.trim(channel)), F.lit("{title}"), title_only(title))
    return F.substring(collapsed(text), 1, longest)


def described(opening: Column, summary: Column, facts: list[tuple[str, Column]], call: Column, tags: Column) -> Column:
    """Opening, summary, known facts and a closing call with tags, as lines; what is missing leaves no line."""
    given = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c))
    lines = F.array_compact(F.array(*[F.concat(F.lit(f"{name}: "), given(c)) for name, c in facts]))
    parts = F.array(opening, given(summary), F.when(F.size(lines) > 0, F.array_join(lines, "\n")), call, F.array_join(tags, " "))
    return F.array_join(F.array_compact(parts), "\n\n")


def page_title(page_heading: Column, blocks: Column, raw_title: Column, guess: Column) -> Column:
    """The page's heading, else a heading among the first three blocks, else <title>, else the guess, else Untitled."""
    heads = F.filter(F.slice(blocks, 1, 3), lambda b: b["type"] == "heading")
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(some(page_heading), some(F.get(heads, F.lit(0))["text"]), some(raw_title), some(guess), F.lit("Untitled"))


def without_leading_heading(blocks: Column) -> Column:
    """Blocks without the first heading among the first three."""
    kinds = F.transform(F.slice(blocks, 1, 3), lambda b: b["type"])
    at = F.array_position(kinds, "heading").cast("int")
    return F.when(at > 0, F.concat(F.slice(blocks, F.lit(1), at - 1), F.slice(blocks, at + 1, F.greatest(F.size(blocks) - at, F.lit(0))))).otherwise(blocks)
