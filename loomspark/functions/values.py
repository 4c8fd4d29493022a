"""URL, hash, number and time functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def story_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def valid_id(value: Column) -> Column:
    return value.rlike("^[0-9a-f]{16}$")


def normalized_story_url(url: Column) -> Column:
    """Without query and fragment, without a last chapter segment (of two or more), with one slash at the end."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    chapter = (F.size(parts) >= 2) & F.element_at(parts, -1).rlike("(?i)^chuong-")
    kept = F.when(chapter, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    tail = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise("")
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit("/"), tail)


def address_shape(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "\\d+", "#")


def host_name(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def safe_scheme(url: Column) -> Column:
    """http, https, mailto, an image as data, or no scheme; control characters and spaces don't count."""
    bare = F.lower(F.regexp_replace(url, "[\\x00-\\x20]", ""))
    return bare.rlike("^(https?:|mailto:|data:image/)") | ~bare.rlike("^[a-z][a-z0-9+.-]*:")


def private_address(host: Column) -> Column:
    """Private, loopback, link-local and carrier ranges of dotted IPv4 addresses, and the local IPv6 ones."""
    bare = F.regexp_replace(F.lower(host), "^\\[|\\]$|^\\[?::ffff:", "")
    four = F.transform(F.split(bare, "\\."), lambda x: x.try_cast("int"))
    is_four = bare.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$")
    a, b = F.get(four, F.lit(0)), F.get(four, F.lit(1))
    within = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.when(is_four, within).otherwise(bare.rlike("^(::1?$|f[cd]|fe[89ab])") & bare.contains(":"))


def retry_delay(attempt: Column, header: Column) -> Column:
    """Milliseconds: the server's seconds, 30 s at most, else 1 s doubled each time up to 30 s (jitter is added on use)."""
    asked = header.try_cast("double")
    return F.when(asked >= 0, F.least(asked * 1000, F.lit(30000.0))).otherwise(F.least(F.pow(F.lit(2.0), attempt - 1) * 1000, F.lit(30000.0)))


def crawl_delay(blanked: Column, attempt: Column) -> Column:
    return F.when(blanked, 300).otherwise(F.least(attempt * 1000, F.lit(3000)))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    s = F.floor(seconds)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(rest))).otherwise(F.concat_ws(":", m.cast("string"), two(rest)))


def eta_label(ms: Column) -> Column:
    minutes = F.floor(ms / 60000 + 0.5)
    h, rest = F.floor(minutes / 60), minutes % 60
    hours = F.when(rest == 0, F.concat(F.lit("~"), h.cast("string"), F.lit(" hr"))).otherwise(F.concat(F.lit("~"), h.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min")))
    return F.when(ms < 60000, "under 1 min").when(minutes < 60, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min"))).otherwise(hours)


def bytes_label(n: Column) -> Column:
    """B, KB, MB, GB, TB by thousands; one decimal below 100."""
    def at(unit: str, size: float):
        v = n / size
        return F.concat(F.when(v >= 100, F.floor(v + 0.5).cast("string")).otherwise(F.format_string("%.1f", v)), F.lit(f" {unit}"))

    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1e6, at("KB", 1e3)).when(n < 1e9, at("MB", 1e6)).when(n < 1e12, at("GB", 1e9)).otherwise(at("TB", 1e12))


def time_ago(minutes: Column) -> Column:
    """Labels up to a week; null beyond, where the date is shown."""
    m = F.floor(minutes)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return F.when(m < 1, "just now").when(m < 60, label(m, "min")).when(m < 1440, label(F.floor(m / 60), "hr")).when(m < 10080, label(F.floor(m / 1440), "days"))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by numeric segments; missing ones are 0."""
    seg = lambda c: F.transform(F.split(F.regexp_replace(c, "^v", ""), "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    sign = F.zip_with(seg(a), seg(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    return F.aggregate(sign, F.lit(0.0), lambda acc, s: F.when(acc != 0, acc).otherwise(s)).cast("int")


def importance(x: Column) -> Column:
    """Rounded into 1 to 5; null and NaN are 1."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.coalesce(F.nanvl(x, F.lit(1.0)), F.lit(1.0)) + 0.5)))


def image_kind(content: Column) -> Column:
    """By first bytes: jpg, png, gif, webp, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & head.endswith("57454250"), "webp")


def audio_kind(content: Column) -> Column:
    """By first bytes: wav, flac, ogg, m4a, mp3 (an ID3 tag or a frame's eleven set bits), else null; also of under 12 bytes."""
    head = F.hex(F.substring(content, 1, 12))
    kind = (
        F.when(head.startswith("52494646") & head.endswith("57415645"), "wav").when(head.startswith("664C6143"), "flac").when(head.startswith("4F676753"), "ogg")
        .when(F.substring(head, 9, 8) == "66747970", "m4a").when(head.startswith("494433") | head.rlike("^FF[EF]"), "mp3")
    )
    return F.when(F.octet_length(content) >= 12, kind)


def parts_key(parts: Column) -> Column:
    """The key under which what was made of these texts is kept: SHA-1 of the list as JSON. A list that is null has none."""
    return F.sha1(F.to_json(parts))


def storyboard_key(created: Column, cast_ids: Column, parts: Column) -> Column:
    """As `parts_key`, of a cast list's time of creation and ids, and the texts."""
    return F.sha1(F.concat(F.lit("["), F.to_json(F.array(created)).substr(F.lit(2), F.length(F.to_json(F.array(created))) - 2), F.lit(","), F.to_json(cast_ids), F.lit(","), F.to_json(parts), F.lit("]")))


def narratable(language: Column) -> Column:
    """Whether a work can be narrated: in Vietnamese, which is also what an unnamed language is."""
    return F.coalesce(F.nullif(language, F.lit("")), F.lit("vi")) == "vi"


# The longest part of a compilation in seconds, and on a platform that takes less.
PART_SECONDS, SHORT_PART_SECONDS = 11 * 3600, {"facebook": 4 * 3600 - 300}


def part_seconds(platform: Column) -> Column:
    """The longest part that a platform takes; of one that is not named, the usual."""
    out = F.lit(PART_SECONDS)
    for name, most in SHORT_PART_SECONDS.items():
        out = F.when(platform == name, most).otherwise(out)
    return out


def jwt_claims(token: Column, schema: str) -> Column:
    body = F.translate(F.element_at(F.split(token, "\\."), 2), "-_", "+/")
    return F.from_json(F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8"), schema)


def chunked(items: Column, n: int) -> Column:
    """An array as slices of ``n``, the last one shorter; an empty array has none."""
    last = F.ceil(F.size(items) / n).cast("int") - 1
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * n + 1, F.lit(n)))).when(items.isNotNull(), F.slice(F.array(items), 2, 1))


def capped_body(body: Column, declared: Column, most: int) -> Column:
    """A body of at most ``most`` bytes; null where it, or the length declared for it, is more. No body is an empty one."""
    size = F.coalesce(F.octet_length(body), F.lit(0))
    return F.when((F.coalesce(declared, F.lit(0)) <= most) & (size <= most), F.coalesce(body, F.lit("")))


def violated(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules]))


def publish_window(ahead_seconds: Column) -> Column:
    return ahead_seconds.between(600, 30 * 86400)


def outermost_json(text: Column, schema: str) -> Column:
    """The outermost object in free text, read by a fixed schema; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def canonical(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The one address of a work: the first rule (pattern, template with $1 to $9) whose pattern fits; else the url as it is."""
    out = None
    for pattern, template in rules:
        put = F.regexp_replace(F.regexp_extract(url, pattern, 0), pattern, template)
        out = F.when(url.rlike(pattern), put) if out is None else out.when(url.rlike(pattern), put)
    return url if out is None else out.otherwise(url)


def local_time(iso: Column, zone: str) -> Column:
    """The clock in ``zone`` at a time as written, with an offset, as UTC (Z, or a date alone), or else local; null if it is none."""
    written = iso.try_cast("timestamp_ntz")
    offset = F.regexp_extract(iso, r"[T ].*([+-]\d{2}:?\d{2})$", 1)
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, -2, 2).cast("int")
    ahead = F.when(offset == "", 0).when(F.substring(offset, 1, 1) == "-", -minutes).otherwise(minutes)
    instant = iso.rlike(r"Z$|^\d{4}-\d{2}-\d{2}$") | (offset != "")
    return F.when(instant, F.convert_timezone(F.lit("UTC"), F.lit(zone), written - F.make_dt_interval(mins=ahead))).otherwise(written)


def iso_with_offset(utc: Column, zone: str) -> Column:
    """A time in UTC, to the minute, as ``zone`` writes it, with its offset then."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    ahead = F.timestamp_diff("MINUTE", utc, local)
    hours = F.lpad(F.floor(F.abs(ahead) / 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:00"), F.when(ahead < 0, "-").otherwise("+"), hours, F.lit(":"), F.lpad((F.abs(ahead) % 60).cast("string"), 2, "0"))


def tomorrow(utc: Column, zone: str) -> Column:
    """The day after the day that it is in ``zone``."""
    return F.date_format(F.date_add(F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)), 1), "yyyy-MM-dd")


def local_input(iso: Column, zone: str) -> Column:
    """A written time as date and minute in ``zone``; empty where there is none."""
    return F.coalesce(F.date_format(local_time(iso, zone), "yyyy-MM-dd'T'HH:mm"), F.lit(""))


def publish_label(iso: Column, zone: str) -> Column:
    """A written time for reading, minute first; what can't be read as a time stays as it is."""
    return F.coalesce(F.date_format(local_time(iso, zone), "HH:mm dd/MM/yyyy"), iso, F.lit(""))
