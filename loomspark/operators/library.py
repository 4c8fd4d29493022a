"""Operators over works and their chapters: summaries, reconciliation, keyed merges, publishing state.

All take and return DataFrames with explicit columns. Joins are equi-joins on keys, so Catalyst chooses broadcast or
sort-merge by size and AQE splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def summaries(stories: DataFrame, chapters: DataFrame) -> DataFrame:
    """Each story with its numbers of chapters, done and failed ones; stories without chapters have zeros.

    Chapters are counted before the join, so the join moves a row for each story.
    """
    counts = chapters.groupBy("story_id").agg(
        F.count("order").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "error").alias("errors")
    )
    joined = stories.join(counts, "story_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "done", "errors")})


def with_status(rows: DataFrame, running: Column | None = None) -> DataFrame:
    """Adds remaining and state: running, else new, pending, error or done, in this order."""
    left = F.col("total") - F.col("done") - F.col("errors")
    state = F.when(F.coalesce(running, F.lit(False)), "running") if running is not None else F.when(F.lit(False), "running")
    state = state.when(F.col("new_chapters") > 0, "new").when(left > 0, "pending").when(F.col("errors") > 0, "error").otherwise("done")
    return rows.withColumn("remaining", left).withColumn("state", state)


def merge_toc(toc: DataFrame, stored: DataFrame) -> DataFrame:
    """A refreshed chapter list over what is stored.

    toc: (story_id, pos, url, title); stored: (story_id, order, url, title, status). Chapters are numbered by their
    place in the list. A stored chapter that is not pending keeps its status and, where the list has no title, its
    title. Of stored rows with one URL the last counts. Stored chapters that the list doesn't have are left out.
    """
    last = stored.groupBy("story_id", "url").agg(F.max_by(F.struct("title", "status"), "order").alias("old"))
    merged = toc.join(last, ["story_id", "url"], "left")
    kept = F.col("old.status").isNotNull() & (F.col("old.status") != "pending")
    return merged.select(
        "story_id",
        F.col("pos").cast("long").alias("order"),
        "url",
        F.coalesce("title", F.when(kept, F.col("old.title"))).alias("title"),
        F.when(kept, F.col("old.status")).otherwise("pending").alias("status"),
    )


def new_chapter_counts(toc: DataFrame, stored: DataFrame) -> DataFrame:
    """How many of the list's URLs are not stored; a URL that is listed twice counts twice."""
    return toc.join(stored.select("story_id", "url").distinct(), ["story_id", "url"], "left_anti").groupBy("story_id").agg(F.count("*").alias("new_chapters"))


def to_crawl(chapters: DataFrame, orders: Sequence[int] | None = None) -> DataFrame:
    """The asked chapters, done ones too, or all that are not done; an empty list is no list."""
    return chapters.filter(F.col("order").isin(list(orders))) if orders else chapters.filter(F.col("status") != "done")


def live_counts(chapters: DataFrame, live: DataFrame) -> DataFrame:
    """Of pending chapters with a live state (by URL), how many are in each."""
    now = chapters.filter(F.col("status") == "pending").join(live, "url")
    return now.groupBy("story_id").agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "error").alias("failed"), F.count("*").alias("live"))


def counters(chapters: DataFrame, live: DataFrame) -> DataFrame:
    """(story_id, done, error, pending, remaining): chapters by state, where pending ones that a run has ended count as it
    ended them; remaining are those not done."""
    stored = chapters.groupBy("story_id").agg(F.count_if(F.col("status") == "done").alias("_done"), F.count_if(F.col("status") == "error").alias("_error"), F.count("*").alias("_all"))
    now = live_counts(chapters, live).withColumnsRenamed({"done": "_now", "failed": "_failed"})
    both = stored.join(now, "story_id", "left").na.fill(0, ["_now", "_failed"])
    done, error = F.col("_done") + F.col("_now"), F.col("_error") + F.col("_failed")
    return both.select("story_id", done.alias("done"), error.alias("error"), (F.col("_all") - done - error).alias("pending"), (F.col("_all") - done).alias("remaining"))


def owned_bytes(owners: DataFrame, files: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """(keys, files, bytes) of every owner; one without files has none, and files without an owner don't count."""
    held = files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return owners.select(*keys).distinct().join(held, list(keys), "left").na.fill(0, ["files", "bytes"])


def ready_to_post(rendered: DataFrame, posted: DataFrame, keys: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Rows in one of the states that are not posted yet."""
    return rendered.filter(F.col("status").isin(list(states))).join(posted, list(keys), "left_anti")


def publishing_state(chapters: DataFrame, audio: DataFrame, videos: DataFrame) -> DataFrame:
    """Done chapters with their audio and video; audio_changed only where both hashes are known and differ."""
    done = chapters.filter(F.col("status") == "done").select("story_id", "order")
    joined = done.join(audio.select("story_id", "order", "audio_hash"), ["story_id", "order"], "left")
    joined = joined.join(videos.select("story_id", "order", "video_hash", "video_status"), ["story_id", "order"], "left")
    changed = F.col("audio_hash").isNotNull() & F.col("video_hash").isNotNull() & (F.col("audio_hash") != F.col("video_hash"))
    return joined.withColumn("has_audio", F.col("audio_hash").isNotNull()).withColumn("audio_changed", changed)


def filled(local: DataFrame, remote: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str | None = None) -> DataFrame:
    """Local rows with missing fields taken from the remote side; filled says whether any was. With ``seq`` the last of remote rows with one key counts."""
    remote = latest(remote, keys, seq) if seq else remote
    far = remote.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    joined = local.join(far, list(keys), "left")
    any_ = F.lit(False)
    for c in fields:
        any_ = any_ | (F.col(c).isNull() & F.col(f"_{c}").isNotNull())
    joined = joined.withColumn("filled", any_).withColumns({c: F.coalesce(c, f"_{c}") for c in fields})
    return joined.drop(*[f"_{c}" for c in fields])


def rewrite_plan(chapters: DataFrame, rewritten: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Done chapters to rewrite: the asked ones, else those not rewritten yet."""
    done = chapters.filter(F.col("status") == "done").select("story_id", "order")
    return done.join(orders.distinct(), ["story_id", "order"], "left_semi") if orders is not None else done.join(rewritten, ["story_id", "order"], "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Of rows with one key the last by ``seq``."""
    last = F.max_by(F.struct(*[F.col(c) for c in rows.columns]), seq).alias("_row")
    return rows.groupBy(*keys).agg(last).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), seq: str | None = None, fixed: Sequence[str] = ()) -> DataFrame:
    """Keyed merge: rows of ``new`` replace those of ``old`` but for the ``keep`` columns, which stay where set, and the
    ``fixed`` ones, which stay as they are in any case.

    Keys of ``new`` are unique, or ``seq`` names the column by which the last of several rows wins.
    """
    new = latest(new, keys, seq) if seq else new
    left = old.join(new.select(*keys), list(keys), "left_anti")
    kept = old.select(*keys, F.lit(True).alias("_stored"), *[F.col(c).alias(f"_{c}") for c in (*keep, *fixed)])
    put = new.join(kept, list(keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep})
    put = put.withColumns({c: F.when(F.col("_stored"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fixed})
    return left.unionByName(put.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Insert only: what is stored stays, and of new rows with one key the first by ``seq`` is put in."""
    first = Window.partitionBy(*keys).orderBy(seq)
    fresh = new.join(old.select(*keys), list(keys), "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return old.unionByName(fresh.select(*old.columns))


def replace_all(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every row of a key that ``new`` has is replaced by the rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def patched(old: DataFrame, patch: DataFrame, keys: Sequence[str], fields: Sequence[str], seq: str | None = None) -> DataFrame:
    """Sparse update: patch has, for a field, set_<field> (else it is kept) and the value (null clears). With ``seq`` the last of patch rows with one key counts."""
    patch = latest(patch, keys, seq) if seq else patch
    far = patch.select(*keys, F.lit(True).alias("_hit"), *[F.col(f"set_{c}") for c in fields], *[F.col(c).alias(f"_{c}") for c in fields])
    joined = old.join(far, list(keys), "left")
    put = {c: F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(put).select(*old.columns)


def guarded(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Crawl results over stored chapters: a failure doesn't replace a done chapter. With ``seq`` the last of new rows with one key counts."""
    new = latest(new, keys, seq) if seq else new
    far = new.select(*keys, F.col("status").alias("_status"))
    joined = old.join(far, list(keys), "left")
    keep = F.col("_status").isNull() | ((F.col("status") == "done") & (F.col("_status") == "error"))
    return joined.withColumn("status", F.when(keep, F.col("status")).otherwise(F.col("_status"))).drop("_status")


def without(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete by key; apply to each child table to cascade."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def suffix_matches(left: DataFrame, host: str, rules: DataFrame, domain: str) -> DataFrame:
    """Rows joined to the domains that equal their host or that their host is below.

    The host is exploded into what follows each of its dots, so the join is an equi-join and not a nested loop.
    """
    labels = F.split(F.col(host), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return left.withColumn("_end", F.explode(ends)).join(rules.withColumnRenamed(domain, "_end"), "_end").withColumnRenamed("_end", domain)


def merged_list(saved: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str], pos: str) -> DataFrame:
    """Full outer keyed merge: incoming values replace saved ones in place, new keys are appended in their order."""
    a = saved.select(*keys, F.col(pos).alias("_sp"), *[F.col(v).alias(f"_s_{v}") for v in values])
    b = incoming.select(*keys, F.col(pos).alias("_ip"), *[F.col(v).alias(f"_i_{v}") for v in values])
    out = a.join(b, list(keys), "full")
    put = {v: F.when(F.col("_ip").isNotNull(), F.col(f"_i_{v}")).otherwise(F.col(f"_s_{v}")) for v in values}
    out = out.withColumns(put).withColumn("appended", F.col("_sp").isNull()).withColumn(pos, F.coalesce("_sp", "_ip"))
    return out.select(*keys, *values, "appended", pos)


def narration_states(chapters: DataFrame, audio: DataFrame) -> DataFrame:
    """Done chapters, ready where they have audio, else missing."""
    done = chapters.filter(F.col("status") == "done").select("story_id", "order")
    have = audio.select("story_id", "order").distinct().withColumn("_have", F.lit(True))
    return done.join(have, ["story_id", "order"], "left").select("story_id", "order", F.when(F.col("_have"), "ready").otherwise("missing").alias("audio"))


def publish_plan(requested: DataFrame, chapters: DataFrame, audio: DataFrame, videos: DataFrame) -> DataFrame:
    """For each requested chapter: skip if uploaded, fail if not done or without audio, else prepare, keeping its former title."""
    c = chapters.select("story_id", "order", "status", F.col("title").alias("chapter_title"))
    a = audio.select("story_id", "order", F.lit(True).alias("_audio"))
    v = videos.select("story_id", "order", "video_status", F.col("video_title").alias("former"))
    joined = requested
    for side in (c, a, v):
        joined = joined.join(side, ["story_id", "order"], "left")
    act = F.when(F.col("video_status") == "uploaded", "skip").when(~F.coalesce(F.col("status") == "done", F.lit(False)) | F.col("_audio").isNull(), "fail").otherwise("prepare")
    return joined.select("story_id", "order", act.alias("action"), F.coalesce("former", "chapter_title").alias("video_title"))


def first_named(items: DataFrame, wanted: DataFrame, name: str, pos: str) -> DataFrame:
    """For each wanted name the first item (by ``pos``) with just that name; names without one are left out."""
    first = items.groupBy(name).agg(F.min_by(F.struct(*[F.col(c) for c in items.columns]), pos).alias("_row"))
    return wanted.select(name).distinct().join(first, name).select("_row.*")


def playlist_matches(items: DataFrame, chapters: DataFrame, records: DataFrame) -> DataFrame:
    """(story_id, order, video_id, title): the first list item of each done chapter.

    items: (story_id, pos, order, title, video_id), order being the number in the title. Items without a video, and those
    of chapters whose record points at another video, are passed over.
    """
    done = chapters.filter(F.col("status") == "done").select("story_id", "order").distinct()
    known = records.select("story_id", "order", F.col("video_id").alias("_known"))
    open_ = items.filter("video_id is not null and order is not null").join(done, ["story_id", "order"], "left_semi").join(known, ["story_id", "order"], "left")
    open_ = open_.filter(F.col("_known").isNull() | (F.col("_known") == F.col("video_id")))
    return open_.groupBy("story_id", "order").agg(F.min_by(F.struct("video_id", "title"), "pos").alias("m")).select("story_id", "order", "m.video_id", "m.title")


def extracted_chapters(chapters: DataFrame) -> DataFrame:
    """(source_url, title, blocks, error, error_kind): failed chapters have no blocks and a message, others no error."""
    failed = F.col("status") == "error"
    none = F.array().cast(chapters.schema["blocks"].dataType)
    return chapters.select(
        F.col("url").alias("source_url"),
        "title",
        F.when(failed, none).otherwise(F.coalesce("blocks", none)).alias("blocks"),
        F.when(failed, F.coalesce(F.when(F.col("error") != "", F.col("error")), F.lit("Unknown error"))).alias("error"),
        F.when(failed, F.col("error_kind")).alias("error_kind"),
    )


def camel_record(df: DataFrame, out: str = "record") -> DataFrame:
    """Rows as JSON records with camel-case names; null fields are left out."""
    camel = lambda c: "".join(w if i == 0 else w.capitalize() for i, w in enumerate(c.split("_")))
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias(out))


def retry_states(attempts: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column, limit: int) -> DataFrame:
    """(keys, attempts, state) of a retry loop: it ends with the first success (done) or at ``limit`` failures (failed)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    tried = tried.withColumn("_done", F.coalesce(F.max("_ok").over(w), F.lit(False))).withColumn("_failed", F.count_if(~F.col("_ok")).over(w))
    used = tried.filter(~F.col("_done") & (F.col("_failed") < limit)).groupBy(*keys).agg(F.count("*").alias("attempts"), F.max("_ok").alias("_ok"))
    state = F.when(F.col("_ok"), "done").when(F.col("attempts") >= limit, "failed").otherwise("retrying")
    return used.select(*keys, "attempts", state.alias("state"))
