"""Multi-party perspective rotation of dialogues, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import read

END = "<|end|>\n"


def _opened(name: Column, speaker: Column) -> Column:
    """The line that opens a turn, as the speaker sees it."""
    return (
        F.when(name == "system", F.lit("<|system|>\n"))
        .when(name == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )


def rotate(dialogues: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 64) -> DataFrame:
    """Every dialogue, rendered once for each participant with that speaker as the assistant.

    Returns conv_id, speaker, part, n_turns, n_own (the speaker's turns), start, rendered, and masks. A rendering is one
    text, however long the dialogue; it comes in parts of ``part_turns`` turns, numbered from 0, whose ``rendered`` laid
    end to end are the whole, so that no row grows with the dialogue. start is where the part begins in the whole, and
    masks are "start-end" pairs, comma-separated, in code points of the whole, end exclusive, of the spans that a loss is
    taken on: the speaker's own texts with their end marks and nothing else.

    "system" is no participant and is never masked in; a dialogue without other speakers gives no row. A null role is
    named "unknown", a null text is empty, a null turn number comes first. Turns are ordered by number, then name, then
    text; exact repetitions of a row are rendered again. Null conv_ids make one dialogue. "<|" inside a text or name
    becomes "< |", "|>" inside a name "| >", and a line break there a space, so that no text can open a turn. Other columns
    are not read.
    """
    mark = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    plain = lambda c: F.translate(F.replace(mark(c), F.lit("|>"), F.lit("| >")), "\r\n", "  ")
    turns = dialogues.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        plain(F.coalesce(F.col(f"`{role}`"), F.lit("unknown"))).alias("name"),
        mark(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    ).withColumn("stretch", F.floor(F.col("turn") / part_turns))
    # a turn's place: turns of earlier stretches of turn numbers are counted, those of its own are numbered
    counts = turns.groupBy("conv_id", "stretch").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    own = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "name", "text")
    placed = turns.withColumn("place", F.row_number().over(own) - 1)
    placed = placed.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("stretch").eqNullSafe(F.col("_stretch")))
    placed = placed.withColumn("place", F.col("place") + F.col("before")).withColumn("part", F.floor(F.col("place") / part_turns))
    # part_turns bounds a group: what is gathered is a part, never a whole dialogue
    parts = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "name", "text"))).alias("turns"))
    speakers = turns.filter(F.col("name") != "system").select(F.col("conv_id").alias("_conv"), F.col("name").alias("speaker")).distinct()
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    opened = F.transform("turns", lambda t: _opened(t["name"], F.col("speaker")))
    seen = seen.withColumn("heads", opened)
    length = F.zip_with("heads", "turns", lambda h, t: (F.char_length(h) + F.char_length(t["text"]) + len(END)).cast("long"))
    seen = seen.withColumn("lengths", length)
    sofar = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    seen = seen.withColumn("start", F.coalesce(F.sum(total).over(sofar), F.lit(0)))
    at = F.transform("turns", lambda _, i: F.aggregate(F.slice("lengths", F.lit(1), i), F.col("start"), lambda a, b: a + b))
    seen = seen.withColumn("starts", at)
    mine = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.get("turns", i)["name"] == F.col("speaker"))
    seen = seen.withColumn("own", mine)
    start = lambda i: F.get("starts", i) + F.char_length(F.get("heads", i))
    stop = lambda i: F.get("starts", i) + F.get("lengths", i)
    spans = F.transform("own", lambda i: F.concat_ws("-", start(i).cast("string"), stop(i).cast("string")))
    rendered = F.array_join(F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["text"], F.lit(END))), "")
    return seen.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("own").cast("long").alias("n_own"),
        "start",
        rendered.alias("rendered"),
        F.array_join(spans, ",").alias("masks"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side."""
    return rotate(read(spark, sf_dir, "conversations"))
