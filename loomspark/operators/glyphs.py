"""Letters of glyphs whose text is wrong: by twins with the same outline, else by votes of the words around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import shared_folder

# The letters that a font may have lost, and how much evidence decides.
LETTERS = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
LEAST_PATTERNS, LEAST_USES = 3, 5

#: Words of up to so many letters are looked up by what stands around each letter, longer ones by each letter that a hole may be.
_FEW_LETTERS = 64


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_to_one(scores: DataFrame, keys: Sequence[str] = ("doc",), least: float = 0.0) -> DataFrame:
    """Greedy one-to-one matching of (keys, left, right, score) over ``least``: best score first, ties by left, then right.

    In rounds: a pair that is the best of its left and of its right would be taken before anything that touches it, so all
    such pairs are taken at once and whatever touches them goes. Every round takes at least the best pair that is left; each
    is stored, so no lineage grows. Repeated pairs count once, with their best score; null scores don't.
    """
    names = [*keys, "left", "right"]
    open_ = _stored(scores.filter(F.col("score") > least).groupBy(*names).agg(F.max("score").alias("score")))
    rank = F.struct((-F.col("score")).alias("s"), "left", "right")
    by_left, by_right = Window.partitionBy(*keys, "left"), Window.partitionBy(*keys, "right")
    taken: list[DataFrame] = []
    while open_.take(1):
        x = open_.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(by_left))
        x = x.withColumn("_taken", (F.col("_best") == F.col("_rank")) & (F.min("_rank").over(by_right) == F.col("_rank")))
        x = x.withColumn("_gone", F.max("_taken").over(by_right)).withColumn("_gone", F.col("_gone") | F.max("_taken").over(by_left))
        done = _stored(x.select(*names, "score", "_taken", "_gone"))
        taken.append(done.filter("_taken").select(*names, "score"))
        open_ = done.filter("not _gone").select(*names, "score")
    out = open_.select(*names, "score")
    for t in taken:
        out = out.unionByName(t)
    return out


def _tried(patterns: DataFrame, free: DataFrame, words: DataFrame, key: Sequence[str]) -> DataFrame:
    """Patterns with each free letter that makes a word of them, and how often that is found.

    A word of few letters is cut open at each that may be free in its document, and meets the patterns by what is left; so
    rows grow with words and patterns, not with patterns times letters. Only long patterns are filled with each letter, as
    the pieces of a long word are as many as its letters and as long.
    """
    size = F.length("head") + F.length("tail") + 1
    at = F.explode(F.sequence(F.lit(1), F.length("word")))
    cut = words.filter(F.length("word").between(1, _FEW_LETTERS)).select("*", at.alias("at")).withColumn("candidate", F.substring("word", F.col("at"), F.lit(1)))
    cut = cut.join(free.select("doc", "candidate").distinct(), ["doc", "candidate"], "left_semi")
    cut = cut.select("doc", "candidate", "found", F.substring("word", F.lit(1), F.col("at") - 1).alias("head"), F.substring("word", F.col("at") + 1, F.length("word")).alias("tail"))
    few = patterns.filter(size <= _FEW_LETTERS).join(cut, ["doc", "head", "tail"]).join(free, [*key, "candidate"])
    filled = patterns.filter(size > _FEW_LETTERS).join(free, key).withColumn("word", F.concat("head", "candidate", "tail"))
    many = filled.join(words.filter(F.length("word") > _FEW_LETTERS), ["doc", "word"]).drop("word")
    return few.unionByName(many)


def glyph_letters(glyphs: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(doc, font, code, letter): what broken glyphs stand for. glyphs: doc, page, offset, font, family, code, unicode, outline.

    A glyph with an outline whose text is no letter is broken. If its outline is that of glyphs with a letter, it is the
    letter that most of them have (of equals the first seen). If its text is a blank and it has no twin, it may be any of
    ``letters`` that its family draws nowhere: each different word with it votes for the letters that make a word of the
    document, by how common these are; letters with words enough compete one to one within the family, the best first. The
    last letter that a family has left goes to a glyph that stands only inside words, the first seen of these.
    Glyphs without an outline are read as they are. Where pages (doc, page) are dealt over tasks already, they stay there.
    """
    place = F.struct("page", "offset")
    known = glyphs.withColumn("is_letter", F.col("unicode").rlike(r"^\p{L}$")).withColumn("drawn", F.col("outline").isNotNull())
    good = known.filter("drawn and is_letter")
    shapes = _stored(good.groupBy("doc", "family", "outline", "unicode").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    twins = shapes.groupBy("doc", "outline", "unicode").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    order = Window.partitionBy("doc", "outline").orderBy(F.desc("n"), "at")
    twins = twins.withColumn("r", F.row_number().over(order)).filter("r = 1").select("doc", "outline", F.col("unicode").alias("twin"))
    key = ["doc", "font", "code"]
    broken = known.filter("drawn and not is_letter").join(twins, ["doc", "outline"], "left")
    state = broken.groupBy(*key).agg(
        F.max_by("twin", F.when(F.col("twin").isNotNull(), place)).alias("letter"),
        F.max(F.col("twin").isNull() & (F.col("unicode") == " ")).alias("lost"),
        F.max_by("family", place).alias("family"),
        F.min(place).alias("first"),
    )
    state = _stored(state.withColumn("lost", F.col("lost") & F.col("letter").isNull()))
    lost = state.filter("lost")

    # what stands between characters that are no letters; a lost glyph is a hole between two such stretches
    read = known.join(state.select(*key, "letter", "lost"), key, "left")
    own = F.when(F.col("drawn") & ~F.col("is_letter"), F.coalesce("letter", "unicode")).otherwise(F.col("unicode"))
    hole = F.coalesce(F.col("drawn") & ~F.col("is_letter") & F.col("lost"), F.lit(False))
    read = read.select("doc", "page", "offset", F.lower(own).alias("c"), hole.alias("hole"), F.when(hole, F.struct("font", "code")).alias("glyph"))
    read = read.withColumn("inside", ~F.col("hole") & F.col("c").rlike(r"^\p{L}+$"))
    upto = Window.partitionBy("doc", "page").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = read.withColumn("n", F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(upto))
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("offset", "c")))), lambda x: x["c"]), "")  # the letters of one word
    stretch = read.groupBy("doc", "page", "n").agg(spelt.alias("word"), F.max("hole").alias("hole"), F.max("glyph").alias("glyph"))
    w = Window.partitionBy("doc", "page").orderBy("n")
    stretch = stretch.withColumn("before", F.coalesce(F.lag("word").over(w), F.lit(""))).withColumn("next_hole", F.coalesce(F.lead("hole").over(w), F.lit(False)))
    told = stretch.filter("hole or not next_hole and word <> ''").withColumn("head", F.when(F.col("hole"), F.col("before")))
    counted = _stored(told.groupBy("doc", "hole", "glyph", "head", "word").agg(F.count("*").alias("uses")))
    words = counted.filter("not hole").select("doc", "word", F.col("uses").alias("found"))
    patterns = counted.filter("hole").select("doc", "glyph.font", "glyph.code", "head", F.col("word").alias("tail"), "uses")

    drawn = shapes.select("doc", "family", F.lower("unicode").alias("candidate")).distinct()
    free = _stored(lost.select(*key, "family", "first", F.explode(F.array(*[F.lit(c) for c in letters])).alias("candidate")).join(drawn, ["doc", "family", "candidate"], "left_anti"))
    tried = _tried(patterns, free, words, key)
    share = F.col("found") / F.sum("found").over(Window.partitionBy(*key, "head", "tail"))
    votes = tried.withColumn("vote", share).groupBy(*key, "family", "candidate").agg(F.sum("vote").alias("score"), F.count("*").alias("types"))
    scores = votes.filter(F.col("types") >= LEAST_PATTERNS).select("doc", "family", F.struct("font", "code").alias("left"), F.col("candidate").alias("right"), "score")
    voted = one_to_one(scores, ["doc", "family"]).select("doc", "left.font", "left.code", "family", F.col("right").alias("letter"))

    rest = free.join(voted.select("doc", "family", F.col("letter").alias("candidate")), ["doc", "family", "candidate"], "left_anti")
    rest = rest.join(voted.select(*key), key, "left_anti").groupBy(*key, "family", "first").agg(F.count("*").alias("n"), F.min("candidate").alias("letter")).filter("n = 1")
    inside = patterns.groupBy(*key).agg(F.min((F.col("head") != "") & (F.col("tail") != "")).alias("inside"), F.sum("uses").alias("uses")).filter(F.col("inside") & (F.col("uses") >= LEAST_USES))
    once = Window.partitionBy("doc", "family", "letter").orderBy("first")
    left = rest.join(inside, key).withColumn("r", F.row_number().over(once)).filter("r = 1")
    by_twin = state.filter("letter is not null").select(*key, "letter")
    return by_twin.unionByName(voted.select(*key, "letter")).unionByName(left.select(*key, "letter"))


def glyph_fixes(glyphs: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(doc, page, offset, letter) of every broken glyph whose letter `glyph_letters` finds."""
    broken = glyphs.filter(F.col("outline").isNotNull() & ~F.col("unicode").rlike(r"^\p{L}$"))
    return broken.join(_stored(glyph_letters(glyphs, letters)), ["doc", "font", "code"]).select("doc", "page", "offset", "letter")
