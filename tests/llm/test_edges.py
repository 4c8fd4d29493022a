"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import chat, decontamination, language_model, mixing, neardup, neighbours, sharding, toxicity, urls, webtext

#: Names that the operators use inside.
CLASHES = (
    "id item rep node tokens component component_id n_shingles one two kept code n c shard slot grown_shard size source_size target taken sid bucket"
    " spot start first block pass nth ahead held score evidence label term hits rank v ids leaves visits url html host path rule mined confidence"
    " verdict _url _s _b _bucket _before _copies _mixed_id _source tokens_ mark train window item_words speaker part rendered masks turns a b u m salt"
).split()
LONG = "word " * 60_000 + "end"
TEXTS = [None, "", " \t\n", "one", LONG, "the same text of seven words here", "the same text of seven words here", "Ünïcödé 漢字 😀 text with some words in it"]


def _clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c.lower() not in {x.lower() for x in df.columns}})


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i else None, t, None if i % 3 == 0 else "en", [None, "web", "books"][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return _clashing(spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, source string, n_chars long")).coalesce(2)


@pytest.fixture(scope="module")
def labels(spark):
    return _clashing(spark.createDataFrame([(1, 1, 0), (3, None, None), (4, 0, 1), (None, 1, 1), (7, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return _clashing(spark.createDataFrame([(1, "the same text of seven words here"), (2, None), (None, ""), (3, "one"), (3, "one")], "item_id long, text string"))


@pytest.fixture(scope="module")
def folder(documents, labels, benchmark, tmp_path_factory):
    at = tmp_path_factory.mktemp("edges")
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{at}/{name}.parquet")
        df.limit(0).write.parquet(f"{at}/none/{name}.parquet")
    return str(at)


def _both(operator, df):
    """The operator's rows over the table, after it has also run over no rows with the same schema."""
    whole, none = operator(df), operator(df.limit(0))
    assert none.columns == whole.columns and none.collect() == []
    return whole.collect()


def test_sharding(documents):
    rows = _both(lambda d: sharding.with_slots(sharding.with_shards(d), order=("doc_id", "text")), documents)
    assert len(rows) == 9 and {r["_s"] for r in rows} == {"clash _s"} and {r["_b"] for r in rows} == {"clash _b"}
    for shard in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_katz(documents):
    rows = _both(lambda d: language_model.katz(d, F.col("lang").isNotNull()), documents)
    assert len(rows) == 9 and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows)[:3] == [1, 1, 1] and max(r["n_tokens"] for r in rows) == 60_002


def test_main_text(spark):
    pages = [(1, None, None), (None, "u", ""), (2, "u", "<p>"), (3, "u", "<article>" + "<p>Some sentence of the article, which is long enough.</p>" * 3_000), (3, "u", "</div></p>&amp;&#0;<a"), (4, "u", "<div " * 2_000)]
    rows = _both(lambda d: webtext.extracted(d).drop("blocks"), _clashing(spark.createDataFrame(pages, "page_id long, url string, html string")))
    assert len(rows) == 6 and [r["text"] for r in rows if r["page_id"] in (None, 1, 2)] == ["", "", ""]
    assert max(r["text"].count("\n\n") for r in rows) == 2_999 and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_neighbours(spark):
    bad = [(i, v) for i, v in enumerate([None, [0.0, 0.0], [float("nan"), 1.0], [1.0, float("inf")], [1.0, None], [1.0]], 100)]
    good = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.5, 1.0]), (None, [1.0, 1.0])]
    rows = _both(neighbours.nearest, _clashing(spark.createDataFrame(bad + good, "vec_id long, embedding array<double>")))
    found = {q: [(r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert found == {0: [(2, 1.0), (3, 1.0), (20, 1.0), (5, 0.5)], 20: [(0, 1.0), (2, 1.0), (3, 1.0), (5, 0.5)]}


def test_toxicity(documents, labels):
    rows = _both(lambda d: toxicity.toxicity(d, labels), documents)
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.toxicity(documents, labels.limit(0)).collect()} == {0.05}


def test_decontamination(documents, benchmark):
    rows = _both(lambda d: decontamination.contaminated(d, benchmark), documents)
    assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["item_id"] == 1) == [(5, 1), (6, 1)]
    assert decontamination.contaminated(documents, benchmark.limit(0)).collect() == []


def test_chat(spark):
    turns = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, None, None, None), (1, 1, "bob", ""), (None, 2, "eve", LONG), (2, 0, "system", "x")]
    rows = _both(chat.rotate, _clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    assert sorted((r["conv_id"] or 0, r["speaker"], r["n_turns"], r["n_own"]) for r in rows) == [(0, "eve", 1, 1), (1, "ann", 4, 2), (1, "bob", 4, 1), (1, "unknown", 4, 1)]


def test_near_duplicates(documents):
    rows = _both(neardup.near_duplicates, documents)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [
        *[(i, i, True) for i in range(6)], (6, 5, False), (7, 7, True), (7, 7, True)
    ]


def test_urls(spark):
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "http://X.example.NET/en/a?b#c"), (4, "http://X.example.NET/en/a?b#c"), (None, "http://a.org" + "/x" * 20_000), (5, "://")]
    df = _clashing(spark.createDataFrame(pages, "page_id long, url string"))
    marks = spark.createDataFrame([("http://a.org/x", True), ("http://b.org/y", None), (None, False)], "url string, blocked boolean")
    rows = _both(lambda d: urls.judged(d, urls.RULES, marks), df)
    assert len(rows) == 7 and [r["rule"] for r in rows if r["page_id"] == 4] == ["example.net/en/"] * 2
    assert {r["verdict"] for r in rows} == {"allow"}


def test_mixing(documents):
    rows = _both(mixing.mix_sources, documents)
    assert len(rows) == 9 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix_sources(documents.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, folder, stage):
    name, f = corpus_pipeline.STAGES[stage]
    for at in (folder, f"{folder}/none"):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        out = f(spark, docs, at)
        assert out.columns == docs.columns, name  # the column of shards replaces one of its name
        rows = out.collect()
        assert at == folder or rows == []
        if at == folder and name in ("toxicity", "near-duplicates", "decontamination"):
            assert {r["text"] for r in rows} >= {None, "", LONG}
