"""Every stage of the pipeline against brute force, and the whole of it."""

import collections
import hashlib

import corpus_pipeline as pipeline
from loomspark.llm import toxicity


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = pipeline.toxicity_stage(spark, docs, sf)
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i in every if score[i] < 0.3)
    assert one.columns == docs.columns

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    two = [r["doc_id"] for r in pipeline.neardup_stage(spark, docs.unionByName(docs.limit(5)), sf).collect()]
    sets = {i: shingles(t) for i, t in every.items()}
    root = {i: i for i in every}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(every)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(two) == sorted(i for i in ids if find(i) == i)

    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    three = {r["doc_id"] for r in pipeline.decontamination_stage(spark, docs, sf).collect()}
    copies = {i for i, t in every.items() if any(x in " ".join(t.split()) for x in items)}
    assert not three & copies and len(three) >= len(every) - len(copies) - 1

    four = collections.Counter(r["doc_id"] for r in pipeline.mixing_stage(spark, docs, sf).collect())
    assert set(four.values()) <= {1, 2} and set(four) <= set(every)


def test_the_whole_runs(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.columns == [*spark.read.parquet(f"{sf}/documents.parquet").columns, "shard"]
    assert all(0 <= r["shard"] < 24 for r in got.collect())


def test_an_id_with_several_texts_keeps_a_defined_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(1, f"text number {i} of an id that has several " + "word " * i, "en", f"s{i}", i) for i in range(6)] + [(1, "text number 3 of an id that has several " + "word " * 3, "de", "other", 3), (2, "another document with words of its own", "en", "s", 1), (None, "x y z", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns)
    runs = [sorted(map(str, pipeline.neardup_stage(spark, df.repartition(n), sf).collect())) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 3
    kept = pipeline.neardup_stage(spark, df, sf).filter("doc_id = 1").first()["text"]
    assert kept == min((r[1] for r in rows if r[0] == 1), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
