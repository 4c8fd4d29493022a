"""Each operator against brute force on small tables, and its defined results for nulls, empties, ties and repeats."""

import collections
import hashlib
import itertools
import math
import random
import re
import statistics
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import chat, decontamination, language_model, mixing, neardup, neighbours, sharding, toxicity, urls, webtext
from loomspark.llm.components import components
from loomspark.llm.textcodes import word_codes

DOC = "doc_id long, text string, source string, shard string, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], DOC)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# sharding


def test_shards_are_the_best_hash_and_grow_into_the_new_one_only(spark):
    df = docs(spark, [(i, "t", None) for i in range(300)] + [(None, None, None), (7, "t", None)])
    got = [(r["doc_id"], r["a"], r["b"]) for r in sharding.with_shards(sharding.with_shards(df, weights=[1.0] * 5, out="a"), weights=[1.0] * 6, out="b").collect()]
    draw = lambda k, s: int(hashlib.md5(f"{k}/{s}".encode()).hexdigest()[:13], 16)
    for doc_id, a, b in got:
        key = "" if doc_id is None else str(doc_id)
        assert a == max(range(5), key=lambda s: draw(key, s))
        assert b in (a, 5)
    weighted = collections.Counter(r["s"] for r in sharding.with_shards(df, weights=[3.0, 0.0, 1.0], out="s").collect())
    assert weighted[1] == 0 and weighted[0] > 2 * weighted[2]
    assert sharding.with_shards(df.limit(0)).count() == 0


def test_slots_have_no_gaps(spark):
    df = sharding.with_shards(docs(spark, [(i % 90, "t", None) for i in range(200)]), weights=[1.0] * 3)
    found = collections.defaultdict(list)
    for r in sharding.with_slots(df, buckets=8).collect():
        found[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in found.values())


def test_sharding_query(spark, sf):
    rows = sharding.op1_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 24)


# mixing


def test_targets_are_the_fixed_point_of_resharing(spark):
    rng = random.Random(5)
    sizes = {f"s{i:02d}": rng.choice([0, 3, 50, 400, 9000]) for i in range(12)} | {None: 77}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if level * weight[k] > 2 * sizes[k]]
        if not over:
            break
        for k in over:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
            open_.discard(k)
    want |= {k: level * weight[k] for k in open_}
    assert got == pytest.approx(want)


def test_small_sources_take_their_targets_beside_large_blocks(spark):
    rng = random.Random(11)
    df = docs(spark, [(i, words(rng, 50), "big") for i in range(400)] + [(1000 + i, words(rng, 7), f"s{i % 9}") for i in range(30)] + [(2000, None, "s1"), (2001, "one", None)])
    for block in (20_000, 1024, 1):
        got = mixing.mix_sources(df, block=block).collect()
        assert len(got) == 432
        total, target = collections.Counter(), {}
        for r in got:
            total[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(abs(total[k] - t) <= 0.5 for k, t in target.items())


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "c", None])) for i in range(150)] + [(3, None, "a"), (3, None, "a")]
    df = docs(spark, rows)
    one, two = ([tuple(r) for r in mixing.mix_sources(df).orderBy("doc_id", "size", "source").collect()] for _ in range(2))
    assert one == two and len(one) == len(rows)
    taken, target = collections.Counter(), {}
    for doc_id, source, size, source_size, goal, n, places in one:
        assert n == sum(p["words"] for p in places)
        assert 0 <= n <= 2 * size
        taken[source] += n
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def sequential_mix(rows, targets, block, step):
    """The mix as a list of (doc_id, word number), slot by slot; rows: (doc_id, source, size) in the order of their streams."""
    streams, whole = collections.defaultdict(list), {k: math.floor(t + 0.5) for k, t in targets.items()}
    for doc_id, source, size in rows:
        streams[source] += [(doc_id, w) for w in range(size)]
    streams = {k: (v * 2)[: whole[k]] for k, v in streams.items()}
    order = [*sorted(k for k in targets if k is not None), *([None] if None in targets else [])]
    goal = sum(targets.values())
    slots = math.ceil(goal / block)
    owners = []
    for i in range(slots):
        u, high = (i + 0.5) * step % 1, 0.0
        for k in order:
            high += targets[k] / goal
            if u < high and targets[k] > 0:
                break
        owners.append(k)
    last = {k: max((i for i, o in enumerate(owners) if o == k), default=None) for k in order}
    out, used = [], collections.Counter()
    for i, k in enumerate(owners):
        stop = len(streams.get(k, [])) if i == last[k] else used[k] + block
        out += streams.get(k, [])[used[k] : stop]
        used[k] = stop
    for k in order:
        if last[k] is None:
            out += streams.get(k, [])
    return out


@pytest.mark.parametrize(("block", "step"), [(16, mixing.STEP), (16, 0.37), (7, mixing.STEP), (1024, mixing.STEP)])
def test_the_mix_is_that_of_a_sequential_schedule(spark, block, step):
    rng = random.Random(14)
    df = docs(spark, [(i, words(rng, rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)] + [(500, "one two", "d")])
    got = mixing.mix_sources(df, block=block, step=step).collect()
    spot = F.xxhash64(F.lit(17), F.col("doc_id"), F.col("size"))
    sized = df.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("n"), mixing.word_count("text").alias("size"))
    rows = sized.withColumn("spot", spot).withColumn("bucket", F.pmod(F.xxhash64("spot"), F.lit(1024))).orderBy("bucket", "spot").collect()
    want = sequential_mix([(r["doc_id"], r["source"], r["size"]) for r in rows], {r["source"]: r["target"] for r in got}, block, step)
    pieces = []
    for r in got:
        at = 0
        for p in sorted(r["places"], key=lambda p: (p["slot"], p["offset"])):
            pieces.append((p["slot"], p["offset"], p["words"], r["doc_id"], at % max(1, r["size"])))
            at += p["words"]
    pieces.sort()
    found = [doc_id for _, _, n, doc_id, _ in pieces for _ in range(n)]
    assert found == [d for d, _ in want]


def test_the_schedule_decides_the_order_and_not_the_amounts(spark):
    rng = random.Random(15)
    df = docs(spark, [(i, words(rng, rng.randrange(1, 60)), f"s{i % 4}") for i in range(200)])
    runs = [{r["doc_id"]: (r["taken"], r["places"]) for r in mixing.mix_sources(df, **k).collect()} for k in ({"block": 32}, {"block": 32, "step": 0.0}, {"block": 64})]
    for other in runs[1:]:
        assert {k: v[0] for k, v in runs[0].items()} == {k: v[0] for k, v in other.items()}
        assert {k: v[1] for k, v in runs[0].items()} != {k: v[1] for k, v in other.items()}


# chat


def test_rotation_masks_cut_out_the_speakers_texts(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hello <|assistant|>"), (1, 2, "bob", "oh\nyes"), (1, 3, "ann", None), (1, 70, "bob", "later"), (2, 0, "system", "alone"), (3, None, None, "x"), (3, 1, "ann", "y"), (3, 1, "ann", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "ann", 0), (3, "unknown", 0)}
    r = got[1, "ann", 0]
    spans = [r["rendered"][int(a) : int(b)] for a, b in (m.split("-") for m in r["masks"].split(","))]
    assert spans == ["hello < |assistant|><|end|>\n", "<|end|>\n"]
    assert "<|user name=bob|>\noh\nyes<|end|>\n" in r["rendered"] and r["rendered"].startswith("<|system|>\nbe nice")
    assert r["rendered"].endswith("later<|end|>\n") and got[3, "ann", 0]["n_own"] == 2
    assert chat.rotate(df.limit(0)).count() == 0


def test_long_dialogues_are_one_rendering_in_parts(spark):
    rng = random.Random(3)
    names = ["ann", "bob", "system", "e|>ve\nx"]
    rows = [(1, t, rng.choice(names), f"text {i} 😀") for i, t in enumerate([None] * 150 + [7] * 150 + [rng.randrange(-90, 300) for _ in range(200)])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    told = sorted(((t is not None, t or 0, n.replace("|>", "| >").replace("\n", " "), x) for _, t, n, x in rows))
    for speaker in ("ann", "bob", "e| >ve x"):
        parts = sorted((r for r in chat.rotate(df).filter(F.col("speaker") == speaker).collect()), key=lambda r: r["part"])
        whole = "".join(r["rendered"] for r in parts)
        head = lambda n: "<|system|>" if n == "system" else "<|assistant|>" if n == speaker else f"<|user name={n}|>"
        assert whole == "".join(f"{head(n)}\n{x}<|end|>\n" for _, _, n, x in told)
        assert [r["n_turns"] for r in parts] == [64] * 7 + [52] and [r["part"] for r in parts] == list(range(8))
        assert [r["start"] for r in parts] == [0, *itertools.accumulate(len(r["rendered"]) for r in parts)][:-1]
        spans = [whole[int(a) : int(b)] for r in parts for a, b in (m.split("-") for m in r["masks"].split(",") if m)]
        assert spans == [f"{x}<|end|>\n" for _, _, n, x in told if n == speaker]


# near-duplicates


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, num, den):
    sets = collections.defaultdict(list)
    for i, t in rows:
        sets[i].append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, sa), (b, sb) in itertools.combinations([(i, s) for i, many in sets.items() for s in many], 2):
        if sa and sb and den * len(sa & sb) >= num * len(sa | sb):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(spark, n, num):
    rng = random.Random(n)
    base = words(rng, 120)
    rows = [(i, words(rng, rng.randrange(1, 80))) for i in range(60)]
    rows += [(100 + i, edited(rng, base, rng.randrange(0, 7))) for i in range(60)] + [(200 + i, base) for i in range(20)] + [(300, base.upper())]
    rows += [(400, None), (401, ""), (402, " \t"), (403, "one"), (404, "One"), (405, "one two")]
    got = neardup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]), n=n, num=num, den=100, few=16).collect()
    want = brute_components(rows, n, num, 100)
    texts = dict(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(shingles(texts[r["doc_id"]], n)) and r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_near_duplicates_compare_every_text_of_an_id(spark, parts):
    rng = random.Random(9)
    a, b, c = words(rng, 100), words(rng, 100), words(rng, 100)
    rows = [(5, a), (5, b), (9, a + " x"), (10, b + " y"), (11, c), (12, c + " z"), (12, "something else with five words"), (5, a)]
    got = neardup.near_duplicates(docs(spark, [(i, t, None) for i, t in rows]).repartition(parts), n=3, num=85, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {5: 5, 9: 5, 10: 5, 11: 11, 12: 11} == brute_components(rows, 3, 85, 100)
    assert len(got) == len(rows)


def test_near_duplicates_inside_a_large_group_below_the_threshold(spark):
    rng = random.Random(11)
    base = words(rng, 150, 10**6)
    loose = [(i, edited(rng, base, 12)) for i in range(240)]  # alike by about a half
    tight = [(1000 + i, edited(rng, loose[i][1], 2)) for i in range(60)]
    want = brute_components(loose + tight, 3, 85, 100)
    got = neardup.near_duplicates(docs(spark, [(i, t, None) for i, t in loose + tight]), n=3, num=85, den=100, few=20).collect()
    linked = {i for i, c in want.items() if c != i}
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert len(linked) >= 40 and all(found[i] in (want[i], i) for i in want)
    assert sum(found[i] == want[i] for i in linked) >= 0.97 * len(linked)


def test_near_duplicates_of_nulls_and_nothing(spark):
    rows = neardup.near_duplicates(docs(spark, [(None, "a b c d e f", None), (None, "a b c d e f", None), (5, "a b c d e f", None), (5, "a b c d e f", None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (50, 51), (51, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {50: 50, 51: 50}
    assert got == want


def test_word_codes_follow_words():
    texts = ["The cat  sat", "", "\tCAT\x0bthe", "Ä ä", "x"]
    data = [t.encode() for t in texts]
    codes, at = word_codes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    lists = [codes[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    assert [len(x) for x in lists] == [3, 0, 2, 2, 1]
    assert lists[0][1] == lists[2][0] and lists[0][0] == lists[2][1] and lists[3][0] != lists[3][1]


# toxicity


def test_nearest_examples_are_those_of_all_cosines():
    rng = random.Random(2)
    vectors = []
    for _ in range(300):
        v = {rng.randrange(30): rng.random() + 0.1 for _ in range(rng.randrange(1, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    triples = [(e, t, w) for e, v in enumerate(vectors) for t, w in v.items()]
    rng.shuffle(triples)
    index = toxicity.Index(np.array([e for e, _, _ in triples]), np.array([t for _, t, _ in triples]), np.array([w for _, _, w in triples]), 300, 30)
    assert len(index.nearest(np.zeros(0, np.int64), np.zeros(0), 7)[0]) == 0
    for q in vectors[:60]:
        ids, scores = index.nearest(np.array(list(q)), np.array(list(q.values())), 7)
        every = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), e) for e, v in enumerate(vectors)))
        every = [(s, e) for s, e in every if s < 0][:7]
        assert ids.tolist() == [e for _, e in every]
        assert scores == pytest.approx([-s for s, _ in every], abs=1e-6)


def test_toxicity_scores_are_those_of_all_examples(spark, sf):
    """The whole table's scores against words, idf, boosts, cosines and votes over all examples, without an index."""
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    told = {r["doc_id"]: r["toxic"] for r in toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    alike = {}
    for i in sorted(told):
        if texts.get(i):
            alike.setdefault(texts[i], [i, 0])[1] |= told[i]
    examples = [(i, y, collections.Counter(split(t))) for t, (i, y) in alike.items()]
    n, positive = len(examples), sum(y for _, y, _ in examples)
    df, hits = collections.Counter(w for _, _, c in examples for w in c), collections.Counter(w for _, y, c in examples if y for w in c)
    rate, base = positive / n, (positive + 0.5) / (n + 10)
    part = lambda o, e: o * math.log(o / e) if o else 0.0

    def weight(w):
        if w not in df:
            return math.log(n + 1) + 1
        gain, share = 2 * (part(hits[w], df[w] * rate) + part(df[w] - hits[w], df[w] * (1 - rate))), hits[w] / df[w]
        return (math.log((n + 1) / (df[w] + 1)) + 1) * (1 + 20 * ((share - rate) / (1 - rate) if gain >= 15 and share > rate else 0))

    def unit(c):
        raw = {w: (1 + math.log(k)) * weight(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {w: x / norm for w, x in raw.items()}

    vectors = [unit(c) for _, _, c in examples]

    def vote(v, but=None):
        cosines = [(sum(x * u.get(w, 0.0) for w, x in v.items()), e) for e, u in enumerate(vectors) if e != but]
        near = sorted((c for c in cosines if c[0] > 0), reverse=True)[:16]
        return (sum(c * c * examples[e][1] for c, e in near) + 0.1 * base) / (sum(c * c for c, _ in near) + 0.1), {examples[e][0] for _, e in near}

    knots = toxicity.isotonic(np.array([vote(v, e)[0] for e, v in enumerate(vectors)]), np.array([float(y) for _, y, _ in examples]))
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    for r in got:
        found = split(texts[r["doc_id"]])
        value, near = vote(unit(collections.Counter(found)))
        if not near:
            assert r["score"] == pytest.approx(base) and not r["evidence"]
            continue
        assert r["score"] == pytest.approx(float(np.interp(value, *knots)), abs=1e-4)
        assert len({e["id"] for e in r["evidence"]} & near) >= len(near) - 2  # ties aside


def test_toxicity_learns_from_labels_and_gives_evidence(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 30) + (" you utter buffoon" if i % 5 == 0 else ""), None) for i in range(200)] + [(900, None, None), (901, "", None), (902, "such a BUFFOON indeed", None), (902, "such a BUFFOON indeed", None)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(5, 0), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[i] for i in range(0, 200, 5)) > 0.5 > 0.3 > max(score[i] for i in range(200) if i % 5)
    assert score[902] > 0.5 and score[900] == score[901] < 0.3
    assert all(e["label"] == 1 for r in got if r["doc_id"] == 902 for e in r["evidence"])
    none = toxicity.toxicity(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert [r["score"] for r in none] == pytest.approx([0.05] * 3)


def test_a_long_labelled_text_does_not_switch_learning_off(spark):
    rng = random.Random(6)
    texts = [(i, words(rng, 20, 50) + (" dreadful awful" if i % 2 else ""), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, toxic int")
    for at in range(3):  # wherever its hash puts it
        df = docs(spark, [*texts, (60 + at, "dreadful " * 2000, "s")])
        got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, labels.unionByName(labels.limit(1).select(F.lit(60 + at).cast("long").alias("doc_id"), F.lit(1).alias("toxic"))), most_bytes=12_000).collect()}
        assert all((got[i] > 0.5) == bool(i % 2) for i in range(60))


def test_toxicity_of_held_out_documents(spark, sf):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right / len(held) >= 0.85


# contamination


def test_contamination_finds_copies_and_edited_copies_only(spark, way):
    rng = random.Random(6)
    items = [(i, words(rng, 40, 900)) for i in range(8)] + [(90, None), (91, ""), (92, "tiny item"), (93, words(rng, 400, 900))]
    changed = items[2][1].split()
    for i in range(5, 40, 9):
        changed[i] = "changed"
    del changed[20]
    rows = [
        (1, words(rng, 200, 900), None),
        (2, words(rng, 50, 900) + " " + items[1][1].upper() + ". " + words(rng, 50, 900), None),
        (3, words(rng, 300, 900) + " " + " ".join(changed) + " " + words(rng, 30, 900), None),
        (4, None, None),
        (5, "", None),
        (6, items[93 - 82][1], None),
        (7, items[1][1], None),
        (7, items[1][1], None),
    ]
    bench = spark.createDataFrame(items + [items[1]], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], round(r["score"], 1)) for r in decontamination.contaminated(docs(spark, rows), bench).collect()]
    assert sorted(got) == [(2, 1, 1.0), (3, 2, 0.8), (6, 93, 1.0), (7, 1, 1.0), (7, 1, 1.0)]
    assert decontamination.contaminated(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0


@pytest.fixture(params=["sent", "joined"])
def way(request, monkeypatch):
    """Test items sent to the tasks, or joined by their seeds, which many items are."""
    if request.param == "joined":
        monkeypatch.setattr(decontamination, "SENT_BYTES", -1)


def test_contamination_is_that_of_brute_force_alignment(spark, way):
    rng = random.Random(16)
    items = [(i, words(rng, n, 900)) for i, n in enumerate([40, 40, 40, 60, 128, 129, 12, 9, 2])]

    def edited(text, share, kinds):
        out = []
        for w in text.split():
            kind = rng.choice(kinds) if rng.random() < share else "keep"
            out += {"keep": [w], "change": [f"x{rng.randrange(99)}"], "drop": [], "add": [w, f"x{rng.randrange(99)}"]}[kind]
        return " ".join(out)

    fifth = " ".join("changed" if i % 5 == 2 else w for i, w in enumerate(items[0][1].split()))
    third = " ".join("x" if i % 3 == 1 else w for i, w in enumerate(items[3][1].split()))
    half = " ".join(items[1][1].split()[:21])
    texts = [items[2][1], third, half] + [fifth] * 30 + [edited(items[2][1], 0.3, ["change"]) for _ in range(40)]
    texts += [edited(t, share, ["change", "drop", "add"]) for _, t in items for share in (0.15, 0.3, 0.45) for _ in range(4)]
    texts += [" ".join(t.split()[: len(t.split()) // 2] + ["put", "in", "here"] + t.split()[len(t.split()) // 2 :]) for _, t in items]
    rows = [(i, f"{words(rng, rng.randrange(40), 900)} {t} {words(rng, rng.randrange(40), 900)}", None) for i, t in enumerate(texts)]
    code = lambda t: np.array([int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in t.split()], np.uint64)
    expected = {}
    for (doc_id, text, _), (item, own) in itertools.product(rows, items):
        parts = np.array_split(code(own), -(-len(own.split()) // decontamination.SEGMENT))
        for part in parts:
            score = decontamination.align(part, code(text))[0]
            if score >= min(len(part), max(0.5 * len(part), 6)):
                expected[doc_id, item] = max(expected.get((doc_id, item), 0), score / len(part))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, 0) for i, t in enumerate(texts) if t == fifth} <= set(got)
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "date", "bigint"])
def test_contamination_keeps_ids_of_any_type(spark, kind, way):
    text = "a passage of some twelve different words that a benchmark item really has"
    items = spark.createDataFrame([(7, text), (8, "tiny item")], "n int, text string")
    key = F.date_add(F.lit("2020-01-01"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    found = spark.createDataFrame([(1, f"before {text} after"), (2, "a document with the tiny item in it"), (3, "none")], "doc_id int, text string")
    got = decontamination.contaminated(found, items.select(key.alias("item_id"), "text"))
    assert got.schema["item_id"].dataType.simpleString() == kind and sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    assert decontamination.contaminated(found.filter("doc_id = 3"), items.select(key.alias("item_id"), "text")).count() == 0


def test_both_ways_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i % 9, words(rng, n, 60)) for i, n in enumerate([40, 300, 7, 129, 1, 2, 6, 90, 40, 40, 50])]  # two texts of an item
    often = items[1][1]
    texts = [often] * 40 + [" ".join([items[0][1]] * 30), None, "", items[4][1], "x " * 5000 + items[3][1]]  # copies, and a text that repeats one
    texts += [" ".join(w if rng.random() < 0.8 else "y" for w in t.split()) for _, t in items for _ in range(3)] + [words(rng, 3000, 60)]
    found = docs(spark, [(i if i % 11 else None, t, None) for i, t in enumerate(texts)]).withColumns({c: F.lit("clash") for c in ("key", "code", "seg", "pos", "item")})
    bench = spark.createDataFrame(items + items[:2] + [(None, items[7][1])], "item_id long, text string")
    rows = []
    for most in (1 << 20, -1):
        monkeypatch.setattr(decontamination, "SENT_BYTES", most)
        rows.append(sorted(map(tuple, decontamination.contaminated(found, bench).collect()), key=repr))
    assert len(rows[0]) > 100 and rows[0] == rows[1]


def test_alignment_is_that_of_the_full_table():
    rng = random.Random(8)
    for _ in range(30):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1))
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), table[i - 1, j] - 0.5, table[i, j - 1] - 0.5)
        assert decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == pytest.approx(table.max())


# language model


def brute_katz(train, texts):
    """The same model with dictionaries; words of one count or more, all frequent."""
    tokens = [t.lower().split() + ["<end>"] for t in train]
    c = collections.Counter(w for t in tokens for w in t)
    total, distinct = sum(c.values()), len(c)
    below = total + 0.5 * (distinct + 1)
    p1 = lambda w: (c[w] + 0.5) / below
    pairs = collections.Counter(p for t in tokens for p in zip(["<end>", *t[:-1]], t, strict=True))
    seen = collections.Counter(pairs.values())
    d = language_model.discounts([seen[r] for r in range(1, 7)])
    first = collections.Counter()
    for (h, _), n in pairs.items():
        first[h] += n
    kept = lambda n: (d[n] if n <= 5 else 1.0) * n
    after = collections.defaultdict(list)
    for (h, w), n in pairs.items():
        after[h].append((w, n))

    def p(h, w):
        if not first[h]:
            return p1(w)
        own = sum(kept(n) for _, n in after[h])
        size = max(first[h], own + 0.5)
        if pairs[h, w]:
            return kept(pairs[h, w]) / size
        return (1 - own / size) / (1 - sum(p1(x) for x, _ in after[h])) * p1(w)

    vocabulary = [*c, "never-seen"]
    for h in list(c)[:8] + ["<end>"]:
        assert sum(p(h, w) for w in vocabulary) == pytest.approx(1)
    out = []
    for t in texts:
        own = (t or "").lower().split() + ["<end>"]
        out.append((sum(math.log10(p1(w)) for w in own), sum(math.log10(p(h, w)) for h, w in zip(["<end>", *own[:-1]], own, strict=True)), len(own), sum(c[w] > 0 for w in own)))
    return out


def test_katz_is_that_of_brute_force(spark):
    rng = random.Random(9)
    train = [words(rng, rng.randrange(1, 60), 40) for _ in range(60)]
    extra = [words(rng, 30, 60), None, "", "never-seen other", "W1 w2"]
    rows = [(i, t, "train") for i, t in enumerate(train)] + [(1000 + i, t, "held") for i, t in enumerate(extra)]
    got = {r["doc_id"]: r for r in language_model.katz(docs(spark, rows), F.col("source") == "train").collect()}
    want = brute_katz(train, train + extra)
    for (i, _, _), (base, score, n, known) in zip(rows, want, strict=True):
        r = got[i]
        assert (r["base_score"], r["score"]) == pytest.approx((base, score))
        assert (r["n_tokens"], r["n_known"]) == (n, known)


def test_katz_counts_pairs_of_all_words(spark):
    rng = random.Random(10)
    train = [words(rng, rng.randrange(1, 60), 40) for _ in range(60)]
    extra = [words(rng, 30, 60), None, "", "never-seen other", "W1 w2"]
    rows = [(i, t, "train") for i, t in enumerate(train)] + [(1000 + i, t, "held") for i, t in enumerate(extra)]
    want = brute_katz(train, train + extra)
    for frequent in (0, 5, 20):
        got = {r["doc_id"]: r for r in language_model.katz(docs(spark, rows), F.col("source") == "train", frequent=frequent).collect()}
        for (i, _, _), (base, score, n, known) in zip(rows, want, strict=True):
            assert (got[i]["base_score"], got[i]["score"]) == pytest.approx((base, score))
            assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)


@pytest.mark.parametrize("frequent", [0, 65_535])
def test_katz_keeps_something_for_new_words_after_frequent_pairs_only(spark, frequent):
    train = ["a b"] * 10
    got = {r["doc_id"]: r for r in language_model.katz(docs(spark, [(i, t, "train") for i, t in enumerate(train)] + [(90, "b c a", "held")]), F.col("source") == "train", frequent=frequent).collect()}
    (base, score, _, _) = brute_katz(train, ["b c a"])[0]
    assert (got[90]["base_score"], got[90]["score"]) == pytest.approx((base, score))
    assert base - 6 < got[90]["score"] < 0


def test_katz_scores_held_out_texts_above_their_base(spark, sf):
    got = [r for r in language_model.op2_katz(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert all(r["score"] > -20 * r["n_tokens"] for r in got)


def test_katz_with_few_classes_sums_to_one_and_repeats_count(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 30, 50), "train") for i in range(40)] + [(7, "w1 w2", "held"), (7, "w1 w2", "held"), (None, "w1", "held")]
    got = language_model.katz(docs(spark, rows), F.col("source") == "train", frequent=10).collect()
    assert len(got) == len(rows)
    twice = [r["score"] for r in got if r["doc_id"] == 7 and r["n_tokens"] == 3]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    # all one-word texts, a word of each kind: p(w | end) p(end | w) summed over w is at most 1
    one = [(i, f"w{i}", "held") for i in range(50)]
    scores = language_model.katz(docs(spark, rows[:40] + [(100 + i, t, s) for i, t, s in one]), F.col("source") == "train", frequent=10).filter("doc_id >= 100").collect()
    assert 0 < sum(10 ** r["score"] for r in scores) < 1
    unseen = language_model.katz(docs(spark, rows[:2]), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in unseen)


# main text


def test_cut_is_minimal():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randrange(1, 9)
        margins = [rng.randrange(-6, 7) for _ in range(n)]
        edges = {(a, b): rng.randrange(1, 6) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda side: sum((0 if s else max(m, 0)) + (max(-m, 0) if s else 0) for m, s in zip(margins, side, strict=True)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])  # noqa: B023, E731
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert cost(webtext.minimum_cut(margins, edges)) == best


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav>menu <a href=x>a</a></nav>
<div id="main-content"><div class="breadcrumb">Home &gt; x</div><h2>A story title</h2><p>A long paragraph of text, with plenty of words in it &amp; more;\n it ends here.<p>Another one, short.
<div class="ad-box">Buy now! Great offers for everyone, click here today and save a lot.</div>
<p>The third paragraph of the article continues with a <a href="q">link</a> inside and several further words.</p></div>
<aside class=sidebar><p>Related stories you may like, with a long enough sentence to look like text.</p></aside>
<section id="comments"><p>I think this article is very good and I agree with every word in it, thank you.</p></section>
<form>Search <input><button>Go</button></form><script>var t="</p>";</script><footer>&copy; 2020 Somebody. All rights reserved.</footer></body></html>"""


def test_main_text(spark):
    want = ["A story title", "A long paragraph of text, with plenty of words in it & more; it ends here.", "Another one, short.", "The third paragraph of the article continues with a link inside and several further words."]
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (1, "u", PAGE), (5, "u", "a < b <unclosed")], "page_id long, url string, html string")
    got = webtext.extracted(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["\n\n".join(want)] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (2, 3, 4))
    assert len(got) == 6 and webtext.extracted(df.limit(0)).count() == 0
    assert webtext.main_text("<article>" + "<p>A sentence of the article.</p>" * 3000 + "</article>") == ["A sentence of the article."] * 3000


# neighbours


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700 + i, x[0].tolist()) for i in range(40)]
    rows += [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [1.0] * 3), (980, [None] * 16), (None, x[1].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, leaf=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    valid = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and len(v) == 16 and i not in (920, 940, 980)}
    assert set(got) == {i for i in valid if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        want = sorted(((-float(v @ valid[q]), i) for i, v in valid.items() if i != q))[:20]
        hits += len({i for _, i in want} & {i for i, _ in found})
        total += 20
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(s == pytest.approx(float(valid[i] @ valid[q])) for i, s in found)
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(few.limit(0)).count() == 0


def found_and_recall(spark, x, **settings):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, **settings).collect():
        got[r["query_id"]].add(r["vec_id"])
    inner = x @ x.T
    hits = total = 0
    for q in range(0, len(x), 20):
        want = sorted((-inner[q, i], i) for i in range(len(x)) if i != q)[:20]
        hits += len({i for _, i in want} & got[q])
        total += len(want)
        assert len(got[q]) == min(20, len(x) - 1)
    return hits / total


@pytest.mark.parametrize("n", [2, 20, 21, 33, 36, 40, 66, 80])
def test_vectors_on_an_arc_get_all_their_neighbours(spark, n):
    angle = np.linspace(0, 1.5, n)
    assert found_and_recall(spark, np.stack([np.cos(angle), np.sin(angle)], 1)) >= 0.9


def test_recall_on_clusters_and_spread_norms_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    clusters = np.repeat(rng.normal(size=(40, 24)), 40, axis=0) + 0.05 * rng.normal(size=(1600, 24))
    assert found_and_recall(spark, clusters, block=64, sample=400) >= 0.9
    spread = rng.normal(size=(900, 12)) * np.exp(rng.normal(size=(900, 1)))
    assert found_and_recall(spark, spread, block=16, leaf=8, sample=300) >= 0.9


def test_a_search_of_clusters_visits_few_leaves():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(50, 16)), 40, axis=0) + 0.02 * rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = neighbours.Forest(np.hstack([x, np.zeros((2000, 1))]), 12, 32, 3)
    asked = np.hstack([x[:20], np.zeros((20, 1))])
    near = np.argsort(-(x[:20] @ x.T), axis=1)[:, 1:21]
    share = forest.share_for(asked, near, 0.97)
    assert share < 0.1
    assert forest.search(asked[0], int(share * 2000))[0].mean() < 0.1


# URLs


def test_given_rules_and_parts(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q#f"), (2, "http://example.net"), (3, "https://b.example.com/de/1"), (4, "http://x.org/fr/"), (5, None), (6, "no scheme"), (7, "http://a.com/en/"), (7, "http://a.com/en/"), (8, "http://notnet/")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(df, urls.RULES, none).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3] == ("b.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[8] == ("notnet", "/", None, "allow")
    assert urls.judged(df, urls.RULES, none).count() == len(rows)


def test_mined_rules_are_those_that_hold(spark):
    rows = [(f"http://host{i}.com/{'casino' if i % 4 == 0 else 'news'}/p{i}", i % 4 == 0) for i in range(120)] + [(None, True), ("http://x.com/", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = urls.mine(labelled).collect()
    assert [r["tokens"] for r in rules] == [["p:casino"]] and rules[0]["confidence"] == pytest.approx(1.0)
    df = spark.createDataFrame([(1, "https://other.org/casino/1"), (2, "https://other.org/news/1")], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in urls.judged(df, urls.RULES, labelled).collect()}
    assert got == {1: ("block", "p:casino"), 2: ("allow", None)}


def test_mined_rules_are_those_of_all_itemsets(spark):
    """Against every subset of tokens that a blocked URL has, counted over all URLs; then noise alone gives no rules."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        a, b, c = rng.choice("pqr"), rng.choice(["news", "shop", "play", "blog"]), rng.choice(["x", "y", "z"])
        bad = 0.95 if (a, b) == ("p", "play") else 0.9 if (b, c) == ("shop", "z") else 0.1
        rows.append((f"http://{a}.com/{b}/i{i}?k={c}", rng.random() < bad))
    df = spark.createDataFrame([*rows, rows[0]], "url string, blocked boolean")
    told = df.distinct().select("blocked", (F.pmod(F.xxhash64("url"), F.lit(3)) == 0).alias("held"), urls.tokens_of(F.col("url")).alias("own")).collect()
    mined, held = [r for r in told if not r["held"]], [r for r in told if r["held"]]
    n, hits, held_rate = len(mined), sum(r["blocked"] for r in mined), sum(r["blocked"] for r in held) / len(held)
    least = max(0.002 * n, 8)
    having = collections.defaultdict(list)
    for i, r in enumerate(mined):
        for t in r["own"]:
            having[t].append(i)
    apart = {min(t for t in having if having[t] == same) for same in having.values()}
    blocked = [sorted(apart & set(r["own"])) for r in mined if r["blocked"]]
    freq = collections.Counter(s for own in blocked for k in range(1, len(own) + 1) for s in itertools.combinations(own, k))
    candidates = {}
    for s, f in freq.items():
        if f >= least:
            every = sum(set(s) <= set(r["own"]) for r in mined)
            if f / every >= 0.5 and f / every / (hits / n) >= 2:
                candidates[s] = f / every
    z = statistics.NormalDist().inv_cdf(1 - 0.05 / len(candidates))

    def holds(s):
        found = [r["blocked"] for r in held if set(s) <= set(r["own"])]
        m = len(found)
        p = sum(found) / m if m else 0.0
        bound = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m) if m else 0.0
        return p >= 0.5 and p >= 2 * held_rate and bound > held_rate

    kept = {s: c for s, c in candidates.items() if holds(s)}
    want = {s: c for s, c in kept.items() if not any(set(t) < set(s) and kept[t] >= c for t in kept)}
    got = {tuple(r["tokens"]): r["confidence"] for r in urls.mine(df).collect()}
    assert got == pytest.approx(want) and any({"p:play"} <= set(s) for s in want)
    noise = spark.createDataFrame([(u, rng.random() < 0.2) for u, _ in rows], "url string, blocked boolean")
    assert urls.mine(noise).count() == 0
