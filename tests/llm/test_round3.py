"""Trie, line labelling and filter interactions: against brute force, and nulls, empties, ties, repeats, empty tables, clashes."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import art, interaction, lines, trie

WORD = r"[^\x20\x09-\x0D]+"
CLASHES = "id item part fails n good toxic same first least ahead side place stretch rows before at words seg key p q a b own taken base head bins content turns key quality".split()


def clashing(df):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in df.columns})


# radix trees


@pytest.mark.parametrize("letters", [2, 5, 30, 256])
def test_trees_find_every_beginning(letters):
    rng = random.Random(letters)
    keys = [bytes(rng.randrange(letters) for _ in range(rng.randrange(0, 7))) for _ in range(800)] + [b"\x00" * 300, b"\x00" * 299 + b"\x01", b""]
    tree = art.Tree()
    for i, k in enumerate(keys):
        tree.add(k, i)
    layouts, ended, totals = set(), collections.Counter(), {}
    for node, start, end in tree.upwards():
        layouts.add(type(node))
        assert node.count() <= node.places and end - start == len(node.prefix) + (node is not tree.root)
        totals[id(node)] = len(node.ends) + sum(totals.pop(id(child)) for _, child in node.children())
        assert node is tree.root or len(node.ends) or node.count() > 1  # paths are compressed
        labels = [label for label, _ in node.children()]
        assert labels == sorted(labels) and all(node.find(label) is child for label, child in node.children())
        for i in node.ends:
            assert len(keys[i]) == end
            ended[keys[i]] += 1
    assert ended == collections.Counter(keys) and list(totals.values()) == [len(keys)]
    assert (art.Node256 in layouts) == (letters == 256) and (art.Node4 in layouts)
    if letters == 30:
        assert {art.Node16, art.Node48} & layouts


# trie of conversations


def brute_trie(conversations):
    """Nodes of {conv_id: [(role, text)]} by their paths."""
    nodes = collections.defaultdict(list)
    for c, path in conversations.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    words = {p: len(re.findall(WORD, p[-1][1])) if p else 0 for p in nodes}
    childless = {p for p in nodes if not any(len(q) == len(p) + 1 and q[:-1] == p for q in nodes)}
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(conversations[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless & set(below)),
                 sum((len(nodes[q]) - 1) * words[q] for q in below), len(ends), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def brute_rebuilt(conversations):
    out = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(int(c / 20) * 20, [])[:h] + own[h:]
    return out


def some_conversations(rng, n=90, most=6):
    said = [("user", f"says {i} " + "x " * i) for i in range(5)] + [("assistant", ""), ("", "words only")]
    return {rng.randrange(-5, 300): [rng.choice(said) for _ in range(rng.randrange(1, most))] for _ in range(n)}


CONVERSATION = "conv_id long, turn long, role string, text string"


def table(spark, conversations):
    rows = [(c, i, r or None, t or None) for c, path in conversations.items() for i, (r, t) in enumerate(path)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, CONVERSATION)


@pytest.mark.parametrize("held", [8 << 20, 300])
@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_are_those_of_brute_force(spark, monkeypatch, seed, held):
    monkeypatch.setattr(trie, "HELD", held)
    conversations = some_conversations(random.Random(seed))
    got = trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(clashing(table(spark, conversations)).repartition(5)))).collect()
    want = brute_trie(brute_rebuilt(conversations))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_dialogues_are_cut_into_segments_and_common_ones_spread(spark):
    rng = random.Random(5)
    trunk = [("user", f"turn {i}") for i in range(200)]
    conversations = {c: trunk[: rng.choice([3, 63, 64, 65, 128, 129, 200])] + [("user", f"own {rng.randrange(3)}") for _ in range(rng.choice([0, 1, 70]))] for c in range(24)}
    conversations |= {100 + c: trunk[:2] for c in range(150)}
    got = trie.prefix_trie(trie.ordered_turns(table(spark, conversations)).repartition(4)).collect()
    want = brute_trie(conversations)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_nulls_ties_repeats_and_nothing(spark):
    rows = [(20, None, "b", None), (20, None, "a", "x"), (20, 1, None, ""), (20, 1, None, ""), (21, 1, "a", "x"), (None, 1, "user", "gone"), (7, 5, "a", "x"), (7, 5, "a", "x")]
    got = trie.prefix_trie(trie.ordered_turns(clashing(spark.createDataFrame(rows, CONVERSATION)))).collect()
    want = brute_trie({20: [("a", "x"), ("b", ""), ("", ""), ("", "")], 21: [("a", "x")], 7: [("a", "x"), ("a", "x")]})
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], CONVERSATION)
    assert trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(none))).count() == 0
    # turnless members end at the root: one turn, of which none is left, and no first of the twenty
    c = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4)
    alone = trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(spark.createDataFrame([(c, 0, "user", "hi")], CONVERSATION)))).collect()
    assert [tuple(r) for r in alone] == list(brute_trie({c: []}))


# line labelling


def field(rng):
    f = lines.Field()
    f.weight = np.array([rng.uniform(-1, 1) for _ in f.weight])
    f.first, f.pair = np.array([rng.uniform(-1, 1) for _ in range(2)]), np.array([[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
    return f


def total(f, scores, labels):
    return f.first[labels[0]] + sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(f.pair[a, b] for a, b in itertools.pairwise(labels))


def test_viterbi_and_likelihood_are_those_of_all_labellings():
    rng = random.Random(3)
    nrng = np.random.default_rng(3)
    f = field(rng)
    sizes = [1, 4, 2, 7, 4]
    at = np.cumsum([0, *sizes])
    bins = np.stack([nrng.integers(0, len(edges) + 1, at[-1]) for _, edges in lines.MEASURES], 1).astype(np.uint8)
    labels = nrng.integers(0, 2, at[-1])
    value, scores = 0.0, f.scores(bins)
    for a, b in itertools.pairwise(at):
        every = {y: total(f, scores[a:b], y) for y in itertools.product((0, 1), repeat=b - a)}
        assert tuple(f.decoded(scores[a:b]).astype(int)) == max(every, key=every.get)
        value += every[tuple(labels[a:b].tolist())] - np.log(np.exp(list(every.values())).sum())
    got, slope = f.likelihood(bins, labels, at, 0.0)
    assert got == pytest.approx(value / at[-1])
    for k in (0, 5, 40, -6, -5, -4, -3, -2, -1):  # the gradient, by small steps
        g = field(random.Random(3))
        both = np.concatenate([g.weight, g.first, g.pair.ravel()])
        both[k] += 1e-6
        g.weight, g.first, g.pair = both[: len(g.weight)], both[len(g.weight) : -4], both[-4:].reshape(2, 2)
        assert (g.likelihood(bins, labels, at, 0.0)[0] - got) / 1e-6 == pytest.approx(slope[k], abs=1e-4)


def brute_counts(text):
    words = re.findall(WORD, text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            again += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside)


EDGES = [None, "", "\n", " \n\t\n", "one", "a\n\nb\na\n", "ü é 漢字 😀\nü é 漢字 😀", "a b c d e f a b c d e", "Und " * 40, "x\r\ny\x0bz\n|#*\n\n", "w " * 50_000 + "end\n" * 3, "A a\na A\nA a"]


def test_counts_are_those_of_plain_python(spark):
    rng = random.Random(4)
    texts = EDGES + ["".join(rng.choice(["a", "b", " ", "\n", "ü", "#"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    df = clashing(spark.createDataFrame(list(enumerate(texts)) + [(None, "x y"), (3, EDGES[3])], "doc_id long, text string")).coalesce(2)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = lines.line_quality(df, labels).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "x y"
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(text), repr(text)
        assert r["content_words"] == r["n_words"] and r["boilerplate"] == []
    assert lines.line_quality(df.limit(0), labels).count() == 0


def test_lines_are_told_apart_from_labels_of_documents(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["river", "house", "gentle", "walks", "under", "bright"]) for _ in range(rng.randrange(6, 14))).capitalize() + "."
    chaff = lambda: " | ".join(rng.choice(["home", "login", "cart", "help"]) for _ in range(rng.randrange(4, 9))) + " |"
    rows, labels = [], []
    for i in range(120):
        own = [prose() for _ in range(rng.randrange(2, 7))]
        if i % 3 == 0:
            bad = [chaff() for _ in range(rng.randrange(4, 9))]
            own = [*bad, own[0]] if i % 2 else [own[0], *bad]  # a line of prose in a bad document
        rows.append((i, "\n".join(own)))
        labels.append((i, int(i % 3 > 0), 0))
    rows.append((500, "\n".join([prose(), chaff(), "", chaff(), prose()])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.line_quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[500]["boilerplate"] == [1, 3]
    for i, text in rows[:-1]:
        n = len(text.split("\n"))
        assert got[i]["boilerplate"] == ([] if i % 3 else list(range(n - 1)) if i % 2 else list(range(1, n)))


def test_quality_of_documents_that_were_not_learned_from(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = lines.line_quality(docs, labels.filter(~odd)).join(labels.filter(odd), "doc_id").filter("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").collect()
    wrong = sum((2 * r["content_words"] >= r["n_words"]) != (r["quality"] == 1) for r in got)
    assert len(got) > 100 and sum(r["quality"] == 0 for r in got) > 5 and wrong <= 0.02 * len(got)


# filter interactions


def brute_interactions(docs, labels):
    """Every order applied to every document, one filter after another. docs: (id, part, text)."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    found = []
    for i, part, t in docs:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in least and least[t] < i}
        found.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {f[0] for f in found}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in found if f[0] == part]
            everything = left
            for step, z in enumerate(order, 1):
                gone = [f for f in left if z in f[1]]
                left = [f for f in left if z not in f[1]]
                out[part, order, step] = [len(left), len(gone), sum(z in f[1] for f in everything) - len(gone), sum(f[1] == {z} for f in everything), sum(f[2] for f in gone), sum(f[3] for f in gone), z]
                shapley[part, z] += len(gone)
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def test_interactions_are_those_of_all_orders_applied(spark):
    rng = random.Random(7)
    pool = [None, "", "Few words", "few words", "SHOUTED " * 210, "same " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "|", "ÀÉ " * 200, "long " * 60_000]
    docs = [(rng.randrange(80) if rng.random() < 0.9 else None, rng.choice(["en", "de", None, ""]), rng.choice(pool)) for _ in range(120)]
    docs += docs[:5]
    labels = [(rng.randrange(80), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(None, 1, 1)]
    df = clashing(spark.createDataFrame([(i, t, p) for i, p, t in docs], "doc_id long, text string, lang string")).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = interaction.counted_failures(df, known)
    got = interaction.interactions(counts, lost={"good_lost": "good", "toxic_lost": "toxic"}).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute_interactions(docs, labels)
    none = interaction.counted_failures(df.limit(0), known.limit(0))
    assert interaction.interactions(none).count() == 0


def test_shapley_values_share_out_what_all_filters_remove(spark):
    counts = spark.createDataFrame([("x", 0, 5), ("x", 1, 3), ("x", 3, 7), ("x", 7, 2), ("x", 6, 1)], "part string, fails int, n long")
    got = interaction.interactions(counts, "pqr").collect()
    assert len(got) == 18
    assert sum(r["shapley"] for r in got if r["filter_order"] == "pqr") == 6 * 13  # all orders, all that fail anything
    for wrong in ("", "aa", "abcdefgh"):
        with pytest.raises(ValueError):
            interaction.interactions(counts, wrong)
