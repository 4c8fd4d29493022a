import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.operators import ordered as O
from loomspark.operators import packing as P
from loomspark.streaming import progress as S


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def greedy(weights, cap, empty=True):
    part, total, some, out = 0, 0, False, []
    for w in weights:
        if (some if empty else total > 0) and total + w > cap:
            part, total = part + 1, 0
        total, some = total + w, True
        out.append(part)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.booleans())
def test_next_fit(spark, weights, empty):
    df = spark.createDataFrame([("k", i, w) for i, w in enumerate(weights)], "k string, i int, w int").repartition(3)
    got = [r["part"] for r in P.next_fit(df, "k", "i", "w", 40, empty).orderBy("i").collect()]
    assert got == greedy(weights, 40, empty)
    if empty:
        items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(w).alias("weight")) for i, w in enumerate(weights)])
        assert spark.range(1).select(P.next_fit_folded(items, 40).alias("p")).first()["p"] == got


def test_next_fit_oversize_and_null(spark):
    df = spark.createDataFrame([("k", 0, 5.0), ("k", 1, 100.0), ("k", 2, None), ("k", 3, 5.0)], "k string, i int, w double")
    assert pairs(P.next_fit(df, "k", "i", "w", 10), "i", "part") == [(0, 0), (1, 1), (2, 2), (3, 2)]


def test_budget_ends_at_the_first_overflow(spark):
    df = spark.createDataFrame([("k", 0, "a" * 90), ("k", 1, "b" * 101), ("k", 2, "c" * 95), ("k", 3, "d")], "k string, i int, t string")
    assert pairs(P.budgeted(df, ["k"], "i", "t", budget=180), "i") == [(0,)]


def test_rate_limit_is_the_recurrence(spark):
    rng = random.Random(3)
    times = sorted(rng.random() * 50 for _ in range(40))
    want, last = [], None
    for t in times:
        last = t if last is None else max(t, last + 2.0)
        want.append(last)
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "k string, i int, t double")
    got = [r["slot"] for r in O.rate_limited(df, ["k"], ["i"], "t", 2.0).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_as_of_takes_the_last_start(spark):
    left = spark.createDataFrame([("a", 0.5), ("a", 1.0), ("a", 9.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30)], "k string, s double, v int")
    got = {(r["k"], r["t"]): r["v"] for r in O.as_of(left, right, ["k"], "t", "s", "v").collect()}
    assert got == {("a", 0.5): None, ("a", 1.0): 10, ("a", 9.0): 30, ("b", 1.0): None}


def test_nearest_interval_prefers_then_distance_then_first(spark):
    points = spark.createDataFrame([("a", 5)], "k string, at int")
    iv = spark.createDataFrame([("a", 0, 0, 4, False), ("a", 1, 10, 12, True), ("a", 2, 8, 9, True), ("a", 3, 1, 2, True)], "k string, idx int, lo int, hi int, preferred boolean")
    assert pairs(O.nearest_interval(points, iv, ["k"], "at", []), "idx", "distance") == [(2, 3)]


@pytest.mark.parametrize("few", [1, 1024])
def test_nearest_interval_is_that_of_all_pairs(spark, few, monkeypatch):
    monkeypatch.setattr(O, "_FEW_HELD", few)
    rng = random.Random(7)
    iv, points = [], [("none", 1, 4.0), ("k0", 98, None)]
    for k in range(6):
        for i in rng.sample(range(50), 12):
            lo = rng.randrange(60) / 2
            iv.append((f"k{k}", i, lo, lo + rng.choice([0, 1, 3, 20, 0.5]), k % 3 == 0 or (k % 3 == 1 and rng.random() < 0.3)))
        points += [(f"k{k}", n, rng.randrange(80) / 2 - 2) for n in range(40)]
    points += points[5:9]
    want = {}
    for k, n, at in points:
        own = [(not p, max(0.0, lo - at, at - hi), i) for j, i, lo, hi, p in iv if j == k and at is not None]
        if own:
            want[k, n, at] = min(own)[:0:-1]
    got = O.nearest_interval(spark.createDataFrame(points, "k string, n int, at double"), spark.createDataFrame(iv, "k string, idx int, lo double, hi double, preferred boolean"), ["k"], "at", ["n"]).collect()
    assert len(got) == len(want) == 240 and {(r["k"], r["n"], r["at"]): (r["idx"], r["distance"]) for r in got} == want


def test_unique_names_runs_and_medians(spark):
    df = spark.createDataFrame([("k", 0, "a"), ("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a")], "k string, i int, n string")
    assert [r["u"] for r in O.unique_names(df, ["k"], ["i"], "n", "u").orderBy("i").collect()] == ["a", "a (2)", "b", "a (3)"]
    assert pairs(O.last_of_runs(df, ["k"], ["i"], "n"), "i") == [(1,), (2,), (3,)]
    nums = spark.createDataFrame([("k", v) for v in (4, 1, 3, 2)], "k string, v int")
    assert pairs(O.upper_median(nums, ["k"], "v"), "median") == [(3,)]


def test_pages_clamp(spark):
    assert [r[0] for r in O.page(spark.range(25), ["id"], 99, 10).collect()] == [20, 21, 22, 23, 24]


def test_halved_scenes(spark):
    df = spark.createDataFrame([("s", 0, 3, [0.0, 20.0, 40.0, 60.0], 70.0)], "id string, first long, last long, starts array<double>, ends double")
    assert pairs(P.halved_scenes(df), "first", "last") == [(0, 0), (1, 1), (2, 3)]


def test_throttle(spark):
    data = [("k", 1, 0.0, "a", False), ("k", 2, 0.1, "a", False), ("k", 3, 0.12, "b", False), ("k", 4, 0.2, "b", False), ("k", 5, 0.3, "b", False), ("k", 6, 0.31, "b", True)]
    df = spark.createDataFrame(data, "k string, event_id int, at double, phase string, final boolean")
    assert pairs(S.throttled(df, "k", "at", "phase", "final", 0.15), "event_id") == [(1,), (3,), (5,), (6,)]
