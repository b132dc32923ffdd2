import random

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spotframe.operators import intervals, joins

SCHEMA = "k string, a long, b long"


def brute(rows):
    out = set()
    for key in {r[0] for r in rows}:
        xs = sorted((min(a, b), max(a, b)) for k, a, b in rows if k == key and a is not None and b is not None and a != b)
        merged = []
        for s, e in xs:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "merged", s, e) for s, e in merged}
        out |= {(key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in intervals.merge_intervals(df, ["k"], "a", "b", **kw).collect()}


def test_edge_cases(spark):
    rows = [("x", 1, 5), ("x", 5, 7), ("x", 9, 8), ("x", None, 3), ("x", 4, 4), ("x", 1, 5), ("y", 3, None), (None, 1, 2), (None, 4, 6), ("z", 10, 20), ("z", 12, 15)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()


def test_hot_key_is_cut_into_slots(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", a := rng.randrange(5000), a + rng.randrange(-3, 9)) for _ in range(3000)]
    assert run(spark, rows, slot_rows=50) == brute(rows) == run(spark, rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=30))
def test_any_intervals(spark, rows):
    assert run(spark, rows, slot_rows=4) == brute(rows)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("x", 1, 5, 0, "u"), ("x", 4, 9, 1, "v")], "k string, a long, b long, slot int, s string")
    assert {tuple(r) for r in intervals.merge_intervals(df, ["k"], "a", "b").collect()} == {("x", "merged", 1, 9)}


def test_latest_rows_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, None, "b"), (2, None, None)], "id int, t int, v string")
    assert sorted(map(tuple, intervals.latest_rows(df, ["id"], "t").collect())) == [(1, 5, "a"), (2, None, None)]


def test_overlap_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i, s := rng.randrange(500), s + rng.randrange(0, 60)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, i int, s int, e int")
    got = {(r.k, r.a, r.b, r.overlap_len) for r in joins.overlap_pairs(df, ["k"], "i", "s", "e", 16).collect()}
    want = {(k, i, j, min(e, f) - max(s, t)) for k, i, s, e in rows for m, j, t, f in rows if k == m and i < j and max(s, t) < min(e, f) and s < e and t < f}
    assert got == want


@pytest.mark.parametrize("touch", [True, False])
def test_touching_windows_do_not_overlap(spark, touch):
    df = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10 if touch else 9, 20)], "k int, i int, s int, e int")
    assert joins.overlap_pairs(df, ["k"], "i", "s", "e", 7).count() == (0 if touch else 1)


def test_range_lookup_bounds_gaps_and_first_match(spark):
    r = spark.createDataFrame([("a", 0, 3), ("b", 3, 5), ("c", 8, 9), ("d", None, 4)], "name string, lo int, hi int")
    df = spark.createDataFrame([(v,) for v in (0, 3, 4, 5, 6, 8, None)], "v int")
    assert {x.v: x.name for x in joins.range_lookup(df, "v", r, "lo", "hi", ["name"]).collect()} == {0: "a", 3: "a", 4: "b", 5: "b", 6: None, 8: "c", None: None}


@pytest.mark.parametrize("few", [4, 64])
def test_nearest_matches_brute_force(spark, few):
    rng = random.Random(7)
    p = lambda: (rng.randrange(2), *[rng.uniform(0, 40) for _ in range(3)])
    left, right = [p() for _ in range(60)] + [(0, None, 1.0, 1.0), (5, 1.0, 1.0, 1.0)], [p() for _ in range(25)]
    s = "k int, z double, y double, x double"
    got = joins.nearest(spark.createDataFrame(left, s), spark.createDataFrame(right, s), ["k"], ["z", "y", "x"], few=few).collect()
    assert len(got) == len(left)
    for r in got:
        ds = [sum((u - v) ** 2 for u, v in zip((r.z, r.y, r.x), q[1:])) ** 0.5 for q in right if q[0] == r.k] if r.z is not None else []
        assert (r.nn_dist is None) == (not ds) and (not ds or abs(r.nn_dist - min(ds)) < 1e-9)


def test_a_partner_far_away_is_found(spark):
    right = [(0, float(i), 0.0, 0.0) for i in range(10)]
    df = lambda rows: spark.createDataFrame(rows, "k int, z double, y double, x double")
    got = joins.nearest(df([(0, -20_000.0, 0.0, 0.0), (0, 5.25, 0.0, 0.0)]), df(right), ["k"], ["z", "y", "x"], few=3).collect()
    assert sorted(r.nn_dist for r in got) == [0.25, 20_000.0]


def test_nearest_match_gives_the_partner(spark):
    df = lambda rows: spark.createDataFrame(rows, "f int, i string, z double, y double, x double")
    left = [(1, "a", 0.0, 0.0, 0.0), (1, "b", 0.0, 50.0, 0.0), (1, "c", 0.0, None, 0.0), (2, "d", 0.0, 0.0, 0.0)]
    right = [(1, "q", 0.0, 3.0, 4.0), (1, "p", 3.0, 4.0, 3.0), (1, "deep", 3.5, 0.0, 0.0), (1, "far", 0.0, 56.0, 0.0), (1, "bad", float("nan"), 0.0, 0.0)]
    got = joins.nearest_match(df(left), df(right), ["f"], "i", 5.0, ["y", "x"], "z").collect()
    assert [tuple(r) for r in got] == [(1, "a", "p", 5.0)]


def test_lookup_fails_for_a_missing_name(spark):
    names = spark.createDataFrame([("a", 2), ("a", 1)], "n string, v int")
    df = lambda n: spark.createDataFrame([(n,)], "n string")
    assert joins.lookup(df("a"), names, "n", "v", "value").first().v == 1
    with pytest.raises(Exception, match="no value for b"):
        joins.lookup(df("b"), names, "n", "v", "value").collect()


def test_first_zone(spark):
    zones = spark.createDataFrame([(1, 0, 10, 0, 5), (1, 5, 20, 1, -1), (1, 30, 40, 2, 7)], "k int, lo int, hi int, o int, r long")
    pts = spark.createDataFrame([(1, 1, 10), (2, 1, 11), (3, 1, 25), (4, 1, 30), (5, 2, 5)], "i int, k int, p int")
    got = joins.first_zone(pts, ["i"], "p", zones, ["k"], "lo", "hi", ["o"], "r", 8.0)
    assert {x.i: x.r for x in got.collect()} == {1: 5, 3: None, 4: 7, 5: None}


def test_nearest_group(spark):
    g = spark.createDataFrame([("c", "p", 100.0, 110.0, False), ("c", "e1", 0.0, 50.0, True), ("c", "e2", 160.0, 170.0, True), ("c", "q", 900.0, 901.0, False), ("d", "r", 0.0, 1.0, False)], "k string, t string, lo double, hi double, e boolean")
    got = {r.t: (r.nearest, r.gap) for r in joins.nearest_group(g, "k", "t", "lo", "hi", "e", 200.0).collect()}
    assert got == {"p": ("e1", 50.0)}


@pytest.mark.parametrize("rows", [10, 1000])
def test_running_total(spark, rows):
    df = spark.createDataFrame([("a", float(i), 1) for i in range(50)] + [("b", 1.0, 4)], "g string, o double, n int")
    got = {(r.g, r.o): r.t for r in joins.running_total(df, ["g"], "o", "n", "t", slot_rows=rows, slots=8).collect()}
    assert got == {**{("a", float(i)): i + 1 for i in range(50)}, ("b", 1.0): 4}
    least = {(r.g, r.o): r.t for r in joins.running_least(df.withColumn("v", F.abs(F.col("o") - 20.0)), ["g"], "o", "v", "t", slot_rows=rows).collect()}
    assert least == {**{("a", float(i)): float(max(i - 20, 0)) for i in range(50)}, ("b", 1.0): 19.0}
