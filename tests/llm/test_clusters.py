import numpy as np
from pyspark.sql import functions as F
from spotframe.llm import clusters

XS = ["x0", "x1", "x2"]
FIELDS = ["a", "b", "c"]


def brute(points, tol=0.02):
    ids, x = [p[0] for p in points], np.array([p[1:] for p in points], float)
    near = [(np.abs(x - r) <= tol * np.maximum(np.abs(x), np.abs(r))).all(1).nonzero()[0].tolist() for r in x]
    return {(ids[i], min(ids[j] for j in near[i])) for i in range(len(x)) if len(near[i]) >= 3 and all(near[j] == near[i] for j in near[i])}


def run(spark, points, **kw):
    df = spark.createDataFrame(points, "id long, a double, b double, c double")
    runs = clusters.clean_points(df, "id", FIELDS)
    leaves = clusters.bisect_clusters(runs.groupBy(*XS).agg(F.count("*").alias("copies"), F.min("id").alias("first_id")), XS, **kw)
    boxes = clusters.leaf_table(leaves, XS).collect()
    assert all(r[f"hi{i}"] - r[f"lo{i}"] <= 0.02 * max(abs(r[f"hi{i}"]), abs(r[f"lo{i}"])) for r in boxes for i in range(3))
    found = leaves.join(clusters.isolated_clusters(leaves, XS), "leaf")
    ids = found.groupBy("cluster").agg(F.min("first_id").alias("cid"))
    out = runs.join(found.join(ids, "cluster").select(*XS, "cid"), XS).select("id", "cid").collect()
    return {tuple(r) for r in out}


def sample(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre, size = np.exp(rng.uniform(-2, 1, 3)), rng.integers(1, 7)
        wide = rng.choice([0.004, 0.009, 0.015, 0.03])
        out += (centre * np.exp(rng.uniform(-wide, wide, (size, 3)))).tolist()
    return [(i, *p) for i, p in enumerate(out)]


def test_matches_brute_force(spark):
    points = sample(1, 60)
    assert run(spark, points) == brute(points) != set()


def test_dense_blob_copies_and_signs(spark):
    rng = np.random.default_rng(4)
    blob = (np.array([1.0, 2.0, 3.0]) * np.exp(rng.uniform(-0.03, 0.03, (150, 3)))).tolist()
    copies = [[5.0, 5.0, 5.0]] * 40 + [[0.0, 0.0, 0.0]] * 3 + [[-1.0, 2.0, 0.0], [-1.01, 2.0, 0.0], [-1.0, 2.01, 0.0]] + [[7.0, 7.0, 7.0]] * 2
    points = [(i, *p) for i, p in enumerate(blob + copies)]
    assert run(spark, points, local_rows=90) == brute(points)  # the top of the tree is split across the cluster


def test_a_point_near_the_box_but_near_no_member(spark):
    # a corner of the box of three is near the fourth point, no member is; with the fifth one is
    three = [(0, 1.0, 1.0, 1.0), (1, 1.019, 1.0, 1.0), (2, 1.0, 1.019, 1.0)]
    assert run(spark, [*three, (3, 1.038, 1.038, 1.0)]) == brute([*three, (3, 1.038, 1.038, 1.0)]) == {(0, 0), (1, 0), (2, 0)}
    more = [*three, (3, 1.038, 1.018, 1.0)]
    assert run(spark, more) == brute(more) == set()


def test_bad_values_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0), (4, nan, 1.0, 1.0), (5, inf, 1.0, 1.0), (None, 1.0, 1.0, 1.0)]
    few = clusters.clean_points(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", FIELDS)
    assert sorted(r.id for r in few.collect()) == [1, 2]
    assert run(spark, [*rows, (6, 1.0, 1.0, 1.0)]) == {(1, 1), (2, 1), (6, 1)}
    assert run(spark, []) == set()


def test_typical_members_are_nearest_the_centre(spark):
    df = spark.createDataFrame([("l", i, float(v), 1.0, 1.0) for i, v in enumerate([1, 2, 3, 4, 10])], "leaf string, id long, x0 double, x1 double, x2 double")
    assert [(r.rank, r.id) for r in clusters.typical_members(df, XS).orderBy("rank").collect()] == [(1, 3), (2, 2), (3, 1)]


def test_latest_of_a_repeated_key_counts(spark):
    df = spark.createDataFrame([(1, 1.0, 5), (1, 2.0, 9), (1, 3.0, None)], "id long, a double, t int")
    assert [tuple(r) for r in clusters.clean_points(df, "id", ["a"], by="t").collect()] == [(1, 2.0)]
