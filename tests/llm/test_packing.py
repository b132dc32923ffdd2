import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spotframe.llm import packing

TEXTS = ["a b,c  d_1 -- é9", "", "   ", None, "x" * 3000, "one two " * 40, "…!? ½ 東京 z​q", "a\nb\tc\r\nd"]


def test_token_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: r.n for r in df.select("id", packing.word_tokens(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else len(regex.findall(packing.TOKEN, t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("capacity", [1, 3, 7, 100])
def test_split_round_trip(capacity):
    for t in filter(None, TEXTS):
        parts = packing.split_text(t, capacity)
        n = [len(regex.findall(packing.TOKEN, p)) for p in parts]
        assert "".join(parts) == t and max(n) <= capacity and all(x == capacity for x in n[:-1])


def boundaries_cost(lengths, counts, bounds):
    up = np.array(bounds)[np.searchsorted(bounds, lengths)]
    return ((up - lengths) * counts).sum()


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(1)
    lengths, counts = np.sort(rng.choice(np.arange(1, 60), 9, replace=False)), rng.integers(1, 50, 9)
    for k in (1, 2, 3, 4):
        got = packing.bucket_boundaries(lengths, counts, 64, k)
        best = min(boundaries_cost(lengths, counts, sorted({*c, int(lengths[-1])})) for c in combinations(lengths.tolist(), k - 1)) if k > 1 else boundaries_cost(lengths, counts, [int(lengths[-1])])
        assert len(got) <= k and boundaries_cost(lengths, counts, got) == best


def check(rows, items, capacity):
    load, seen = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.length
        seen.setdefault(r.id, []).append((r.piece, r.length))
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(len(load)))
    for i, n in items:
        if n:
            got = sorted(seen.pop(i))
            assert [p for p, _ in got] == list(range(-(-n // capacity))) and sum(x for _, x in got) == n and all(x == capacity for _, x in got[:-1])
    assert not seen
    return load


def test_packing_is_whole_and_full(spark):
    rng = np.random.default_rng(3)
    items = [(i, int(n)) for i, n in enumerate(np.r_[rng.lognormal(4, 1, 400).astype(int), np.full(200, 40), [5000, 256, 257, 0]])] + [(9999, None)]
    df = spark.createDataFrame(items, "id long, n_tokens long")
    load = check(packing.pack(df, 256).collect(), items, 256)
    total = sum(n or 0 for _, n in items)
    assert len(load) <= 1.02 * total / 256 + 1


def test_same_result_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, i % 7 + 1) for i in range(60)], "id long, n_tokens long")
    a, b = (sorted(map(tuple, packing.pack(df.repartition(n), 10).collect())) for n in (1, 5))
    assert a == b


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens long"), 10).count() == 0


def test_boundaries_among_all_lengths():
    rng = np.random.default_rng(5)
    lengths = np.arange(1, 1501)
    counts = rng.integers(1, 3, 1500)
    best = np.r_[0, np.full(1500, np.inf)]
    n, t = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(lengths * counts)]
    for _ in range(4):
        best = np.array([0, *[(best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (t[j] - t[:j])).min() for j in range(1, 1501)]])
    assert boundaries_cost(lengths, counts, packing.bucket_boundaries(lengths, counts, 2048, 4)) == best[-1]


def containers(plan):
    """Lengths in each container."""
    out = {}
    for length, a, b, per, first in plan.itertuples(index=False):
        for k in range((b - a) // per):
            out.setdefault(first + k, []).extend([length] * per)
    return sorted(sorted(v) for v in out.values())


def test_boundaries_decide_who_shares_a_container():
    lengths, counts = np.array([60, 50, 40, 1]), np.array([2, 2, 2, 40])
    plan = lambda bounds: containers(packing.packing_plan(lengths, counts, 100, bounds))
    ones = [1] * 40
    assert plan([60]) == sorted([[50, 50], [40, 60], [40, 60], [1] * 40])
    # no more containers if only the ones are held back: each bucket's batches are its own
    assert plan([1, 40, 50, 60]) == sorted([[1] * 20 + [40, 40], [50, 50], [60], [1] * 20 + [60]])


def test_no_more_containers_than_best_fit_over_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = np.sort(rng.choice(np.arange(1, 200), 40, replace=False))
        counts = rng.integers(1, 30, 40)
        bounds = packing.bucket_boundaries(lengths, counts, 200, 6)
        n = [len(containers(packing.packing_plan(lengths, counts, 200, b))) for b in (bounds, [int(lengths[-1])])]
        assert n[0] <= n[1]
