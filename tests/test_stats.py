import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.functions import exprs
from spotframe.operators import features, search, stats


def test_rank_statistics_against_pairs(spark):
    rng = random.Random(2)
    vals = {"control": [rng.randrange(20) / 2 for _ in range(40)], "a": [rng.randrange(20) / 2 + 1 for _ in range(25)], "b": [1.0, 2.0], "c": [3.0] * 5}
    rows = [(g, v) for g, vs in vals.items() for v in vs] + [("a", None), ("a", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "grp string, value double").withColumn("feature", F.lit("f"))
    got = {r.grp: r for r in stats.rank_statistics(df, "control", ["feature"]).collect()}
    for g in ("a", "c"):
        a, b = vals[g], vals["control"]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert got[g].u == u and got[g].cliffs_delta == pytest.approx(2 * u / len(a) / len(b) - 1) and -1 <= got[g].cliffs_delta <= 1
        both = np.array(a + b)
        ties = sum(c**3 - c for c in np.unique(both, return_counts=True)[1])
        n, m = len(a), len(b)
        sd = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
        d = u - n * m / 2
        assert got[g].z == pytest.approx(math.copysign(max(abs(d) - 0.5, 0), d) / sd)
    assert got["b"].cliffs_delta is None and got["b"].na == 2


def test_fully_tied_samples_have_no_z(spark):
    df = spark.createDataFrame([(g, 1.0, "f") for g in ("control", "a") for _ in range(4)], "grp string, value double, feature string")
    r = stats.rank_statistics(df, "control", ["feature"]).first()
    assert r.cliffs_delta == 0 and r.z is None


def test_bh(spark):
    p = [0.01, 0.02, 0.02, 0.5, None, float("nan"), 0.9]
    df = spark.createDataFrame([("g", x) for x in p] + [("h", 0.04)], "g string, p double")
    got = sorted((r.p, r.padj) for r in stats.bh_adjust(df, ["g"], "p").collect() if r.padj is not None and r.g == "g")
    ok = sorted(x for x in p if x is not None and x == x)
    m = len(ok)
    want = [min(min(ok[j] * m / (j + 1) for j in range(i, m)), 1) for i in range(m)]
    assert [a for a, _ in got] == ok and [b for _, b in got] == pytest.approx([min(w for w, x in zip(want, ok) if x == o) for o in ok])


def test_p_values(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (None,)], "z double")
    assert [r[0] for r in df.select(stats.two_sided_p("z")).collect()] == [1.0, pytest.approx(0.05, abs=1e-6), None]


def test_correlation_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, None, 5.0), (4.0, 7.9, 5.0), (float("nan"), 1.0, 5.0)], "a double, b double, c double").withColumn("g", F.lit(1))
    got = {(r.f1, r.f2): r.r for r in stats.correlation_matrix(df, ["g"], ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4.1, 7.9])[0, 1]) and got["a", "b"] == got["b", "a"] and got["a", "a"] == pytest.approx(1) and ("c", "c") not in got


def test_composition_cv_and_scores(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None), (None, "x")], "g string, t string")
    assert {(r.g, r.t, round(r.share, 6)) for r in stats.composition(df, "g", "t").collect()} == {("a", "x", 0.666667), ("a", "y", 0.333333)}
    v = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0), (3, -1.0), (3, 1.0)], "g int, v double").groupBy("g").agg(stats.coefficient_of_variation(F.col("v")).alias("cv"))
    got = {r.g: r.cv for r in v.collect()}
    assert got[1] == pytest.approx(math.sqrt(2) / 3) and got[2] is None and got[3] is None
    z = stats.z_scores(spark.createDataFrame([(1, 1.0, 7.0), (2, float("nan"), 7.0), (3, None, 7.0)], "i int, a double, b double"), ["i"], ["a", "b"]).orderBy("i").collect()
    assert [r.a for r in z] == pytest.approx([math.sqrt(2), -1 / math.sqrt(2), -1 / math.sqrt(2)]) and {r.b for r in z} == {0.0}


def test_score_shapes(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 2.5, 5.0, 20.0, 40.0, 2000.0, None)], "x double")
    r = [x[0] for x in df.select(exprs.range_score(F.col("x"), 5, 20)).collect()]
    b = [x[0] for x in df.select(exprs.bump_score(F.col("x"), 5, 20)).collect()]
    assert r == [0, 0, pytest.approx(0.5**1.5), 1, 1, 0.5, 0.01, None] and b == [0, 0, pytest.approx(1 - math.log10(2)), 1, 1, pytest.approx(1 - math.log10(2)), 0, None]


def test_text_and_sequence_expressions(spark):
    one = spark.range(1)
    get = lambda *c: tuple(one.select(*c).first())
    assert get(exprs.slug(F.lit(" The Quick--Fox! ")), exprs.tokens(F.lit("A a, b-1 B")), exprs.tokens(F.lit(None))) == ("the-quick-fox", ["a", "b", "1"], [])
    assert get(exprs.reverse_complement(F.lit("AAcgTN"))) == ("NAcgTT",)
    assert get(exprs.masked(F.lit("abcdef"), F.lit(2), F.lit(3)), exprs.masked(F.lit("abc"), F.lit(5), F.lit(9))) == ("annd" + "ef", "abc")
    assert get(exprs.snippet(F.lit("a |  b\nc"), 40), exprs.snippet(F.lit("abcdef"), 4)) == ("a \\| b c", "abc…")
    assert get(exprs.headings(F.lit("# One\ntext\n### Two"))) == (["One", "Two"],)
    assert get(exprs.plate(F.lit(96)), exprs.plate(F.lit(97)), exprs.spot_id(F.lit(7), F.lit("M"), F.lit(12))) == (1, 2, "fov007_M_12")
    assert get(exprs.wavelengths(F.lit("conv_750_647_v2_20210101_405s900"))) == (["750", "647", "405"],)
    assert get(F.size(exprs.monomials(F.lit(2.0), F.lit(3.0), F.lit(5.0))), exprs.monomials(F.lit(2.0), F.lit(3.0), F.lit(5.0), 1)) == (20, [1.0, 2.0, 3.0, 5.0])
    assert get(exprs.equivalent_diameter(F.lit(-1.0)), exprs.safe_ratio(F.lit(1.0), F.lit(0.0))) == (0.0, None)


def test_bead_flag_bounds(spark):
    df = spark.createDataFrame([("A", 10.0, 1.0), ("A", 9.9, 5.0), ("B", 10.0, 0.9), ("B", 10.0, 1.0), ("C", 99.0, 9.0), ("A", None, 1.0), ("A", float("nan"), 1.0), ("B", 10.0, None)], "marker string, i double, d double")
    got = [r[0] for r in df.select(features.bead_flag(F.col("i"), F.col("d"), {"A": 10, "B": 10}, {"B": 1.0})).collect()]
    assert got == [True, False, False, True, False, False, False, False]


def test_nucleus_features_of_none_one_and_bead_spots(spark):
    spots = spark.createDataFrame(
        [(1, 1, "m", 2.0, 10.0, 40.0, False, 5.0), (1, 1, "m", 4.0, 10.0, 60.0, False, 7.0), (1, 1, "m", 9.0, 99.0, 500.0, True, 9.0), (1, 2, "m", 3.0, 1.0, 30.0, False, 1.0), (1, 0, "m", 1.0, 1.0, 1.0, False, 1.0)],
        "fov int, nucleus int, marker string, volume double, intensity double, integrated double, is_bead boolean, local_dapi double",
    )
    nuclei = spark.createDataFrame([(1, 1, 100.0, 50), (1, 2, 0.0, 10), (1, 3, None, None)], "fov int, nucleus int, nucleus_volume_um3 double, volume_vox int")
    totals = spark.createDataFrame([(1, 1, "m", 900.0), (1, 2, "m", 20.0)], "fov int, nucleus int, marker string, total double")
    got = {r.nucleus: r for r in features.nucleus_marker_features(spots, nuclei, totals, ["m"], 0.5).collect()}
    one, two, none = got[1], got[2], got[3]
    # total 900 - 500 of the bead; 12 voxels of spots, 38 beside them
    assert (one.n_foci, one.n_beads, one.density_per_um3, one.vol_mean, one.vol_median) == (2, 1, 0.02, 3.0, 3.0)
    assert one.vol_cv == pytest.approx(2**0.5 / 3) and one.condensed_fraction == pytest.approx(100 / 400) and one.local_dapi == 6
    assert one.partition_coefficient == pytest.approx((100 / 12) / (300 / 38))
    # less image than spots: the spots are the total; one spot has no spread; no volume, no density
    assert (two.condensed_fraction, two.partition_coefficient, two.vol_cv, two.density_per_um3) == (1.0, None, None, 0.0)
    assert (none.n_foci, none.vol_mean, none.vol_median, none.vol_cv, none.condensed_fraction, none.mean_intensity, none.local_dapi) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, None)


def test_coloc_radius_is_strict(spark):
    nn = spark.createDataFrame([(1, 1, 1.0), (1, 1, 0.5), (1, 1, None)], "fov int, nucleus long, nn_dist double")
    n = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0)], "fov int, nucleus long, nucleus_volume_um3 double")
    p = spark.createDataFrame([(1, 1)], "fov int, nucleus long")
    got = {r.nucleus: r for r in features.coloc_features(nn, p, n, 1.0).collect()}
    assert got[1].frac == 0.5 and got[1].enrich == pytest.approx(0.5 / (4 / 3 * math.pi / 100)) and got[2].frac is None and got[2].enrich is None


def test_nearest_of_every_ordered_pair(spark, monkeypatch):
    from spotframe.plans import measurements as m

    rows = [(1, 1, 5, "Brd4", False, 0.0), (2, 1, 5, "Pol2", False, 3.0), (3, 1, 5, "Sc35", True, 1.0), (4, 1, 5, "Sc35", False, 2000.0), (5, 1, 0, "DAPI", False, 0.0), (6, 2, 5, "DAPI", False, 0.0)]
    s = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "focus_id long, fov int, nucleus long, marker string, is_bead boolean, z double, y double, x double")
    monkeypatch.setattr(m, "spots", lambda *_: s)
    got = {(r.focus_id, r.b): r.nn_dist for r in m.nearest_neighbor_all_pairs(spark, "").collect()}
    near = {(1, "Pol2"): 3.0, (1, "Sc35"): 2000.0, (2, "Brd4"): 3.0, (2, "Sc35"): 1997.0, (3, "Brd4"): 1.0, (3, "Pol2"): 2.0, (4, "Brd4"): 2000.0, (4, "Pol2"): 1997.0}
    assert got == {(i, b): near.get((i, b)) for i, _, n, a, *_ in rows if n for b in m.MARKERS if b != a}
    n = spark.createDataFrame([(1, 5, 100.0, 1)], "fov int, nucleus long, nucleus_volume_um3 double, kept int")
    monkeypatch.setattr(m, "nuclei", lambda *_: n)
    assert {(r.a, r.b): (r.n_partners, r.nn_um) for r in m.coloc_fraction_all_pairs(spark, "").collect()} == {("Brd4", "Pol2"): (1, 3.0), ("Pol2", "Sc35"): (1, 1997.0), ("Brd4", "Sc35"): (1, 2000.0)}


def test_clipping_and_defaults(spark):
    specs = spark.createDataFrame([(1, "wavelet"), (2, "mean_fold")], "i int, family string")
    params = spark.createDataFrame([(1, "levels", "9-9"), (1, "k", "7.5"), (1, "nonsense", "1"), (2, "threshold", "0.1"), (2, "min_size", "12.9")], "i int, param string, val string")
    got = {(r.i, r.param): (r.num, r.text, r.defaulted) for r in search.clip_with_defaults(specs, params, ["i"]).collect()}
    assert got[1, "levels"] == (None, "1-2", False) and got[1, "k"] == (5.0, None, False) and got[1, "watershed"] == (None, "true", True)
    assert got[2, "threshold"] == (1.05, None, False) and got[2, "min_size"] == (12.0, None, False) and got[2, "max_size"] == (20200.0, None, True) and (1, "nonsense") not in got


def test_convergence_and_halving(spark):
    b = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.105), ("a", 3, 0.3), ("b", 1, 0.6), ("b", 2, 0.5)], "arm string, round int, best double")
    assert {(r.arm, r["round"]): r.converging for r in search.convergence(b, ["arm"]).collect()} == {("a", 1): True, ("a", 2): False, ("a", 3): True, ("b", 1): True, ("b", 2): True}
    r = spark.createDataFrame([(1, 2, 0.5, 0.1), (2, 2, 0.5, 0.9), (3, 2, None, 0.9), (4, 2, 0.4, None)], "i int, round int, s double, c double").withColumn("run", F.lit("r"))
    assert {x.i: (x.rk, x.keep) for x in search.halving(r, ["run"], "s", "c", "i").collect()} == {2: (1, True), 1: (2, True), 4: (3, True), 3: (4, False)}


def test_group_percentiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(30) / 4) for _ in range(200)] + [("one", 2.0), ("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p0, r.p33, r.p100) for r in stats.group_percentiles(df, ["g"], "v", {"p0": 0.0, "p33": 0.333, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, q in got.items():
        x = [v for h, v in rows if h == g and v is not None and v == v]
        assert q == pytest.approx(tuple(np.percentile(x, [0, 33.3, 100])))
    assert stats.group_percentiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_noise_of_all_values_and_of_the_background(spark):
    rows = [("a", float(x)) for x in [1, 2, 3, 4, 100, 200, 300]] + [("b", 5.0)] * 3 + [("c", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    noise = {r.g: r for r in stats.robust_noise(df, ["g"], "v").collect()}
    # deviations about the median 4: 3 2 1 0 96 196 296
    assert noise["a"].median == 4 and noise["a"].mad == pytest.approx(3 * 1.4826) and noise["b"].mad == 1 and set(noise) == {"a", "b"}
    low = {r.g: r.noise for r in stats.background_noise(df, ["g"], "v").collect()}
    # 1 2 3 4 about 2.5: 1.5 0.5 0.5 1.5
    assert low["a"] == pytest.approx(1.4826) and low["b"] == 1


def test_large_groups_take_slots_with_the_same_result(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, float(i * i % 101)) for i in range(400)], "g string, v double")
    few, many = ({r.g: (r.p, r.q) for r in stats.group_percentiles(df, ["g"], "v", {"p": 0.37, "q": 0.9}, most=m).collect()} for m in (5, 1000))
    assert set(few) == set(many) == {"a", None} and all(few[g] == pytest.approx(many[g]) for g in few)


def test_a_spot_is_huge_against_the_median_nucleus(spark):
    cells = spark.createDataFrame([("m", 1, 0.1, 100.0), ("m", 3, 0.3, 200.0), ("m", 5, 0.2, 1000.0)], "g string, count int, fill double, volume double")
    sizes = spark.createDataFrame([("m", 2.0, 1.0), ("m", 3.0, 2.0), ("m", 10.0, 3.0), ("m", 10.5, 4.0)], "g string, size double, contrast double")
    r = search.proxy_score(cells, sizes, ["g"]).first()
    assert (r.median_count, r.median_fill, r.median_nucleus, r.median_vol, r.median_contrast) == (3, 0.2, 200, 6.5, 2.5)
    assert (r.frac_tiny, r.frac_huge) == (0.25, 0.25)


def test_count_band(spark):
    df = spark.createDataFrame([("m", 10.0, 0.9, 1), ("m", 5.0, 0.1, 2), ("m", 20.5, None, 3), ("m", None, 0.95, 4), ("n", None, None, 5)], "g string, c double, s double, i int")
    assert {r.i: r.in_band for r in search.count_band(df, ["g"], "c", "s", "i").collect()} == {1: True, 2: True, 3: False, 4: None, 5: None}


def test_merged_params(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3) AS y")
    assert df.select(search.merged_params(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 3}
