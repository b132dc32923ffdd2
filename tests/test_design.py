import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotframe.operators import cards, geometry, matrix, panel, voxels
from spotframe.session import cut
from spotframe.sources import files
from spotframe.streaming import ingest


def test_windows(spark):
    f = spark.createDataFrame([("E1_A", "E", "+", 100, 301, None, "n"), ("E2_A", "E", "+", 0, 10_000, None, None), ("P_A", "P", "+", 50, 90, 60, None), ("P_B", "P", "-", 50, 90, 60, None), ("P_C", "P", "-", 50, 90, None, None)], "name string, type string, strand string, s long, e long, tss long, note string")
    got = {r.name: (r.dna_s, r.dna_e, r.tss_off, r.note) for r in panel.feature_windows(f).collect()}
    assert got["E1_A"] == (201 - 5000, 201 + 5000, None, "n; window expanded 201bp->10kb") and got["E2_A"] == (0, 10_000, None, "")
    assert got["P_A"][:3] == (60 - 5000, 60 + 5000, 10) and got["P_B"][2] == -30 and got["P_C"][:2] == (50, 90)


def test_imaging_order_spreads_chromosomes(spark):
    rng = random.Random(1)
    rows = [("p", f"f{i}", rng.choice(["chr1", "chr1", "chr2", "chr3"]), i * 10) for i in range(60)] + [("q", "g1", "chr1", 2), ("q", "g0", "chr1", 1), ("q", "x", None, 1)]
    got = panel.imaging_order(spark.createDataFrame(rows, "panel string, name string, chr string, rna_s long"), "panel").orderBy("panel", "round").collect()
    p = [r for r in got if r.panel == "p"]
    assert [r["round"] for r in p] == list(range(1, 61)) and {r.name for r in p} == {f"f{i}" for i in range(60)}
    n = {c: sum(r.chr == c for r in p) for c in ("chr1", "chr2", "chr3")}
    repeats = sum(a.chr == b.chr for a, b in zip(p, p[1:]))
    assert repeats == max(0, 2 * max(n.values()) - 60 - 1)
    for c in n:
        at = [int(r.name[1:]) for r in p if r.chr == c]
        assert at == sorted(at)
    assert [r.name for r in got if r.panel == "q"] == ["g0", "g1"]
    s = panel.readout_scheme(panel.imaging_order(spark.createDataFrame(rows[:3], "panel string, name string, chr string, rna_s long"), "panel"), "panel").collect()
    assert sorted(r.readout for r in s) == [1, 2, 3, 97, 98, 99] and {r.plate for r in s if r.block == "DNA"} == {2}


def test_oligo_and_centre(spark):
    one = spark.range(1)
    r = one.select(panel.oligo(F.lit("ac"), F.lit("n"), F.lit("G"), F.lit("AAC"), F.lit("gt")).alias("o"), panel.probe_centre(F.lit(100), F.lit(200), F.lit(10), 20, F.lit(True)).alias("a"), panel.probe_centre(F.lit(100), F.lit(200), F.lit(10), 20, F.lit(False)).alias("b")).first()
    assert (r.o, r.a, r.b) == ("ACnGgttAC", 180.0, 120.0)


def test_cards(spark):
    c = spark.createDataFrame([("a", "fee harbour fee", ["X"], "method", "k"), ("b", "harbour", [], "note", "k"), ("c", "nothing", ["x"], "note", None), ("d", None, [], "biology", "z")], "name string, text string, tags array<string>, type string, link string")
    assert [(r.name, r.score) for r in cards.search(c, ["Fee harbour"], ["x"], 5).collect()] == [("a", 5), ("c", 3), ("b", 1)]
    assert cards.search(c, [], [], 5).count() == 4 and [r.name for r in cards.search(c, ["harbour"], [], 5, kind="note").collect()] == ["b"]
    assert [(r.name, r.hop) for r in cards.expand_links(cards.search(c, ["fee"], [], 1), c, "link", 9, ["note"]).collect()] == [("b", 1), ("a", 0)]
    out = cards.budget_render(cards.search(c, ["harbour"], [], 5), F.col("text"), [F.col("score").desc(), "name"], 17).select("block").collect()
    assert [r[0] for r in out] == ["fee harbour fee", "ha …"]
    new = spark.createDataFrame([("b", "new", ["t"], None, None), ("e", "e", [], "note", None)], "name string, text string, tags array<string>, type string, link string")
    got = {r.name: (r.text, r.tags, r.type) for r in cards.upsert(c, new, "name").collect()}
    assert got["b"] == ("new", ["t"], "note") and got["a"] == ("fee harbour fee", ["X"], "method") and len(got) == 5


def blob(seed=0, shape=(4, 24, 24), centres=((1, 6, 6), (2, 16, 15))):
    v = np.zeros(shape)
    z, y, x = np.indices(shape)
    for c in centres:
        v += 100 * np.exp(-((z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2) / (2 * 1.5**2))
    v[v < 1] = 0
    return v


def frame(spark, v):
    z, y, x = np.nonzero(v)
    return spark.createDataFrame([(1, int(a), int(b), int(c), float(v[a, b, c])) for a, b, c in zip(z, y, x)], "fov int, z int, y int, x int, v double")


def test_blur_and_projection_against_numpy(spark):
    v = blob()
    taps = voxels.gaussian_taps(0.8)
    got = {(r.z, r.y, r.x): r.v for r in voxels.blur(frame(spark, v), ["fov"], taps).collect()}
    want = np.apply_along_axis(lambda m: np.convolve(m, taps, "same"), 2, np.apply_along_axis(lambda m: np.convolve(m, taps, "same"), 1, v))
    assert max(abs(got.get((z, y, x), 0) - want[z, y, x]) for z in range(4) for y in range(24) for x in range(24)) < 1e-9
    mip = {(r.y, r.x): r.v for r in voxels.max_projection(frame(spark, v), ["fov"]).collect()}
    assert all(mip.get((y, x), 0) == v.max(0)[y, x] for y in range(24) for x in range(24))


@pytest.mark.parametrize("family", ["mean_fold", "mad_tophat", "log_dog", "h_dome", "otsu_adaptive", "wavelet"])
def test_every_detector_finds_both_blobs(spark, family):
    df = frame(spark, blob()).cache()
    kw = {"tophat_radius": 7, "noise_k": 3.0} if family == "mad_tophat" else {}
    fg = voxels.detect(df, ["fov"], family, **kw)
    props = voxels.region_properties(voxels.components(fg, ["fov"], full=True), ["fov"]).orderBy(F.col("max").desc()).limit(2).collect()
    assert sorted((round(r.cy), round(r.cx)) for r in props) == [(6, 6), (16, 15)]
    assert voxels.detect(df.limit(0), ["fov"], family).count() == 0


def test_components_basins_and_border(spark):
    df = frame(spark, blob())
    b = voxels.basins(df, ["fov"])
    assert {(r.to_z, r.to_y, r.to_x) for r in b.collect()} == {(1, 6, 6), (2, 16, 15)}
    m = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 1, 1.0), (1, 0, 1, 2, 1.0), (1, 0, 5, 5, 3.0), (1, 0, 9, 9, 1.0)], "fov int, z int, y int, x int, v double")
    six = {(r.y, r.x): r.label for r in voxels.components(m, ["fov"]).collect()}
    assert six[0, 0] == six[0, 1] != six[1, 2] and len(set(six.values())) == 4
    full = voxels.components(m, ["fov"], full=True)
    p = voxels.region_properties(full, ["fov"])
    assert {r.volume for r in p.collect()} == {3, 1} and [(r.cy, r.cx) for r in voxels.inner_labels(p, ["fov"]).collect()] == [(5.0, 5.0)]


def test_components_broadcast_no_voxels(spark):
    """26 shifts of a mask, and labels of one object, are far larger than the files that the planner sees."""
    mask = cut(spark.range(30_000).selectExpr("1 fov", "cast(id % 2 as int) z", "cast(id div 2 % 500 * 2 as int) y", "cast(id div 1000 as int) x", "1.0D v"))
    star = cut(spark.range(1, 300_000).selectExpr("0L a", "id b"))
    try:
        spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")  # a larger broadcast is an error; what is under 10m by its true size may take 32m
        got = voxels.region_properties(voxels.components(mask, ["fov"], full=True), ["fov"]).orderBy("label").collect()
        spark.conf.set("spark.sql.maxBroadcastTableSize", "8m")
        labels = matrix.connected_labels(star).groupBy("label").count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [(r.label, r.volume, r.min_y, r.max_y, r.max_x) for r in got] == [(i + 1, 60, 2 * i, 2 * i, 29) for i in range(500)]
    assert [tuple(r) for r in labels] == [(0, 300_000)]


def test_labels_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100) if i % 10 != 9] + [(500, 500)], "a int, b int")
    got = {r.node: r.label for r in matrix.connected_labels(e).collect()}
    assert got == {i: i - i % 10 for i in range(100)}


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6)) * [5, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<float>")
    got = {(r.query, r["rank"]): r.neighbour for r in matrix.nearest_vectors(df, df.where("id % 20 = 0"), "id", "v", 3, block_rows=2).collect()}
    f = np.float32(x).astype(float)
    for q in range(0, 90, 20):
        d = ((f - f[q]) ** 2).sum(1)
        d[q] = np.inf
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(d)[:3].tolist()
    pc = {r.id: r.pc for r in matrix.principal_components(df, "id", "v", 2).collect()}
    c = f - f.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    assert np.allclose(np.abs([pc[i] for i in range(90)]), np.abs(want), atol=1e-6)
    assert matrix.kmeans_tokens(df, "id", "v", 3).select("cluster").distinct().count() == 3


def test_fits(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 200, (120, 3))
    t = 3 + 0.5 * p[:, 0] - 0.01 * p[:, 1] * p[:, 2] / 10
    df = spark.createDataFrame([("g", *map(float, r), float(v)) for r, v in zip(p, t)] + [("g", None, 1.0, 1.0, 1.0)], "g string, x double, y double, z double, t double")
    fit = geometry.polynomial_fit(df, "g", ["x", "y", "z"], "t")
    res = geometry.fit_residuals(df.where("x IS NOT NULL"), fit, "g", ["x", "y", "z"], "t").first()
    assert res["mean"] < 1e-6 and res.ok and fit.first().n == 120
    a, (dx, dy) = 0.3, (4.0, -2.0)
    pairs = [("g", float(x), float(y), float(math.cos(a) * x - math.sin(a) * y + dx), float(math.sin(a) * x + math.cos(a) * y + dy)) for x, y, _ in p]
    r = geometry.rigid_fit(spark.createDataFrame(pairs, "g string, x double, y double, u double, v double"), ["g"]).first()
    assert (r.angle, r.dx, r.dy) == (pytest.approx(a), pytest.approx(dx), pytest.approx(dy))


def test_movies(spark, tmp_path):
    frames = np.arange(6 * 2 * 3, dtype=">u2").reshape(6, 2, 3)
    (tmp_path / "m.dax").write_bytes(frames.tobytes())
    (tmp_path / "m.inf").write_text("data type = 16 bit integers (big endian)\nframe dimensions = 3 x 2\nnumber of frames = 6\n")
    side = files.read_sidecars(spark, str(tmp_path / "*.inf"))
    p = files.read_planes(spark, str(tmp_path / "*.dax"), side, 2)
    got = {(r.channel, r.z): np.frombuffer(r.pixels, "<u2").tolist() for r in p.collect()}
    assert got == {(i % 2, i // 2): frames[i].ravel().tolist() for i in range(6)}
    v = files.plane_voxels(p.where("channel = 1"), ["channel"])
    assert v.count() == 18 and v.agg(F.sum("v")).first()[0] == frames[1::2].sum()
    assert files.trimmed(p, ["channel"], 1).select("z").distinct().collect()[0].z == 1
    with pytest.raises(Exception, match="frames"):
        files.read_planes(spark, str(tmp_path / "*.dax"), side, 4).collect()
    (tmp_path / "bad.inf").write_text("number of frames = 6")
    with pytest.raises(Exception, match="field missing"):
        files.read_sidecars(spark, str(tmp_path / "bad.inf")).collect()


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("﻿name\tchr\tstart\nE1\tchr1\t5\nP\tchr2\t7\n".encode())
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.tsv"), "name string, chr string, start long", "\t", "name").collect()] == [("E1", "chr1", 5), ("P", "chr2", 7)]
    d = tmp_path / "cards" / "sub"
    d.mkdir(parents=True)
    (d / "x.md").write_text("---\nname: X card\ntype: method\ntags: [a, b]\nlinks: []\ndescription: d\n---\n# Body\ntext")
    (tmp_path / "cards" / "x.md").write_text("---\nname: other\ntype: note\ntags: []\nlinks: [y]\ndescription: e\n---\nz")
    (tmp_path / "cards" / "none.md").write_text("no front matter")
    c = files.read_cards(spark, str(tmp_path / "cards"))
    assert sorted((r.name, r.tags, r.links, r.body) for r in c.collect()) == [("X card", ["a", "b"], [], "# Body\ntext"), ("other", [], ["y"], "z")]
    assert files.card_lookup(c).count() == 1
    (tmp_path / "g.fa").write_text(">one x\nACGT\nAC\n>two\n\n")
    fa = files.read_fasta(spark, str(tmp_path / "g.fa"))
    assert sorted(map(tuple, fa.collect())) == [("one x", "ACGTAC"), ("two", "")]
    assert files.fasta_lines(fa, "header", "sequence").orderBy("value").first().value == ">one x\nACGTAC"
    df = spark.createDataFrame([(1, 'a,"b"', 1.23456), (2, None, None)], "i int, s string, d double")
    files.write_csv(df, str(tmp_path / "c"), 2)
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "c"), "i int, s string, d double").collect())) == [(1, "a,\"b\"", 1.23), (2, None, None)]
    files.append_jsonl(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    files.write_table(df, str(tmp_path / "t"), ["i"])
    assert files.read_union(spark, str(tmp_path / "t"), "i int, s string, d double, more string").where("i = 1").first().more is None
    files.write_bed(df.select("i", "s"), str(tmp_path / "b"))
    assert [r.value for r in files.leaderboard_lines(df, ["i", "s"]).collect()] == ['| 1 | a,"b" |', "| 2 | - |"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "x.parquet")
    df = spark.sql("SELECT i AS id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, i) AS ts FROM (SELECT explode(sequence(0, 300, 10)) AS i)")
    df.repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new
        ingest.append_once(ingest.first_deliveries(ingest.file_stream(spark, str(tmp_path), "x", 1), "id", "ts", "1 hour"), out)
        assert spark.read.parquet(out).count() == 31
    q = ingest.windowed_counts(ingest.file_stream(spark, str(tmp_path), "x"), "ts", [], "1 minute", "0 seconds").writeStream.format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").where("n = 6").count() == 5


def test_every_vector_gets_a_community(spark, tmp_path):
    from spotframe.plans import design

    at = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    rows = [(i, [float(c * 1000), float(x)]) for c in (0, 1) for i, x in ((100 * c + k, v) for k, v in enumerate(at))] + [(500, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.node: r.label for r in design.neighbour_communities(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows} and got[500] == 500
    sides = [{got[i] for i, _ in rows[a:b]} for a, b in ((0, 13), (13, 26))]
    assert not sides[0] & sides[1] and all(len(s) < 13 for s in sides)


def test_label_propagation_parts_cliques_at_a_bridge(spark):
    cliques = [(a, b) for c in (0, 10) for a in range(c, c + 5) for b in range(c, a)]
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 20]], "node long")
    got = {r.node: r.label for r in matrix.propagated_labels(nodes, spark.createDataFrame([*cliques, (4, 14)], "a long, b long")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10] and got[20] == 20
    # two nodes don't swap labels for ever
    pair = matrix.propagated_labels(nodes.where("node < 2"), spark.createDataFrame([(0, 1)], "a long, b long")).collect()
    assert len({r.label for r in pair}) == 1


def test_order_is_enhancers_promoters_then_the_pinned(spark):
    rows = [("p", f"{t}{i}", t, c, i) for i, (t, c) in enumerate([("P", "c1"), ("E", "c1"), ("E", "c1"), ("P", "c2"), ("E", "c2"), ("P", "c3"), ("P", "c3"), ("E", None)])]
    f = spark.createDataFrame(rows, "panel string, name string, type string, chr string, rna_s long")
    order = panel.imaging_order(f, "panel", pinned=["P5", "P0", "E1"])
    assert [r.name for r in order.orderBy("round").collect()] == ["E1", "E4", "E2", "P3", "P6", "P5", "P0"]
    no_rna = f.where("name = 'E4'").select("panel", "name")
    staged = spark.createDataFrame([("p", "E1_sub", 193, 289)], "panel string, sub string, rna int, dna int")
    got = {(r.block, r.feature): (r.imaging_round, r.readout, r.plate) for r in panel.readout_scheme(order, "panel", no_rna=no_rna, staged=staged).collect()}
    assert len(got) == 6 + 7 + 2 and ("RNA", "RNA_E4") not in got
    assert got["RNA", "RNA_E2"] == (2, 2, 1) and got["DNA", "DNA_E1"] == (7, 97, 2) and got["DNA", "DNA_P0"] == (13, 103, 2)
    assert got["RNA-sub", "RNA_E1_sub"] == (None, 193, 3) and got["DNA-sub", "DNA_E1_sub"] == (None, 289, 4)


def test_dual_barcodes_zones_and_missing_readouts(spark):
    over = spark.createDataFrame([("p", "c", "E", "P", 5, 9), ("p", "c", "E", "F", 1, 2)], "panel string, chr string, a string, b string, overlap_start long, overlap_end long")
    types = spark.createDataFrame([("p", n, n.replace("F", "E")) for n in "EPF"], "panel string, name string, type string")
    readouts = spark.createDataFrame([("p", "DNA", f"DNA_{n}", 97 + i) for i, n in enumerate("EPF")] + [("p", "RNA", "RNA_E", 1)], "panel string, block string, feature string, readout long")
    dual = panel.dual_barcodes(over, types, readouts, "panel")
    assert [(r.carrier, r.partner, r.primary, r.plate_primary, r.secondary) for r in dual.collect()] == [("E", "P", 97, 2, 98)]
    assert {(r.feature, r.start, r.end, r.r2) for r in panel.zones(dual, "panel").collect()} == {("E", 5, 9, 98), ("P", 5, 9, -1)}
    with pytest.raises(Exception, match="no DNA readout for p.P"):
        panel.dual_barcodes(over, types, readouts.where("feature <> 'DNA_P'"), "panel").collect()


def test_corrections(spark):
    schema = "name string, type string, s long, e long, strand string, tss long, note string"
    f = spark.createDataFrame([("E_Ski", "E", 10, 20, "+", None, None), ("P_A", "P", 1, 2, "-", 5, "n"), ("E_Drop", "E", 1, 2, "+", None, None), (None, "E", 1, 2, "+", None, None)], schema)
    more = spark.createDataFrame([("E_New", "E", 7, 8, "+", None, "added")], schema)
    fix = spark.createDataFrame([("P_A", 9, None, None), ("P_A", 11, "+", "x"), ("Q", 1, "+", "y")], "name string, new_tss long, new_strand string, new_note string")
    got = {r.name: tuple(r)[2:] for r in panel.corrected(f, {"_Ski$": 100}, ["E_Drop"], more, fix, ["name"]).collect()}
    assert got == {"E_Ski": (110, 120, "+", None, "COORD FIX: +100"), "P_A": (1, 2, "-", 9, "n"), None: (1, 2, "+", None, None), "E_New": (7, 8, "+", None, "added")}


def test_hub_colours_and_bed(spark):
    from spotframe.functions.exprs import hub_colour, readout_handle

    assert [r[0] for r in spark.range(2).select(hub_colour(F.col("id").cast("double"))).collect()] == ["198,47,47", "47,198,91"]
    f = spark.createDataFrame([(1, "c", "A", "+", 10, 20, None, None)], "p int, chr string, name string, strand string, dna_s long, dna_e long, rna_s long, rna_e long")
    assert [tuple(r) for r in panel.bed_rows(f, "p", F.lit("1,2,3")).collect()] == [(1, "c", 9, 20, "DNA_A", 0, "+", 9, 20, "1,2,3")]
    assert spark.range(1).select(readout_handle(F.lit("AACC" * 6))).first()[0] == "GGTT" * 5


def voxel_df(spark, rows, columns="k int, z int, y int, x int, v double"):
    return spark.createDataFrame(rows, columns)


def test_local_means_totals_and_floor(spark):
    image = voxel_df(spark, [(1, 0, 0, 0, "d", 27.0), (1, 1, 1, 1, "d", 54.0), (1, 0, 2, 0, "d", 5.0), (1, 0, 0, 0, "e", 1.0)], "k int, z int, y int, x int, m string, v double")
    points = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 0), (1, 9, 9, 9)], "k int, z int, y int, x int")
    assert {(r.z, r.m): r.local for r in voxels.local_means(points, image, ["k"], "m").collect()} == {(0, "d"): 3.0, (0, "e"): 1 / 27}
    mask = spark.createDataFrame([(1, 0, 0, 0, 7), (1, 0, 2, 0, 7), (1, 1, 1, 1, 8)], "k int, z int, y int, x int, label int")
    assert {(r.label, r.m): r.total for r in voxels.label_totals(image, mask, ["k"], "label", "m").collect()} == {(7, "d"): 32.0, (7, "e"): 1.0, (8, "d"): 54.0}
    kept = voxels.floor_mask(image, mask, ["k"], "label", "m", 0.5).collect()
    assert [(r.label, r.m, r.v) for r in kept] == [(7, "d", 27.0)]
    cells = {(r.label, r.m): (r.n_voxels, r.fill, r.bg_median, r.bg_mad) for r in voxels.cell_metrics(image, mask, image.where("v = 54"), ["k"], "label", "m").collect()}
    assert cells == {(7, "d"): (2, 0.0, 16.0, 11 * 1.4826), (7, "e"): (1, 0.0, 1.0, 1.0), (8, "d"): (1, 1.0, 0.0, 1.0)}


def test_shapes_scaling_and_upscaling(spark):
    square = spark.createDataFrame([(1, 5, z, y, x) for z in (0, 1) for y in range(4) for x in range(4)] + [(1, 6, 0, 9, 9)], "k int, label int, z int, y int, x int")
    got = {r.label: r for r in voxels.label_shapes(square, ["k"], "label").collect()}
    assert (got[5].n_voxels, got[5].area, got[5].cz, got[5].cy) == (32, 16, 0.5, 1.5)
    assert got[5].perimeter == 12 and got[5].circularity == pytest.approx(4 * math.pi * 16 / 144) and got[6].circularity == 0
    v = voxel_df(spark, [(1, 0, 0, i, float(i)) for i in range(101)] + [(2, 0, 0, 0, 0.0)])
    top = {(r.k, r.x): r.v for r in voxels.unit_scaled(v, ["k"], 0.5).collect()}
    assert top[1, 25] == 0.5 and top[1, 80] == 1.0 and top[2, 0] == 0.0
    fine = voxels.upscaled(square.where("label = 6"), ["k"], "label", 2, 19, 100).collect()
    assert {(r.y, r.x) for r in fine} == {(18, 18), (18, 19)}


def test_brightest_leaves_out_saturated_first(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([9, 8, 8, 3, 100])] + [(1, 9, None)], "k int, i int, v double")
    assert [(r.i, r["rank"]) for r in voxels.brightest(df, ["k"], "v", 2, 100.0).orderBy("rank").collect()] == [(0, 1), (1, 2)]


def test_more_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2}\n{broken\n')
    rows = files.read_json(spark, str(tmp_path / "a.json"), "a int, b struct<c:string>").collect()
    assert [(r.a, r.b.c if r.b else None, r._broken) for r in rows] == [(1, "x", None), (2, None, None), (None, None, "{broken")]
    cards = spark.createDataFrame([("s", "N", "finding", ["a", "b"], None, ["q"], "a\nd", "# H\ntext")], "slug string, name string, type string, tags array<string>, links array<string>, sources array<string>, description string, body string")
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "s.md").write_text(files.card_markdown(cards).first().value)
    back = files.read_cards(spark, str(tmp_path / "cards")).first()
    assert (back.slug, back.name, back.type, back.tags, back.links, back.sources, back.description, back.body) == ("s", "N", "finding", ["a", "b"], [], ["q"], "a d", "# H\ntext")
    assert files.card_index(cards).first().value == "- [[s]] a\nd"
    files.write_matrix(spark.createDataFrame([(1, 1.0, None), (2, 3.0, float("nan"))], "i int, a double, b double"), str(tmp_path / "m"), ["i"], ["a", "b"], {"made": "now"})
    assert {(r.feature, r.mean, r.deviation) for r in spark.read.parquet(str(tmp_path / "m" / "var")).collect()} == {("a", 2.0, 1.0), ("b", 0.0, 0.0)}
    labels = spark.createDataFrame([(1, 0, 1, 2, 70_000), (1, 3, 0, 0, 2), (1, 3, 9, 0, 5)], "k int, z int, y int, x int, label long")
    planes = files.label_planes(labels, ["k"], 4, 5)
    assert {tuple(r) for r in files.label_voxels(planes, ["k"]).collect()} == {(1, 0, 1, 2, 70_000), (1, 3, 0, 0, 2)}
    depth = spark.createDataFrame([(1, c, z) for c, n in (("a", 3), ("b", 2)) for z in range(n)], "k int, c string, z int")
    assert files.common_depth(depth, ["k"], "c").count() == 4
    p = spark.createDataFrame([(0, 0), (1, 0)], "channel int, z int")
    ch = spark.createDataFrame([("A", "interleaved", 1), ("B", "file", 0)], "marker string, kind string, index int")
    assert sorted(r.marker for r in files.channel_planes({"interleaved": p, "file": p}, ch).collect()) == ["A", "B"]
    got = cards_expectations(spark)
    assert got == {"Sc35": "20-60", "Brd4": None}


def cards_expectations(spark):
    m, c = spark.createDataFrame([("Sc35",), ("Brd4",)], "marker string"), spark.createDataFrame([("sc35-biology", "20-60")], "slug string, count string")
    return {r.marker: r["count"] for r in cards.expectations(m, c, "count").collect()}


def test_objects_are_parted_at_h_maxima_and_gated_by_size(spark):
    # two summits of 10 and 6 with a pass of 4 between, one of 5 beside 6, and a speck elsewhere
    line = [10, 8, 4, 6, 5, 5.5]
    v = voxel_df(spark, [(1, 0, 0, x, float(a)) for x, a in enumerate(line)] + [(1, 0, 50, 50, 9.0), (2, 0, 0, 0, 3.0)])
    parts = lambda h, **p: sorted(sorted((r.y, r.x) for r in rows) for rows in groups(voxels.objects(v, ["k"], "mean_fold", threshold=0.1, marker_h=h, **p)))

    def groups(df):
        out = {}
        for r in df.where("k = 1").collect():
            out.setdefault(r.label, []).append(r)
        assert set(out) == set(range(1, len(out) + 1))
        return out.values()

    row = lambda *xs: [(0, x) for x in xs]
    assert parts(0.1) == [row(0, 1, 2), row(3, 4), row(5), [(50, 50)]] or parts(0.1) == [row(0, 1, 2), row(3), row(4, 5), [(50, 50)]]
    assert parts(1.0) == [row(0, 1, 2), row(3, 4, 5), [(50, 50)]]
    assert parts(2.5) == [row(0, 1, 2, 3, 4, 5), [(50, 50)]]
    assert parts(1.0, min_size=2) == [row(0, 1, 2), row(3, 4, 5)] and parts(1.0, max_size=2) == [[(50, 50)]]
    assert parts(0.0, watershed=False) == [row(0, 1, 2, 3, 4, 5), [(50, 50)]]


@pytest.mark.parametrize(("family", "p"), [("log_dog", {"variant": "log", "min_sigma": 0.8, "max_sigma": 2.0, "num_sigma": 3}), ("log_dog", {"variant": "dog", "min_sigma": 0.8, "max_sigma": 3.0}), ("otsu_adaptive", {"method": "local", "block_size": 7, "offset_k": 0.5}), ("wavelet", {"levels": "2-3", "k": 1.0}), ("mean_fold", {"blur_sigma": 0.7}), ("mad_tophat", {"blur_sigma": 0.7, "tophat_radius": 3})])
def test_parameters_of_the_families(spark, family, p):
    yy, xx = np.mgrid[0:15, 0:15]
    img = 5 + 100 * np.exp(-((yy - 4) ** 2 + (xx - 4) ** 2) / 4.0) + 90 * np.exp(-((yy - 10) ** 2 + (xx - 10) ** 2) / 4.0)
    v = voxel_df(spark, [(1, 0, int(y), int(x), float(img[y, x])) for y in range(15) for x in range(15)])
    got = {(r.y, r.x) for r in voxels.detect(v, ["k"], family, **p).collect()}
    assert {(4, 4), (10, 10)} <= got
    # a background without noise has next to no threshold of deviations
    assert family == "mad_tophat" or (7, 7) not in got and len(got) < 110


def test_distances_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(5, 8)), rng.normal(size=(300, 8))
    d = matrix.distances(a, b)
    assert (d[:, 100:101] == matrix.distances(a, b[100:101])).all() and np.allclose(d, np.linalg.norm(a[:, None] - b[None], axis=2))
