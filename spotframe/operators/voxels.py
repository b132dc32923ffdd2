"""Image operators on long voxel tables: ``key`` columns, ``z``, ``y``, ``x``, ``v``.

Absent voxels are background of value 0. Neighbourhoods are made by shifting voxels and
aggregating by place, so every operator is a shuffle by place with map-side combining; objects
are found by following pointers to neighbours, halving the way each round.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.operators.joins import same
from spotframe.operators.matrix import connected_labels
from spotframe.operators.stats import MAD_SCALE, background_noise, group_percentiles
from spotframe.session import cut

PLACE = ["z", "y", "x"]


def voxelise(points: DataFrame, key: list[str], value: str, size: tuple[float, float, float]) -> DataFrame:
    """Sums of ``value`` per voxel of the given size; rows with a NULL or NaN coordinate or value drop out."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in [*PLACE, value]])
    return points.where(ok).groupBy(*key, *[F.floor(F.col(c) / s).cast("int").alias(c) for c, s in zip(PLACE, size)]).agg(F.sum(value).alias("v"))


def max_projection(v: DataFrame, key: list[str]) -> DataFrame:
    return v.groupBy(*key, "y", "x").agg(F.max("v").alias("v"))


def _shifted(v: DataFrame, key: list[str], offsets: list[tuple[int, int, int]], weights: list[float] | None = None) -> DataFrame:
    cells = [F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip(PLACE, o)], F.lit(1.0 if weights is None else weights[i]).alias("w")) for i, o in enumerate(offsets)]
    rows = v.withColumn("_o", F.explode(F.array(*cells)))
    return rows.select(*key, *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in PLACE], F.col("v"), F.col("_o.w").alias("w"), *[F.col(c).alias(f"from_{c}") for c in PLACE])


def blur(v: DataFrame, key: list[str], taps: list[float], step: int = 1) -> DataFrame:
    """Separable blur in y and x (not z) by a symmetric kernel; ``step`` spreads the taps (a-trous)."""
    h = len(taps) // 2
    for axis in (1, 2):
        offsets = [tuple((i - h) * step if c == axis else 0 for c in range(3)) for i in range(len(taps))]
        v = _shifted(v, key, offsets, taps).groupBy(*key, *PLACE).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return v


def gaussian_taps(sigma: float) -> list[float]:
    """Normalised Gaussian weights out to three sigma."""
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


#: The cubic B-spline kernel of the a-trous wavelet.
B3_SPLINE = [1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16]


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """a - b by place; absent is 0."""
    rows = a.unionByName(b.withColumn("v", -F.col("v")))
    return rows.groupBy(*key, *PLACE).agg(F.sum("v").alias("v"))


def around(full: bool = True) -> list[tuple[int, int, int]]:
    """Offsets of a voxel's 26 (or 6) neighbours and itself."""
    out = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return out if full else [o for o in out if abs(o[0]) + abs(o[1]) + abs(o[2]) <= 1]


def opened_background(v: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Grey opening per plane with a disk: the least, then the greatest value within the radius.

    A place with an absent neighbour in its disk has a least value of 0.
    """
    disk = [(0, y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
    low = _shifted(v, key, disk).groupBy(*key, *PLACE).agg(F.min("v").alias("v"), F.count("*").alias("n")).where(F.col("n") == len(disk)).drop("n")
    return _shifted(low, key, disk).groupBy(*key, *PLACE).agg(F.max("v").alias("v"))


def top_hat(v: DataFrame, key: list[str], radius: int) -> DataFrame:
    """Values above the opened background, at the places of ``v``."""
    return v.alias("a").join(opened_background(v, key, radius).withColumnRenamed("v", "bg"), [*key, *PLACE], "left").withColumn("v", F.col("v") - F.coalesce("bg", F.lit(0.0))).drop("bg")


def uphill(v: DataFrame, key: list[str]) -> DataFrame:
    """Each voxel with the neighbour (or itself) of greatest value, ties by greatest place: ``to_z``, ``to_y``, ``to_x``."""
    rows = _shifted(v, key, around()).select(*key, *PLACE, F.struct("v", *[F.col(f"from_{c}").alias(c) for c in PLACE]).alias("s"))
    best = rows.groupBy(*key, *PLACE).agg(F.max("s").alias("s"))
    return v.join(best, [*key, *PLACE]).select(*key, *PLACE, "v", *[F.col(f"s.{c}").alias(f"to_{c}") for c in PLACE])


def basins(v: DataFrame, key: list[str]) -> DataFrame:
    """Watershed by steepest ascent: each voxel with the summit (``to_*``) its uphill path ends at.

    Paths are halved every round by pointing to the pointer's pointer; they only climb, so the
    rounds end.
    """
    rows = cut(uphill(v, key))
    to = [f"to_{c}" for c in PLACE]
    while True:
        nxt = rows.select(*key, *[F.col(c).alias(t) for c, t in zip(PLACE, to)], *[F.col(t).alias(f"n{t}") for t in to])
        step = cut(rows.join(nxt, [*key, *to], "left").select(*key, *PLACE, "v", *[F.coalesce(f"n{t}", t).alias(t) for t in to], reduce(lambda a, b: a | b, [F.coalesce(f"n{t}", t) != F.col(t) for t in to]).alias("moved")))
        still = not step.where("moved").isEmpty()
        rows = step.drop("moved")
        if not still:
            return rows


def components(mask: DataFrame, key: list[str], full: bool = False) -> DataFrame:
    """``mask`` with ``label``: 1..N per key over connected voxels (6 neighbours, or 26), by first place.

    Joins are merged, never broadcast: the planner takes shifted voxels for as small as the file of
    the mask, and labels, of which few are different, are small on disk alone.
    """
    node = F.struct(*[F.col(k) for k in key], *[F.col(c) for c in PLACE])
    here = mask.select(node.alias("n"), *key, *PLACE)
    back = [o for o in around(full) if o < (0, 0, 0)]  # each pair once, from its later voxel
    rows = _shifted(mask, key, back).select(*key, *PLACE, F.struct(*[F.col(k) for k in key], *[F.col(f"from_{c}").alias(c) for c in PLACE]).alias("b"))
    edges = here.join(rows.hint("merge"), [*key, *PLACE]).select(F.col("n").alias("a"), "b")
    labels = connected_labels(edges)
    out = mask.withColumn("n", node).join(labels.withColumnRenamed("node", "n").hint("merge"), "n", "left").withColumn("root", F.coalesce("label", "n")).drop("label", "n")
    first = out.select(*key, "root").distinct().withColumn("label", F.dense_rank().over(Window.partitionBy(*key).orderBy("root")))
    return out.join(first, [*key, "root"]).drop("root")


def region_properties(labelled: DataFrame, key: list[str]) -> DataFrame:
    """Per label: volume, weighted centroid, mean and maximum, bounding box."""
    w = lambda c: (F.sum(F.col(c) * F.col("v")) / F.sum("v")).alias(f"c{c}")
    return labelled.groupBy(*key, "label").agg(F.count("*").alias("volume"), w("z"), w("y"), w("x"), F.avg("v").alias("mean"), F.max("v").alias("max"), *[f(c).alias(f"{n}_{c}") for c in PLACE for n, f in (("min", F.min), ("max", F.max))])


def inner_labels(props: DataFrame, key: list[str]) -> DataFrame:
    """Labels that touch neither border of their field in y and x (z doesn't count)."""
    edge = props.groupBy(*key).agg(*[f(f"{n}_{c}").alias(f"{n}{c}") for c in ("y", "x") for n, f in (("min", F.min), ("max", F.max))])
    ok = reduce(lambda a, b: a & b, [(F.col(f"min_{c}") > F.col(f"min{c}")) & (F.col(f"max_{c}") < F.col(f"max{c}")) for c in ("y", "x")])
    return props.join(edge, key).where(ok).select(*props.columns)


def otsu(v: DataFrame, key: list[str], bins: int = 64) -> DataFrame:
    """``threshold`` per key: the bin edge with the greatest variance between the classes."""
    lim = v.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = v.join(lim, key).where("hi > lo").withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    h = rows.groupBy(*key, "lo", "hi", "b").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    w = Window.partitionBy(*key)
    run = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"n0": F.sum("n").over(run), "s0": F.sum("s").over(run), "nt": F.sum("n").over(w), "st": F.sum("s").over(w)}).where("n0 < nt")
    n1 = F.col("nt") - F.col("n0")
    between = F.col("n0") * n1 * F.pow(F.col("s0") / F.col("n0") - (F.col("st") - F.col("s0")) / n1, F.lit(2.0))
    best = h.groupBy(*key, "lo", "hi").agg(F.max_by("b", F.struct(between, -F.col("b"))).alias("b"))
    return best.select(*key, (F.col("lo") + (F.col("b") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))


def above(v: DataFrame, thresholds: DataFrame, key: list[str], floor: float = 0.0) -> DataFrame:
    return v.join(thresholds, key).where((F.col("v") > F.col("threshold")) & (F.col("v") > floor)).drop("threshold")


def noise_threshold(v: DataFrame, key: list[str], k: float) -> DataFrame:
    """k times the background's noise."""
    return background_noise(v, key, "v").select(*key, (k * F.col("noise")).alias("threshold"))


def smoothed(v: DataFrame, key: list[str], sigma: float) -> DataFrame:
    """Gaussian blur in y and x at the places of ``v``; none for 0."""
    if sigma <= 0:
        return v
    return v.select(*key, *PLACE).join(blur(v, key, gaussian_taps(sigma)), [*key, *PLACE])


def scale_responses(v: DataFrame, key: list[str], sigmas: list[float]) -> DataFrame:
    """``scale``, ``v``: differences of blurs at neighbouring widths, at every place that one reaches."""
    blurred = [cut(blur(v, key, gaussian_taps(s))) for s in sigmas]
    parts = [difference(a, b, key).withColumn("scale", F.lit(i)) for i, (a, b) in enumerate(zip(blurred, blurred[1:]))]
    return reduce(DataFrame.unionByName, parts)


def scale_ladder(variant: str, least: float, most: float, many: int) -> list[float]:
    """Widths of a search over scales: ``many`` and one even steps (log), or 1.6 times each from ``least`` past ``most`` (dog)."""
    if variant == "log":
        return [least + (most - least) * i / max(many - 1, 1) for i in range(many)] + [most * 1.6]
    out = [least]
    while out[-1] <= most:
        out.append(out[-1] * 1.6)
    return out if len(out) > 1 else [least, least * 1.6]


def wavelet_product(v: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """Product of the positive a-trous planes ``low`` to ``high`` (from 1), at the places of ``v``; only positive products."""
    smooth, out = v, None
    for level in range(1, high + 1):
        rougher, smooth = smooth, cut(blur(smooth, key, B3_SPLINE, 2 ** (level - 1)))
        if level >= low:
            plane = difference(rougher, smooth, key).where("v > 0").withColumnRenamed("v", f"w{level}")
            out = plane if out is None else out.join(plane, [*key, *PLACE])
    product = reduce(lambda a, b: a * b, [F.col(f"w{i}") for i in range(low, high + 1)])
    return v.select(*key, *PLACE).join(out, [*key, *PLACE]).select(*key, *PLACE, product.alias("v"))


def deviation_threshold(v: DataFrame, key: list[str], k: float) -> DataFrame:
    """k times the deviation about the median of the values of each plane; where that is 0, their standard deviation."""
    by = [*key, "z"]
    med = cut(group_percentiles(v, by, "v", {"m": 0.5}).withColumnsRenamed({c: f"m_{c}" for c in by}))
    dev = group_percentiles(v.join(med, same(by, "m_")).select(*by, F.abs(F.col("v") - F.col("m")).alias("d")), by, "d", {"d": 0.5})
    std = v.groupBy(*by).agg(F.stddev_pop("v").alias("s"))
    return dev.join(std, by).select(*by, (k * F.when(F.col("d") > 0, F.col("d") * MAD_SCALE).otherwise(F.col("s") + 1e-9)).alias("threshold"))


def detect(v: DataFrame, key: list[str], family: str, **p: float | str) -> DataFrame:
    """Foreground voxels by a detector family; parameters as in the search space.

    mean_fold: blurred by ``blur_sigma``, above ``threshold`` times the mean of the positive
    projection and above ``abs_floor``. mad_tophat: top-hat of ``tophat_radius``, blurred, above
    ``noise_k`` times the background's noise. log_dog: some difference of blurs of the ``variant``'s
    widths from ``min_sigma`` to ``max_sigma`` above ``threshold`` of the greatest. h_dome: within ``h``
    of the maximum below each summit. otsu_adaptive: above Otsu's threshold, or (``method``
    local) above the mean of a block of ``block_size`` by ``offset_k`` deviations. wavelet:
    product of the a-trous planes ``levels`` above ``k`` times its deviation per plane.
    """
    if family == "mean_fold":
        v = smoothed(v, key, p.get("blur_sigma", 0.0))
        t = max_projection(v, key).where("v > 0").groupBy(*key).agg((p.get("threshold", 1.5) * F.avg("v")).alias("threshold"))
        return above(v, t, key, p.get("abs_floor", 0.0))
    if family == "mad_tophat":
        h = smoothed(top_hat(v, key, int(p.get("tophat_radius", 2))), key, p.get("blur_sigma", 0.0))
        return above(h, noise_threshold(h, key, p.get("noise_k", 3.0)), key)
    if family == "log_dog":
        ladder = scale_ladder(p.get("variant", "dog"), p.get("min_sigma", 1.0), p.get("max_sigma", 1.6), int(p.get("num_sigma", 2)))
        d = cut(scale_responses(v, key, ladder).groupBy(*key, *PLACE).agg(F.max("v").alias("v")))
        t = d.groupBy(*key).agg((p.get("threshold", 0.1) * F.max("v")).alias("threshold"))
        return above(d, t, key)
    if family == "h_dome":
        b = basins(v, key)
        top = b.groupBy(*key, *[f"to_{c}" for c in PLACE]).agg(F.max("v").alias("top"))
        whole = v.groupBy(*key).agg(F.max("v").alias("most"))
        rows = b.join(top, [*key, *[f"to_{c}" for c in PLACE]]).join(whole, key)
        return rows.where(F.col("v") > F.col("top") - p.get("h", 0.1) * F.col("most")).select(*key, *PLACE, "v")
    if family == "otsu_adaptive":
        if p.get("method", "otsu") == "otsu":
            return above(v, otsu(v, key), key)
        size = int(p.get("block_size", 15)) // 2 * 2 + 1
        local = blur(v, key, [1 / size] * size).withColumnRenamed("v", "local")
        noise = v.groupBy(*key).agg(F.stddev_pop("v").alias("s")).withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0))
        rows = v.join(local, [*key, *PLACE]).join(noise, key)
        return rows.where(F.col("v") > F.col("local") + p.get("offset_k", 1.0) * F.col("s")).select(*key, *PLACE, "v")
    if family == "wavelet":
        low, high = (int(x) for x in str(p.get("levels", "1-2")).split("-"))
        m = cut(wavelet_product(v, key, low, high))
        return above(m, deviation_threshold(m, key, p.get("k", 2.0)), [*key, "z"])
    raise ValueError(f"unknown family {family}")


def merged_basins(b: DataFrame, key: list[str], h: float) -> DataFrame:
    """``basins`` in which a summit less than ``h`` above its highest pass goes to the basin beyond it, if that is higher.

    So the summits left are the h-maxima. Passes are the greatest of the lower values where two
    basins touch. Every round merges basins along their highest passes; the rounds end when none
    is low, and each has fewer basins. Equal summits: the one at the greater place stays.
    """
    to = [f"to_{c}" for c in PLACE]
    root = F.struct(*[F.col(c) for c in [*key, *to]])
    rows = cut(b.select(*key, *PLACE, "v", root.alias("root")))
    half = [o for o in around() if o > (0, 0, 0)]
    moved = _shifted(rows.select(*key, *PLACE, "v"), key, half).withColumnRenamed("v", "u")
    other = rows.select(*key, *[F.col(c).alias(f"from_{c}") for c in PLACE], F.col("root").alias("there"))
    touch = moved.join(rows, [*key, *PLACE]).join(other, [*key, *[f"from_{c}" for c in PLACE]]).where("root <> there")
    pairs = touch.select(F.col("root").alias("a"), F.col("there").alias("b"), F.least("u", "v").alias("pass"))
    edges = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "pass")).groupBy("a", "b").agg(F.max("pass").alias("pass")))
    owner = cut(rows.groupBy("root").agg(F.max("v").alias("top")).select(F.col("root").alias("first"), "root", "top"))
    while True:
        tops = owner.groupBy("root").agg(F.max("top").alias("top"))
        ends = lambda side: tops.select(F.col("root").alias(side), F.col("top").alias(f"top_{side}"))
        best = edges.join(ends("b"), "b").groupBy("a").agg(F.max(F.struct("pass", "top_b", "b")).alias("m")).join(ends("a"), "a")
        low = (F.col("top_a") - F.col("m.pass") < h) & ((F.col("m.top_b") > F.col("top_a")) | ((F.col("m.top_b") == F.col("top_a")) & (F.col("m.b") > F.col("a"))))
        goes = cut(best.where(low).select("a", F.col("m.b").alias("next")))
        if goes.isEmpty():
            break
        while True:  # to the end of each chain
            ahead = goes.select(F.col("a").alias("next"), F.col("next").alias("far"))
            step = cut(goes.join(ahead, "next", "left").select("a", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moved")))
            goes = step.select("a", "next")
            if step.where("moved").isEmpty():
                break
        hop = lambda c: goes.select(F.col("a").alias(c), F.col("next").alias(f"{c}_next"))
        owner = cut(owner.join(hop("root"), "root", "left").select("first", F.coalesce("root_next", "root").alias("root"), "top"))
        e = edges.join(hop("a"), "a", "left").join(hop("b"), "b", "left").select(F.coalesce("a_next", "a").alias("a"), F.coalesce("b_next", "b").alias("b"), "pass")
        edges = cut(e.where("a <> b").groupBy("a", "b").agg(F.max("pass").alias("pass")))
    return rows.withColumnRenamed("root", "first").join(owner.select("first", "root"), "first").select(*key, *PLACE, "v", *[F.col(f"root.{t}").alias(t) for t in to])


def size_gate(labelled: DataFrame, key: list[str], least: int = 0, most: int | None = None) -> DataFrame:
    """Labels of at least ``least`` and at most ``most`` voxels, numbered 1..N per key in their order."""
    n = labelled.groupBy(*key, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    n = n if most is None else n.where(F.col("_n") <= most)
    first = n.select(*key, "label", F.dense_rank().over(Window.partitionBy(*key).orderBy("label")).alias("_new"))
    return labelled.join(first, [*key, "label"]).drop("label").withColumnRenamed("_new", "label")


def objects(v: DataFrame, key: list[str], family: str, **p: float | str | bool) -> DataFrame:
    """``detect``, then objects: place, ``v`` and ``label`` 1..N per key.

    With ``watershed`` the foreground is parted into the basins of its h-maxima (``marker_h``; for
    mad_tophat ``seed_h_k`` times the noise is the caller's to give as ``marker_h``), else into
    connected voxels (6 neighbours); then ``min_size`` and ``max_size`` count.
    """
    fg = cut(detect(v, key, family, **p))
    if p.get("watershed", True):
        b = merged_basins(basins(fg, key), key, max(float(p.get("marker_h", 0.0)), 1e-6))
        where = F.struct(*[F.col(f"to_{c}") for c in PLACE])
        labelled = b.withColumn("label", where).drop(*[f"to_{c}" for c in PLACE])
    else:
        labelled = components(fg, key)
    return size_gate(labelled, key, int(p.get("min_size", 0)), int(p["max_size"]) if p.get("max_size") else None)


def label_totals(image: DataFrame, mask: DataFrame, key: list[str], label: str, by: str) -> DataFrame:
    """``key``, ``label``, ``by``, ``total``: sums of an image's values over the voxels of each label.

    ``mask``: key, place, label; a voxel has one label. An equi-join on places.
    """
    return image.join(mask, [*key, *PLACE]).groupBy(*key, label, by).agg(F.sum("v").alias("total"))


def local_sums(points: DataFrame, image: DataFrame, key: list[str], by: str) -> DataFrame:
    """``key``, place, ``by``, ``local``: sums of each channel ``by`` over the 27 voxels about the given places.

    Places without a voxel count as 0; a place without any near voxel of a channel has no row.
    """
    near = [F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip(PLACE, o)]) for o in around()]
    rows = points.select(*key, *PLACE).distinct().withColumn("_o", F.explode(F.array(*near)))
    rows = rows.select(*key, *[F.col(c).alias(f"at_{c}") for c in PLACE], *[(F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in PLACE])
    sums = rows.join(image, [*key, *PLACE]).groupBy(*key, *[f"at_{c}" for c in PLACE], by).agg(F.sum("v").alias("local"))
    return sums.withColumnsRenamed({f"at_{c}": c for c in PLACE})


def local_means(points: DataFrame, image: DataFrame, key: list[str], by: str) -> DataFrame:
    """``local_sums`` as means."""
    return local_sums(points, image, key, by).withColumn("local", F.col("local") / 27)


#: What a border pixel adds to a perimeter, by 10 x its diagonal and 2 x its straight border neighbours + 1.
PERIMETER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def label_shapes(mask: DataFrame, key: list[str], label: str) -> DataFrame:
    """Per label: voxels, centroid, and the area, perimeter and circularity (4 pi A / P^2; 0 without one) of its footprint."""
    names = [*key, label]
    flat = mask.select(*names, "y", "x").distinct()

    def neighbours(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets]))
        moved = rows.withColumn("_o", near).select(*names, (F.col("y") + F.col("_o.a")).alias("y"), (F.col("x") + F.col("_o.b")).alias("x"), (F.abs("_o.a") + F.abs("_o.b")).alias("far"))
        return rows.join(moved.groupBy(*names, "y", "x").agg(F.count_if(F.col("far") == 1).alias("straight"), F.count_if(F.col("far") == 2).alias("diagonal")), [*names, "y", "x"], "left").fillna(0, ["straight", "diagonal"])

    cross, corners = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    border = neighbours(flat, cross).where("straight < 4").select(*names, "y", "x")
    kind = 1 + 2 * F.col("straight") + 10 * F.col("diagonal")
    length = reduce(lambda e, k: F.when(kind == k, PERIMETER[k]).otherwise(e), PERIMETER, F.lit(0.0))
    around_ = neighbours(border, cross + corners).groupBy(*names).agg(F.sum(length).alias("perimeter"))
    whole = mask.groupBy(*names).agg(F.count("*").alias("n_voxels"), *[F.avg(c).alias(f"c{c}") for c in PLACE])
    out = whole.join(flat.groupBy(*names).agg(F.count("*").alias("area")), names).join(around_, names)
    return out.withColumn("circularity", F.when(F.col("perimeter") > 0, F.lit(4 * math.pi) * F.col("area") / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0))


def brightest(points: DataFrame, key: list[str], value: str, most: int, saturated: float) -> DataFrame:
    """The ``most`` brightest rows of each key that aren't saturated, with their ``rank``; the limit is the feature.

    Saturated rows (at or above ``saturated``), NULL and NaN go first, then the limit counts.
    Ties go by all columns. Ranks are cut before the shuffle, so a large key sends few rows.
    """
    rows = points.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) < saturated))
    w = Window.partitionBy(*key).orderBy(F.col(value).desc(), *[c for c in points.columns if c != value and c not in key])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def unit_scaled(v: DataFrame, key: list[str], share: float = 0.999) -> DataFrame:
    """Values over a high percentile of their key (1 where that isn't positive), cut to 0..1."""
    top = cut(group_percentiles(v, key, "v", {"_top": share}).withColumnsRenamed({k: f"t_{k}" for k in key}))
    scaled = F.col("v") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return v.join(top, same(key, "t_")).select(*v.columns[:-1], F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)).alias("v"))


def floor_mask(v: DataFrame, mask: DataFrame, key: list[str], label: str, by: str, share: float) -> DataFrame:
    """The voxels in a label of the mask that are above a percentile of that label's values, per ``by``."""
    inside = cut(v.join(mask, [*key, *PLACE]))
    group = [*key, label, by]
    low = group_percentiles(inside, group, "v", {"_floor": share}).withColumnsRenamed({k: f"f_{k}" for k in group})
    return inside.join(cut(low), same(group, "f_")).where(F.col("v") > F.col("_floor")).select(*group, *PLACE, "v")


def upscaled(mask: DataFrame, key: list[str], label: str, factor: int, height: int, width: int) -> DataFrame:
    """A mask in ``factor`` times finer steps of y and x (z stays), each voxel repeated; what falls outside height and width is cut off."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(factor) for b in range(factor)]))
    fine = lambda c, d: (F.col(c) * factor + F.col(d)).alias(c)
    rows = mask.withColumn("_s", steps).select(*key, label, "z", fine("y", "_s.a"), fine("x", "_s.b"))
    return rows.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def cell_metrics(v: DataFrame, mask: DataFrame, foreground: DataFrame, key: list[str], label: str, by: str) -> DataFrame:
    """Per cell and channel: voxels, ``fill`` (share in the foreground), and median and deviation of the background.

    ``bg_mad`` is the median absolute deviation x 1.4826 of the voxels that aren't foreground, 1
    where it is 0; a cell that is all foreground has a median of 0 and a deviation of 1.
    """
    group = [*key, label, by]
    inside = v.join(mask, [*key, *PLACE]).join(foreground.select(*key, by, *PLACE, F.lit(True).alias("_fg")), [*key, by, *PLACE], "left")
    inside = cut(inside.select(*group, "v", F.coalesce("_fg", F.lit(False)).alias("_fg")))
    back = inside.where("NOT _fg")
    med = cut(group_percentiles(back, group, "v", {"bg_median": 0.5}).withColumnsRenamed({k: f"m_{k}" for k in group}))
    dev = back.join(med, same(group, "m_")).select(*group, F.abs(F.col("v") - F.col("bg_median")).alias("_d"))
    dev = group_percentiles(dev, group, "_d", {"_mad": 0.5}).join(med, same(group, "m_")).select(*group, "bg_median", "_mad")
    out = inside.groupBy(*group).agg(F.count("*").alias("n_voxels"), F.avg(F.col("_fg").cast("int")).alias("fill"))
    mad = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_SCALE).otherwise(1.0)
    return out.join(dev, group, "left").select(*group, "n_voxels", "fill", F.coalesce("bg_median", F.lit(0.0)).alias("bg_median"), mad.alias("bg_mad"))
