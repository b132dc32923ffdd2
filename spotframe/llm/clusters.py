"""Similarity clusters by bisecting k-means, split until every leaf is compact.

Distinct points are split level by level, all nodes of a level at once. A node is a leaf when
its box is compact: in every dimension the smallest value is within ``tolerance`` of the
largest, so all its members are similar to each other. Large nodes are split by aggregations
over the cluster (two centres, a few Lloyd steps of sums and counts with map-side combining);
once no wide node holds more than ``local_rows`` points, each is finished inside one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import cut

_FLOOR = 1e-6


def _scaled(c: Column) -> Column:
    """A monotone scale on which equal ratios are about equal distances, of either sign."""
    return F.signum(c) * F.log1p(F.abs(c) / F.lit(_FLOOR))


def near(low: Column, high: Column, tolerance: float) -> Column:
    """Whether two ordered values differ by at most ``tolerance`` of the larger magnitude."""
    return (high - low) <= F.lit(tolerance) * F.greatest(F.abs(low), F.abs(high))


def _near(low: np.ndarray, high: np.ndarray, tolerance: float) -> np.ndarray:
    return (high - low) <= tolerance * np.maximum(np.abs(low), np.abs(high))


def clean_points(df: DataFrame, key: str, fields: list[str], by: str | None = None) -> DataFrame:
    """``key`` and ``x0``.. as doubles; each key once (the latest ``by``), no NULL, NaN or infinity."""
    rows = df.select(F.col(key).alias("id"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(fields)], *([F.col(by).alias("_by")] if by else []))
    xs = [f"x{i}" for i in range(len(fields))]
    rows = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*(["_by"] if by else []), *xs)).alias("r")).select("id", *[F.col(f"r.{x}").alias(x) for x in xs])
    return rows.where(reduce(and_, [F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf")) for x in xs]))


def _split_local(p: pd.DataFrame, xs: list[str], tolerance: float, steps: int) -> np.ndarray:
    """Leaf number of each row: bisecting k-means on all open nodes of a task at once."""
    x = p[xs].to_numpy("float64")
    z = np.sign(x) * np.log1p(np.abs(x) / _FLOOR)
    node, open_rows, top = np.zeros(len(x), "int64"), np.arange(len(x)), 1
    while len(open_rows):
        _, n = np.unique(node[open_rows], return_inverse=True)
        k = n.max() + 1
        order = np.argsort(n, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(n[order]) > 0])
        lo, hi = np.minimum.reduceat(x[open_rows][order], at), np.maximum.reduceat(x[open_rows][order], at)
        wide = ~_near(lo, hi, tolerance).all(1)
        keep = wide[n]
        open_rows, n = open_rows[keep], n[keep]
        if not len(open_rows):
            break
        _, n = np.unique(n, return_inverse=True)
        k, v = n.max() + 1, z[open_rows]
        count = np.bincount(n, minlength=k)
        mean = np.stack([np.bincount(n, v[:, d], k) / count for d in range(v.shape[1])], 1)
        var = np.stack([np.bincount(n, (v[:, d] - mean[n, d]) ** 2, k) / count for d in range(v.shape[1])], 1)
        axis = var.argmax(1)
        shift = np.zeros_like(mean)
        shift[np.arange(k), axis] = np.sqrt(var.max(1))
        c0, c1 = mean - shift, mean + shift
        for _ in range(steps):
            side = ((v - c1[n]) ** 2).sum(1) < ((v - c0[n]) ** 2).sum(1)
            n1 = np.bincount(n, side, k)
            ok = (n1 > 0) & (n1 < count)
            s1 = np.stack([np.bincount(n, v[:, d] * side, k) for d in range(v.shape[1])], 1)
            c1 = np.where(ok[:, None], s1 / np.maximum(n1, 1)[:, None], c1)
            c0 = np.where(ok[:, None], (mean * count[:, None] - s1) / np.maximum(count - n1, 1)[:, None], c0)
        side = ((v - c1[n]) ** 2).sum(1) < ((v - c0[n]) ** 2).sum(1)
        n1 = np.bincount(n, side, k)
        stuck = ~((n1 > 0) & (n1 < count))
        if stuck.any():  # the centres don't part these: cut the widest side of the box in the middle
            order = np.argsort(n, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(n[order]) > 0])
            lo, hi = np.minimum.reduceat(v[order], at), np.maximum.reduceat(v[order], at)
            axis = (hi - lo).argmax(1)
            mid = (lo + hi)[np.arange(k), axis] / 2
            own = v[np.arange(len(v)), axis[n]]
            high = hi[np.arange(k), axis]
            side = np.where(stuck[n], np.where((mid >= high)[n], own == high[n], own > mid[n]), side)
        node[open_rows] = top + 2 * n + side
        top += 2 * k
    return np.unique(node, return_inverse=True)[1]


def bisect_clusters(points: DataFrame, xs: list[str], tolerance: float = 0.02, local_rows: int | None = None, steps: int = 2) -> DataFrame:
    """``points`` with ``leaf`` (STRING): the leaf of the bisecting tree that holds each.

    ``points`` must hold distinct points, so that copies can't make a node that no split parts.
    Every leaf is compact by ``tolerance``. Every level splits all its nodes that are wide and
    hold more than ``local_rows`` points, and each part of a split is smaller than its node, so
    the levels end. ``local_rows`` is a quarter of the points unless given, from 500 to 20,000, so
    that the splits run across the cluster at any size. The driver holds at most 10,000 nodes.
    """
    d = range(len(xs))
    zs = [f"_z{i}" for i in d]
    rows = cut(points.withColumns({z: _scaled(F.col(x)) for z, x in zip(zs, xs)}).withColumn("node", F.lit("r")))
    local_rows = local_rows or min(20_000, max(500, rows.count() // 4))
    first = lambda test: reduce(lambda e, i: F.when(test(i), i).otherwise(e), reversed(d), F.lit(0))
    far = lambda c: reduce(lambda a, b: a + b, [(F.col(zs[i]) - F.col(f"{c}{i}")) ** 2 for i in d])
    nearer = far("d") < far("c")
    most = lambda names: F.greatest(*names) if len(names) > 1 else names[0]
    done = []
    while True:
        stats = rows.groupBy("node").agg(F.count("*").alias("n"), *[a for i, x in enumerate(xs) for a in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(zs[i]).alias(f"m{i}"), F.var_pop(zs[i]).alias(f"v{i}"), F.min(zs[i]).alias(f"a{i}"), F.max(zs[i]).alias(f"b{i}"))])
        wide = ~reduce(and_, [near(F.col(f"lo{i}"), F.col(f"hi{i}"), tolerance) for i in d])
        large = stats.where(wide & (F.col("n") > local_rows))
        # up to 10,000 open nodes make a broadcast table, more are written and shuffled
        some = large.limit(10_001).collect()
        if not some:
            break
        small = F.broadcast if len(some) <= 10_000 else (lambda t: t)
        large = points.sparkSession.createDataFrame(some, large.schema) if len(some) <= 10_000 else cut(large)
        spread, span = most([F.col(f"v{i}") for i in d]), most([F.col(f"b{i}") - F.col(f"a{i}") for i in d])
        axis, waxis = first(lambda i: F.col(f"v{i}") == spread), first(lambda i: F.col(f"b{i}") - F.col(f"a{i}") == span)
        # two centres about the mean along the widest axis; the cut through the middle of the widest side of the box
        centres = large.select(
            "node", "n", waxis.alias("waxis"), reduce(lambda e, i: F.when(waxis == i, (F.col(f"a{i}") + F.col(f"b{i}")) / 2).otherwise(e), d, F.lit(None).cast("double")).alias("mid"), *[f"m{i}" for i in d],
            *[(F.col(f"m{i}") + s * F.when(axis == i, F.sqrt(spread)).otherwise(0.0)).alias(f"{c}{i}") for i in d for s, c in ((-1, "c"), (1, "d"))],
        )
        kept = centres.columns
        for _ in range(steps):
            sums = rows.join(small(centres), "node").groupBy(*kept).agg(F.count_if(nearer).alias("n1"), *[F.sum(F.when(nearer, F.col(zs[i]))).alias(f"s{i}") for i in d])
            ok = (F.col("n1") > 0) & (F.col("n1") < F.col("n"))
            moved = {f"d{i}": F.when(ok, F.col(f"s{i}") / F.col("n1")).otherwise(F.col(f"d{i}")) for i in d} | {f"c{i}": F.when(ok, (F.col(f"m{i}") * F.col("n") - F.col(f"s{i}")) / (F.col("n") - F.col("n1"))).otherwise(F.col(f"c{i}")) for i in d}
            centres = sums.select(*[moved[c].alias(c) if c in moved else c for c in kept])
        # where all rows would fall on one side, the middle of the widest side parts them
        plan = rows.join(small(centres), "node").groupBy(*kept).agg(F.count_if(nearer).alias("n1"))
        stuck = (F.col("n1") == 0) | (F.col("n1") == F.col("n"))
        own = reduce(lambda e, i: F.when(F.col("waxis") == i, F.col(zs[i])).otherwise(e), d, F.lit(None).cast("double"))
        side = F.when(stuck, own > F.col("mid")).otherwise(nearer)
        parted = cut(rows.join(small(plan), "node", "left").select(*points.columns, *zs, F.when(F.col("n").isNotNull(), F.concat("node", F.when(side, "1").otherwise("0"))).alias("_next"), "node"))
        done.append(parted.where("_next IS NULL").select(*points.columns, "node"))
        rows = parted.where("_next IS NOT NULL").select(*points.columns, *zs, F.col("_next").alias("node"))
    whole = reduce(DataFrame.unionByName, [*done, rows.select(*points.columns, "node")])

    def finish(p: pd.DataFrame) -> pd.DataFrame:
        return p.assign(node=p["node"] + "." + pd.Series(_split_local(p, xs, tolerance, steps), index=p.index).astype(str))

    # compact nodes of any size are leaves as they stand; only nodes of up to local_rows go to one task
    stats = whole.groupBy("node").agg(*[a for i, x in enumerate(xs) for a in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"))])
    compact = stats.select("node", reduce(and_, [near(F.col(f"lo{i}"), F.col(f"hi{i}"), tolerance) for i in d]).alias("compact"))
    marked = whole.join(compact, "node")
    parts = marked.where("NOT compact").drop("compact").groupBy("node").applyInPandas(finish, marked.drop("compact").schema)
    return cut(parts.unionByName(marked.where("compact").drop("compact")).withColumnRenamed("node", "leaf"))


def leaf_table(leaves: DataFrame, xs: list[str]) -> DataFrame:
    """``leaf``, ``n_points``, ``n_members`` and per dimension the box and the centre."""
    return leaves.groupBy("leaf").agg(
        F.count("*").alias("n_points"),
        F.sum("copies").alias("n_members"),
        *[a for i, x in enumerate(xs) for a in (F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), (F.sum(F.col(x) * F.col("copies")) / F.sum("copies")).alias(f"c{i}"))],
    )


def typical_members(members: DataFrame, xs: list[str], top: int = 3) -> DataFrame:
    """``leaf``, ``rank``, ``id``, ``distance``: the members nearest their leaf's centre.

    Ties go to the smaller id. The rank limit works before the shuffle, so a leaf with a third
    of all rows sends a few rows per task.
    """
    centre = members.groupBy("leaf").agg(*[F.avg(x).alias(f"c{i}") for i, x in enumerate(xs)])
    d = F.sqrt(reduce(lambda a, b: a + b, [(F.col(x) - F.col(f"c{i}")) ** 2 for i, x in enumerate(xs)]))
    w = Window.partitionBy("leaf").orderBy("distance", "id")
    return members.join(centre, "leaf").select("leaf", "id", d.alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _boxes_near(a: str, b: str, dims: int, tolerance: float) -> Column:
    """Whether the gap between two boxes is within the tolerance in every dimension."""
    parts = []
    for i in range(dims):
        alo, ahi, blo, bhi = F.col(f"{a}.lo{i}"), F.col(f"{a}.hi{i}"), F.col(f"{b}.lo{i}"), F.col(f"{b}.hi{i}")
        parts.append(F.when(alo > bhi, near(bhi, alo, tolerance)).when(blo > ahi, near(ahi, blo, tolerance)).otherwise(True))
    return reduce(and_, parts)


def _place(c: Column, tolerance: float) -> Column:
    """Position in units a little over the tolerance: similar values are less than 1 apart."""
    unit = 1.01 * float(-np.log(1 - tolerance))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * (F.log(F.abs(c)) / F.lit(unit) + F.lit(1e6)))


def _cells(low: Column, high: Column, tolerance: float, before: int, after: int, width: int = 4) -> Column:
    """Grid cells, ``width`` units wide, of an interval widened by so many units."""
    a, b = F.floor((_place(low, tolerance) - before) / width), F.floor((_place(high, tolerance) + after) / width)
    return F.sequence(a, b)


def isolated_clusters(leaves: DataFrame, xs: list[str], tolerance: float = 0.02, least: int = 3) -> DataFrame:
    """``leaf``, ``cluster``: the leaves that make up clusters similar within and to nothing outside.

    A split may cut a cluster, so leaves whose boxes together are compact are put together
    again. The group of a leaf is the leaf with all leaves it is compact with. A group is a
    cluster if its box is compact, all its leaves have the same group, it has ``least`` members,
    and no point outside is similar to a member. For the last, points outside within the
    tolerance of the group's box are held against the members that are extreme in the direction
    of the point (the only ones that can decide it), which are few however large the group is.
    """
    d = range(len(xs))
    boxes = cut(leaf_table(leaves, xs).select("leaf", "n_members", *[f"{s}{i}" for i in d for s in ("lo", "hi")]))
    # candidate pairs: a leaf is compact, so a near one begins between two units before it and one after
    here, there = boxes, boxes
    for i in d:
        here = here.withColumn(f"g{i}", F.explode(_cells(F.col(f"lo{i}"), F.col(f"lo{i}"), tolerance, 0, 0)))
        there = there.withColumn(f"g{i}", F.explode(_cells(F.col(f"lo{i}"), F.col(f"hi{i}"), tolerance, 2, 1)))
    cells = [f"g{i}" for i in d]
    a, b = there.alias("a"), here.alias("b")
    on = reduce(and_, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in cells]) & (F.col("a.leaf") != F.col("b.leaf"))
    union = reduce(and_, [near(F.least(f"a.lo{i}", f"b.lo{i}"), F.greatest(f"a.hi{i}", f"b.hi{i}"), tolerance) for i in d])
    near_pairs = cut(a.join(b, on).where(_boxes_near("a", "b", len(xs), tolerance)).select(F.col("a.leaf").alias("leaf"), F.col("b.leaf").alias("other"), union.alias("sure"), *[F.col(f"b.{s}{i}").alias(f"{s}{i}") for i in d for s in ("lo", "hi")], F.col("b.n_members").alias("n_members")))
    sure = near_pairs.where("sure").drop("sure")
    group = boxes.withColumn("other", F.col("leaf")).unionByName(sure).groupBy("leaf").agg(
        F.min("other").alias("cluster"), F.count("*").alias("n_leaves"), F.sum("n_members").alias("size"), F.sum(F.xxhash64("other").cast("decimal(38,0)")).alias("sign"), *[F.min(f"lo{i}").alias(f"lo{i}") for i in d], *[F.max(f"hi{i}").alias(f"hi{i}") for i in d]
    )
    compact = reduce(and_, [near(F.col(f"lo{i}"), F.col(f"hi{i}"), tolerance) for i in d])
    group = cut(group.where(compact & (F.col("size") >= least)))
    # every leaf of the group must have the same group
    same = group.groupBy("cluster", "n_leaves", "sign", "size", *[f"{s}{i}" for i in d for s in ("lo", "hi")]).agg(F.count("*").alias("agree")).where("agree = n_leaves").drop("agree", "n_leaves", "sign")
    member = group.select("leaf", "cluster").join(same.select("cluster"), "cluster", "left_semi")
    # leaves near a member leaf but outside its group leave the question open
    doubt = near_pairs.where("NOT sure").select("leaf", "other").join(member, "leaf").join(member.select(F.col("leaf").alias("other"), F.col("cluster").alias("theirs")), "other", "left").where("theirs IS NULL OR theirs <> cluster")
    doubt = cut(doubt.select("cluster", "other").distinct())
    open_groups = doubt.select("cluster").distinct()
    rim = leaves.join(doubt.withColumnRenamed("other", "leaf"), "leaf").join(same, "cluster")
    outside = reduce(and_, [F.when(F.col(x) > F.col(f"hi{i}"), near(F.col(f"hi{i}"), F.col(x), tolerance)).when(F.col(x) < F.col(f"lo{i}"), near(F.col(x), F.col(f"lo{i}"), tolerance)).otherwise(True) for i, x in enumerate(xs)])
    # direction of the point seen from the group's box: 1 above, -1 below, 0 beside
    way = F.concat_ws(",", *[F.when(F.col(x) > F.col(f"hi{i}"), "1").when(F.col(x) < F.col(f"lo{i}"), "-1").otherwise("0") for i, x in enumerate(xs)])
    rim = cut(rim.where(outside).select("cluster", way.alias("way"), *xs))
    asked = rim.select("cluster", "way").distinct()
    extremes = leaves.join(member, "leaf").join(open_groups, "cluster", "left_semi").join(asked, "cluster").select("cluster", "way", *xs)

    def front(batches):
        for p in batches:
            out = []
            for (_, way), q in p.groupby(["cluster", "way"], sort=False):
                s = np.array([int(v) for v in way.split(",")])
                v = q[xs].to_numpy() * s
                order, kept = np.argsort(-v.sum(1), kind="stable"), []
                while len(order):
                    kept.append(order[0])
                    order = order[~(v[order] <= v[order[0]]).all(1)]
                out.append(q.iloc[kept])
            yield pd.concat(out) if out else p

    extremes = extremes.mapInPandas(front, extremes.schema)
    r, m = rim.alias("r"), extremes.alias("m")
    meets = reduce(and_, [near(F.least(f"r.{x}", f"m.{x}"), F.greatest(f"r.{x}", f"m.{x}"), tolerance) for x in xs])
    touched = r.join(m, (F.col("r.cluster") == F.col("m.cluster")) & (F.col("r.way") == F.col("m.way"))).where(meets).select(F.col("r.cluster").alias("cluster")).distinct()
    return member.join(touched, "cluster", "left_anti").select("leaf", "cluster")
