"""Range, nearest-neighbour, overlap and nearest-group joins as equi-joins on bins."""

from __future__ import annotations

from functools import reduce
from itertools import chain, count
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import coarse_cuts, slot_of
from spotframe.session import cut


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, keep: list[str], priority: str | None = None) -> DataFrame:
    """``df`` with ``keep`` of the first range (by ``priority``, else ``low``) that holds the whole number ``value``.

    Both ends are included. Each covered number gets its first range once, so the join is an
    equi-join that Spark broadcasts when that table is small. No match gives NULL; NULL bounds
    and reversed ranges hold nothing.
    """
    rows = ranges.where(F.col(low) <= F.col(high))
    spread = rows.select(F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"))).alias("_at"), F.struct(F.col(priority or low).alias("_o"), *keep).alias("_r"))
    first = spread.groupBy("_at").agg(F.min("_r").alias("_hit"))
    return df.join(first, F.col(value).cast("long") == F.col("_at"), "left").select(*df.columns, *[F.col(f"_hit.{k}").alias(k) for k in keep])


def first_zone(points: DataFrame, ident: list[str], point: str, zones: DataFrame, key: list[str], low: str, high: str, order: list[str], value: str, width: float) -> DataFrame:
    """``points`` with ``value`` of the first zone (by ``order``) of the same key that holds the point, both ends included.

    A first zone of -1 drops the point; a point in no zone keeps NULL. Points and zones meet in
    bins of ``width``, so a key of any size is spread over its bins. ``ident`` tells the points
    apart.
    """
    z = zones.where(F.col(low) <= F.col(high)).select(*[F.col(k).alias(f"z_{k}") for k in key], F.struct(*order, F.col(value).alias("_v")).alias("_z"), F.col(low).alias("_l"), F.col(high).alias("_h"))
    z = z.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_l") / width), F.floor(F.col("_h") / width))))
    on = reduce(and_, [F.col(k) == F.col(f"z_{k}") for k in key]) & (F.floor(F.col(point) / width) == F.col("_c")) & (F.col("_l") <= F.col(point)) & (F.col(point) <= F.col("_h"))
    first = points.join(z, on).groupBy(*ident).agg(F.min("_z").alias("_z")).select(*ident, F.col("_z._v").alias(value))
    out = points.join(first, ident, "left")
    return out.where(F.col(value).isNull() | (F.col(value) != -1))


def overlap_pairs(df: DataFrame, key: list[str], ident: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of intervals of one key that share more than an end point, with the shared length.

    Both sides meet in bins of ``width``; a pair is emitted only in the bin where the later one
    begins or the first common bin, so it comes out once. Work follows the overlaps, not the
    square of a key. NULL bounds and empty intervals pair with nothing.
    """
    rows = df.select(*key, F.col(ident).alias("_i"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s < _e")
    first, last = F.floor(F.col("_s") / width), F.floor((F.col("_e") - 1) / width)
    binned = rows.withColumn("_b", F.explode(F.sequence(first, last)))
    a, b = binned.alias("a"), binned.alias("b")
    same = reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*key, "_b"]])
    s, e = F.greatest("a._s", "b._s"), F.least("a._e", "b._e")
    out = a.join(b, same & (F.col("a._i") < F.col("b._i")) & (s < e) & (F.floor(s / width) == F.col("a._b")))
    return out.select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a._i").alias("a"), F.col("b._i").alias("b"), s.alias("overlap_start"), e.alias("overlap_end"), (e - s).alias("overlap_len"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], coords: list[str], radii: tuple[float, ...] = (1.0, 4.0, 16.0, 64.0, 1024.0), few: int = 64) -> DataFrame:
    """``left`` with ``nn_dist``: the distance to the nearest row of ``right`` with an equal key.

    Keys of at most ``few`` partners are joined as they are; so a row meets ``few`` at most. For
    the others, rounds of grid joins with growing cells: a row is settled as soon as its nearest candidate
    is within the round's radius, so dense groups never pair all with all, and only rows
    without a near neighbour go to the wider cells, which grow until all are settled. With a NULL or NaN coordinate or an empty partner side,
    ``nn_dist`` is NULL.
    """
    good = lambda p: reduce(and_, [F.col(f"{p}{c}").isNotNull() & ~F.isnan(f"{p}{c}") for c in coords])
    partner = right.select(*[F.col(k).alias(f"r_{k}") for k in key], *[F.col(c).cast("double").alias(f"r_{c}") for c in coords]).where(good("r_")).distinct()
    ids = left.withColumn("_id", F.struct(*[F.col(k) for k in key], *[F.col(c).cast("double").alias(c) for c in coords])).select("_id").distinct().where(good("_id."))
    on_key = reduce(and_, [F.col(f"_id.{k}") == F.col(f"r_{k}") for k in key])
    apart = reduce(lambda x, y: x + y, [(F.col(f"_id.{c}") - F.col(f"r_{c}")) * (F.col(f"_id.{c}") - F.col(f"r_{c}")) for c in coords])
    names = [f"r_{k}" for k in key]
    partner, ids = cut(partner), cut(ids)
    large = cut(partner.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > few).drop("_n"))
    any_large = not large.isEmpty()
    small = partner.join(large, names, "left_anti") if any_large else partner
    found = ids.join(small, on_key).groupBy("_id").agg(F.sqrt(F.min(apart)).alias("nn_dist"))
    rest = ids.join(large, on_key, "left_semi") if any_large else None
    partner = partner.join(large, names, "left_semi")
    for r in chain(radii, (radii[-1] * 4.0**i for i in count(1))) if any_large else ():
        # a partner stands in the two cells, each way, that what is within r of it can lie in
        width, reach = 2.01 * r, 1.001 * r
        open_keys = rest.select(*[F.col(f"_id.{k}").alias(f"r_{k}") for k in key]).distinct()
        b = partner.join(open_keys, [f"r_{k}" for k in key], "left_semi")
        for i, c in enumerate(coords):
            b = b.withColumn(f"h{i}", F.explode(F.sequence(F.floor((F.col(f"r_{c}") - reach) / width), F.floor((F.col(f"r_{c}") + reach) / width))))
        a = rest.select("_id", *[F.floor(F.col(f"_id.{c}") / width).alias(f"g{i}") for i, c in enumerate(coords)])
        on = reduce(and_, [F.col(f"_id.{k}") == F.col(f"r_{k}") for k in key] + [F.col(f"g{i}") == F.col(f"h{i}") for i in range(len(coords))])
        near = a.join(b, on).groupBy("_id").agg(F.sqrt(F.min(apart)).alias("nn_dist")).where(F.col("nn_dist") <= r)
        step = cut(rest.join(near, "_id", "left"))
        done = step.where("nn_dist IS NOT NULL")
        found = found.unionByName(done)
        rest = step.where("nn_dist IS NULL").select("_id")
        if rest.isEmpty():
            break
    out = left.withColumn("_id", F.struct(*[F.col(k) for k in key], *[F.col(c).cast("double").alias(c) for c in coords]))
    return out.join(found, "_id", "left").drop("_id")


def nearest_group(groups: DataFrame, key: str, ident: str, low: str, high: str, anchor: str, limit: float) -> DataFrame:
    """Each group that is no anchor with the nearest anchor group of its key, within ``limit``.

    The gap between two spans is ``max(0, max(low) - min(high))``; ties go to the smaller
    ident. Bins as wide as the limit make it an equi-join.
    """
    width = float(limit)
    a = groups.where(~F.col(anchor)).select(F.col(key), F.col(ident), F.col(low).alias("_l"), F.col(high).alias("_h"))
    b = groups.where(F.col(anchor)).select(F.col(key).alias("_anchor_key"), F.col(ident).alias("nearest"), F.col(low).alias("_bl"), F.col(high).alias("_bh"))
    a = a.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_l") / width) - 1, F.floor(F.col("_h") / width) + 1)))
    b = b.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_bl") / width), F.floor(F.col("_bh") / width))))
    gap = F.greatest(F.lit(0), F.greatest("_l", "_bl") - F.least("_h", "_bh"))
    pairs = a.join(b, (F.col(key) == F.col("_anchor_key")) & (F.col("_b") == F.col("_c"))).withColumn("gap", gap).where(F.col("gap") <= limit)
    return pairs.groupBy(key, ident).agg(F.min(F.struct("gap", "nearest")).alias("m")).select(key, ident, F.col("m.nearest").alias("nearest"), F.col("m.gap").alias("gap"))


def same(group: list[str], prefix: str) -> Column:
    """Whether the group columns are those named with a prefix; NULL equals NULL."""
    return reduce(and_, [F.col(g).eqNullSafe(F.col(f"{prefix}{g}")) for g in group], F.lit(True))


def with_slots(df: DataFrame, group: list[str], order: str, slot_rows: int = 100_000, slots: int = 256) -> DataFrame:
    """``df``, written once, with ``_slot``: groups above ``slot_rows`` rows are cut at quantiles of ``order``; all others are one slot."""
    df = cut(df)
    large = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > slot_rows)
    if large.isEmpty():
        return df.withColumn("_slot", F.lit(0))
    large = cut(large.select(*[F.col(g).alias(f"c_{g}") for g in group]))
    hot = df.join(large, same(group, "c_")).groupBy(*[f"c_{g}" for g in group])
    cuts = hot.agg(F.array_distinct(F.percentile_approx(order, [i / slots for i in range(1, slots)], F.lit(10_000))).alias("_cuts")).withColumn("_coarse", coarse_cuts(F.col("_cuts")))
    return cut(df.join(cuts, same(group, "c_"), "left").withColumn("_slot", slot_of(F.col("_coarse"), F.col("_cuts"), F.col(order))).select(*df.columns, "_slot"))


def running_total(df: DataFrame, group: list[str], order: str, value: str, name: str, slot_rows: int = 100_000, slots: int = 256) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over rows of the group with a smaller or equal ``order``.

    ``order`` must be distinct within its group. Large groups come in slots; the totals before a
    slot are a window over one row per slot, so no task holds a whole group of any size.
    """
    rows = with_slots(df, group, order, slot_rows, slots)
    sums = rows.groupBy(*group, "_slot").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"s_{g}") for g in group], F.col("_slot").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*group, "_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum(value).over(inner))
    return rows.join(sums, same(group, "s_") & (F.col("_slot") == F.col("_s"))).select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


def running_least(df: DataFrame, group: list[str], order: str, value: str, name: str, slot_rows: int = 100_000) -> DataFrame:
    """``df`` with ``name``: the least ``value`` over rows of the group with a greater or equal ``order``, as ``running_total``."""
    rows = with_slots(df, group, order, slot_rows)
    least = rows.groupBy(*group, "_slot").agg(F.min(value).alias("_n"))
    after = Window.partitionBy(*group).orderBy("_slot").rowsBetween(1, Window.unboundedFollowing)
    least = least.select(*[F.col(g).alias(f"s_{g}") for g in group], F.col("_slot").alias("_s"), F.min("_n").over(after).alias("_later"))
    inner = Window.partitionBy(*group, "_slot").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_in", F.min(value).over(inner))
    return rows.join(least, same(group, "s_") & (F.col("_slot") == F.col("_s"))).select(*df.columns, F.least("_in", "_later").alias(name))


def nearest_match(left: DataFrame, right: DataFrame, key: list[str], ident: str, radius: float, flat: list[str], deep: str | None = None, most_deep: float = 3.0) -> DataFrame:
    """``key``, ``ident``, ``partner``, ``distance``: of each left row the nearest right row of its key within ``radius``, both included.

    Distance is in the ``flat`` coordinates; with ``deep`` the candidates' difference there is at
    most ``most_deep``. Ties go to the smaller ident; rows without a match have no row. Both
    sides meet in cells as wide as the radius.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    coords = [*flat, *([deep] if deep else [])]
    good = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])
    a = left.where(good).select(*key, ident, *coords)
    for i, c in enumerate(flat):
        a = a.withColumn(f"_g{i}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    b = right.where(good).select(*[F.col(k).alias(f"r_{k}") for k in key], F.col(ident).alias("partner"), *[F.col(c).alias(f"r_{c}") for c in coords], *[cell(c).alias(f"_h{i}") for i, c in enumerate(flat)])
    on = reduce(and_, [F.col(k) == F.col(f"r_{k}") for k in key] + [F.col(f"_g{i}") == F.col(f"_h{i}") for i in range(len(flat))])
    d = F.sqrt(reduce(lambda x, y: x + y, [(F.col(c) - F.col(f"r_{c}")) * (F.col(c) - F.col(f"r_{c}")) for c in flat]))
    near = F.col("distance") <= radius
    if deep:
        near = near & (F.abs(F.col(deep) - F.col(f"r_{deep}")) <= most_deep)
    pairs = a.join(b, on).withColumn("distance", d).where(near)
    return pairs.groupBy(*key, ident).agg(F.min(F.struct("distance", "partner")).alias("m")).select(*key, ident, "m.partner", "m.distance")


def lookup(df: DataFrame, table: DataFrame, name: str, value: str, what: str) -> DataFrame:
    """``df`` with ``value`` of the first row of ``table`` (by value) with its ``name``; a name that isn't there is an error when read."""
    first = table.groupBy(F.col(name).alias("_name")).agg(F.min(value).alias("_value"))
    missing = F.raise_error(F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(name).cast("string"), F.lit("NULL"))))
    return df.join(first, F.col(name) == F.col("_name"), "left").withColumn(value, F.coalesce("_value", missing.cast(table.schema[value].dataType))).drop("_name", "_value")
