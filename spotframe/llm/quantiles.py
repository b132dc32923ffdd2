"""Exact percentiles per group over very many values, by bisection on the values' binary order.

A value's bits, put in an order in which larger values have larger numbers, make every value a
whole number of ``width`` bits. Each pass halves the interval of every target ``bits`` times: it
counts the rows below all 2**bits - 1 midpoints at once, as one count per sub-interval, with
map-side combining. A target (group, rank) keeps the interval that holds its rank and the number
of rows below it; after ``width / bits`` passes the interval is a single value, and the rank is
resolved exactly. Stopping early bounds the error by the interval: after p passes a value is
known to ``p * bits`` binary places.

The counts of the first pass are sums, so those of single days (or of any other parts) add up to
the counts of all; nothing is sorted and no group is gathered.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOAT_BITS = 32


def ordered_bits(c: Column) -> Column:
    """A FLOAT as a whole number of 32 bits in the values' order: -0.0 counts as 0.0.

    Built from exponent and fraction by arithmetic, exact for every finite FLOAT.
    """
    x = F.abs(c.cast("double"))
    tiny = F.lit(2.0**-126)
    e = F.when(x < tiny, F.lit(-126)).otherwise(F.floor(F.log2(F.greatest(x, tiny))))
    # log2 may be off by one next to a power of two
    e = F.when(F.pow(F.lit(2.0), e) > x, F.when(x < tiny, e).otherwise(e - 1)).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    m = x / F.pow(F.lit(2.0), e)
    size = F.when(x < tiny, x / F.lit(2.0**-149)).otherwise((e + 127) * F.lit(2.0**23) + (m - 1) * F.lit(2.0**23)).cast("long")
    return F.when(c < 0, F.lit(2**31) - size).otherwise(F.lit(2**31) + size)


def value_of(n: Column) -> Column:
    """The FLOAT, as DOUBLE, that ``ordered_bits`` numbers so."""
    size = F.abs(n - F.lit(2**31))
    e = F.floor(size / F.lit(2**23))
    m = F.pmod(size, F.lit(2**23)).cast("double")
    x = F.when(e == 0, m * F.lit(2.0**-149)).otherwise((1 + m / F.lit(2.0**23)) * F.pow(F.lit(2.0), e - 127))
    return F.when(n < F.lit(2**31), -x).otherwise(x)


def interval_counts(rows: DataFrame, groups: list[str], number: str, shift: int) -> DataFrame:
    """Rows per group and interval of 2**shift numbers (``lo``): a state that parts can add up."""
    return rows.groupBy(*groups, F.shiftrightunsigned(F.col(number), shift).alias("lo")).agg(F.count("*").alias("n"))


def add_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Counts over coarser groups from counts over finer ones."""
    return counts.groupBy(*groups, "lo").agg(F.sum("n").alias("n"))


def targets(counts: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """The two ranks that each percentile lies between, per group: ``pct``, ``rank``, ``weight``.

    With ``size`` rows, percentile p is at place (size - 1) * p / 100, from 0.
    """
    sizes = counts.groupBy(*groups).agg(F.sum("n").alias("size"))
    pct = F.explode(F.array(*[F.lit(p) for p in percents])).alias("pct")
    place = (F.col("size") - 1) * F.col("pct")
    both = F.explode(
        F.array(
            F.struct(F.floor(place / 100).alias("rank"), (1 - F.pmod(place, F.lit(100)) / 100).alias("weight")),
            F.struct(F.ceil(place / 100).alias("rank"), (F.pmod(place, F.lit(100)) / 100).alias("weight")),
        )
    ).alias("t")
    return sizes.select(*groups, "size", pct).select(*groups, "size", "pct", both).select(*groups, "size", "pct", "t.rank", "t.weight").where("weight > 0")


def narrow(state: DataFrame, counts: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    """The interval of each target after a pass: where the running count passes its rank.

    ``counts`` hold, per group (and interval ``keys`` of the pass before), the rows of each
    sub-interval; a group's sub-intervals are at most 2**bits, so its window is small.
    """
    w = Window.partitionBy(*groups, *keys).orderBy("lo")
    running = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    on = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*groups, *keys]])
    rest = F.col("s.rank") - F.col("s.below")
    hit = (F.col("c.before") <= rest) & (rest < F.col("c.upto"))
    keep = [F.col(f"s.{c}") for c in state.columns if c not in ("below", *keys)]
    return state.alias("s").join(running.alias("c"), on & hit).select(*keep, (F.col("s.below") + F.col("c.before")).alias("below"), F.col("c.lo").alias("interval"))


def percentiles(rows: DataFrame, levels: list[list[str]], value: str, percents: list[int], bits: int = 16) -> list[DataFrame]:
    """Exact percentiles of a FLOAT column, one DataFrame per level of grouping.

    ``levels`` lists group columns from the finest to coarser ones; the coarser levels' first
    counts are sums of the finest's. NULL, NaN and infinite values must be left out by the
    caller; NULL group keys form groups. Result: groups, ``size``, ``pct``, ``value`` (DOUBLE,
    linear interpolation between ranks). An empty table gives no rows.
    """
    finest = levels[0]
    rows = rows.select(*finest, ordered_bits(F.col(value)).alias("_number"))
    first = interval_counts(rows, finest, "_number", FLOAT_BITS - bits)
    out = []
    for groups in levels:
        counts = first if groups == finest else add_counts(first, groups)
        state = narrow(targets(counts, groups, percents).withColumn("below", F.lit(0).cast("long")), counts, groups, [])
        done = bits
        while done < FLOAT_BITS:
            step = min(bits, FLOAT_BITS - done)
            # only rows inside an open interval are counted again
            wanted = state.select(*groups, "interval").distinct()
            inside = rows.withColumn("interval", F.shiftrightunsigned("_number", FLOAT_BITS - done))
            on = reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*groups, "interval"]])
            counts = interval_counts(inside.alias("r").join(wanted.alias("w"), on, "left_semi"), [*groups, "interval"], "_number", FLOAT_BITS - done - step)
            state = narrow(state, counts, groups, ["interval"])
            done += step
        resolved = state.withColumn("v", value_of(F.col("interval")))
        # the two ranks put together: low + (high - low) * weight of high
        w = resolved.groupBy(*groups, "size", "pct").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max_by("weight", "rank").alias("wb"), F.count("*").alias("k"))
        out.append(w.select(*groups, "size", "pct", F.when(F.col("k") == 1, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("wb")).alias("value")))
    return out
