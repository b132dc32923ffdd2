"""Rank statistics, false discovery control, correlation and tables over long feature rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotframe.operators.joins import running_least, running_total, same
from spotframe.session import cut


def _cubed(t: Column) -> Column:
    """What t equal values take from the variance of ranks."""
    return t.cast("double") * t * t - t


def rank_statistics(long: DataFrame, control: str, features: list[str]) -> DataFrame:
    """Cliff's delta and Mann-Whitney z of each group against ``control``, per feature.

    ``long``: the ``features`` columns, ``grp``, ``value`` (NULL and NaN left out). Values are
    first counted per distinct value, group by group, so ties need no peers and a group of a
    third of all rows is only as long as its distinct values; the ranks come from one running
    total of the control per feature, in slots. z has the tie and continuity corrections and is NULL where all values tie;
    a group or a control with fewer than 3 values gives NULL figures.
    """
    rows = long.where("value IS NOT NULL AND NOT isnan(value) AND grp IS NOT NULL")
    counts = cut(rows.groupBy(*features, "grp", "value").agg(F.count("*").alias("n")))
    mine = counts.where(F.col("grp") != control)
    # one running total of the control over the distinct values of all groups, looked up by each
    ctrl = counts.groupBy(*features, "value").agg(F.coalesce(F.sum(F.when(F.col("grp") == control, F.col("n"))), F.lit(0)).alias("nc"))
    below = running_total(ctrl, features, "value", "nc", "below").withColumnsRenamed({c: f"r_{c}" for c in [*features, "value"]})
    whole = ctrl.groupBy(*features).agg(F.sum("nc").alias("nb"), F.sum(_cubed(F.col("nc"))).alias("own_ties")).withColumnsRenamed({c: f"w_{c}" for c in features})
    both = mine.join(below, same([*features, "value"], "r_"))
    out = both.groupBy(*features, "grp").agg(
        F.sum("n").alias("na"),
        F.sum(F.col("n") * (F.col("below") - F.col("nc") + 0.5 * F.col("nc"))).cast("double").alias("u"),
        F.sum(_cubed(F.col("n") + F.col("nc")) - _cubed(F.col("nc"))).alias("more_ties"),
    )
    out = out.join(whole, same(features, "w_")).withColumn("ties", F.col("own_ties") + F.col("more_ties"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    var = na * nb / 12.0 * ((n + 1) - F.coalesce(F.try_divide("ties", n * (n - 1)), F.lit(0.0)))
    enough = (F.col("na") >= 3) & (F.col("nb") >= 3)
    dev = F.col("u") - na * nb / 2.0
    z = F.signum(dev) * F.greatest(F.abs(dev) - 0.5, F.lit(0.0)) / F.sqrt(var)
    return out.select(*features, "grp", "na", "nb", F.when(enough, 2 * F.col("u") / (na * nb) - 1).alias("cliffs_delta"), F.when(enough, F.col("u")).alias("u"), F.when(enough & (var > 0), z).alias("z"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; Spark has no error function, so a batch at a time in Python."""
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0)))


def bh_adjust(df: DataFrame, group: list[str], p: str, name: str = "padj") -> DataFrame:
    """Benjamini-Hochberg adjusted p per group; NULL and NaN stay NULL and don't count.

    p-values are counted per distinct value, so ties share one row; ranks and the reverse
    running minimum come in slots, so a group of any size is spread.
    """
    counts = cut(df.where(F.col(p).isNotNull() & ~F.isnan(p)).groupBy(*group, F.col(p).alias("_p")).agg(F.count("*").alias("_n")))
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_m")).withColumnsRenamed({g: f"m_{g}" for g in group})
    ranked = running_total(counts, group, "_p", "_n", "_rank").join(sizes, same(group, "m_")).withColumn("_q", F.col("_p") * F.col("_m") / F.col("_rank"))
    table = running_least(ranked.select(*group, "_p", "_q"), group, "_p", "_q", "_least")
    table = table.select(*[F.col(g).alias(f"g_{g}") for g in group], "_p", F.least("_least", F.lit(1.0)).alias(name))
    return df.join(table, same(group, "g_") & (F.col(p) == F.col("_p")), "left").select(*df.columns, name)


def to_long(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """``ids``, ``feature``, ``value`` from wide columns."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_x")).select(*ids, "_x.feature", "_x.value")


def coefficient_of_variation(c: Column) -> Column:
    """Sample standard deviation over the absolute mean; NULL for a zero mean or one value."""
    return F.stddev_samp(c) / F.nullif(F.abs(F.avg(c)), F.lit(0.0))


def z_scores(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """``(x - mean) / population deviation`` per feature over all rows; bad values count as 0, no spread gives 0.

    The means are one row, joined to every row as a broadcast.
    """
    fill = [F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf")), 0.0).otherwise(F.col(f)).cast("double").alias(f) for f in features]
    rows = df.select(*ids, *fill)
    stats = rows.agg(*[x for f in features for x in (F.avg(f).alias(f"{f}_m"), F.stddev_pop(f).alias(f"{f}_s"))]).first()
    scaled = [(F.lit(0.0) if not stats[f"{f}_s"] else (F.col(f) - F.lit(stats[f"{f}_m"])) / F.lit(stats[f"{f}_s"])).alias(f) for f in features]
    return rows.select(*ids, *scaled)


def correlation_matrix(df: DataFrame, group: list[str], features: list[str]) -> DataFrame:
    """Pearson correlation of every pair of features per group, over rows where both exist.

    One pass: each row gives its pairs as an array, so rows are never joined with themselves.
    Pairs without spread in one of the two are left out.
    """
    good = lambda f: F.when(~F.isnan(f), F.col(f).cast("double"))
    def pair(a: str, b: str) -> Column:
        x, y = F.when(good(b).isNotNull(), good(a)), F.when(good(a).isNotNull(), good(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    aggs = [pair(a, b).alias(f"{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    wide = df.groupBy(*group).agg(*aggs)
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"{min(i, j)}_{max(i, j)}").alias("r")) for i, a in enumerate(features) for j, b in enumerate(features)]
    return wide.select(*group, F.explode(F.array(*cells)).alias("_x")).select(*group, "_x.*").where("r IS NOT NULL AND NOT isnan(r)")


def composition(df: DataFrame, group: str, token: str) -> DataFrame:
    """Share of each token in its group; the shares of a group sum to 1."""
    n = df.where(F.col(group).isNotNull() & F.col(token).isNotNull()).groupBy(group, token).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def group_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], most: int = 200_000) -> DataFrame:
    """``group`` and one column per name of ``shares``: exact percentiles with linear interpolation.

    Rows are counted per distinct value with map-side combining. Where no group has more than
    ``most`` distinct values, they are one aggregate per group. Larger groups get running counts
    in slots, and only the two values around each rank are kept, so that no task holds a group's
    values. NULL and NaN don't count; NULL group keys form groups.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).cast("double").alias("_v"))
    counts = cut(rows.groupBy(*group, "_v").agg(F.count("*").alias("_n")))
    if counts.groupBy(*group).agg(F.count("*").alias("_k")).where(F.col("_k") > most).isEmpty():
        q = counts.groupBy(*group).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in shares.values()]), F.col("_n")).alias("_q"))
        return q.select(*group, *[F.col("_q")[i].alias(n) for i, n in enumerate(shares)])
    run = running_total(counts, group, "_v", "_n", "_upto")
    sizes = counts.groupBy(*group).agg((F.sum("_n") - 1).alias("_last"))
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.col("_last") * F.lit(float(p))).alias("place")) for n, p in shares.items()])).alias("_w")
    want = sizes.select(*[F.col(g).alias(f"w_{g}") for g in group], want).select(*[f"w_{g}" for g in group], "_w.*")
    at = (F.floor("place") < F.col("_upto")) & (F.ceil("place") >= F.col("_upto") - F.col("_n")) & same(group, "w_")
    both = run.join(F.broadcast(want) if not group else want, at).groupBy(*group, "name", "place").agg(F.min("_v").alias("a"), F.max("_v").alias("b"))
    x = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))
    return both.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, x)).alias(n) for n in shares])


#: Fixed value: a normal distribution's deviation over its median absolute deviation.
MAD_SCALE = 1.4826


def robust_noise(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``median``, ``p99``, ``mad`` (x 1.4826, of all values about the median; 1 where it is 0) and ``snr`` = (p99 - median) / mad.

    Two passes of percentiles per group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).cast("double").alias("_x"))
    first = group_percentiles(rows, group, "_x", {"median": 0.5, "p99": 0.99})
    first = cut(first.withColumnsRenamed({g: f"f_{g}" for g in group}))
    dev = group_percentiles(rows.join(first, same(group, "f_")).select(*group, F.abs(F.col("_x") - F.col("median")).alias("_dev")), group, "_dev", {"_d": 0.5})
    mad = F.when(F.col("_d") > 0, F.col("_d") * MAD_SCALE).otherwise(1.0)
    return dev.join(first, same(group, "f_")).select(*group, "median", "p99", mad.alias("mad"), ((F.col("p99") - F.col("median")) / mad).alias("snr"))


def background_noise(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``noise`` of the background: MAD (x 1.4826) of the values at or below the median about their own median.

    Where that is 0, the MAD of all values, at least 1. Percentiles in three passes per group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*group, F.col(value).cast("double").alias("_x"))
    med = cut(group_percentiles(rows, group, "_x", {"_m": 0.5}).withColumnsRenamed({g: f"f_{g}" for g in group}))
    rows = rows.join(med, same(group, "f_")).select(*group, "_x", "_m")
    low = cut(group_percentiles(rows.where("_x <= _m"), group, "_x", {"_l": 0.5}).withColumnsRenamed({g: f"l_{g}" for g in group}))
    both = rows.join(low, same(group, "l_")).select(*group, F.abs(F.col("_x") - F.col("_m")).alias("_all"), F.when(F.col("_x") <= F.col("_m"), F.abs(F.col("_x") - F.col("_l"))).alias("_dev"))
    full = group_percentiles(both, group, "_all", {"_a": 0.5}).withColumnsRenamed({g: f"a_{g}" for g in group})
    half = group_percentiles(both, group, "_dev", {"_d": 0.5})
    noise = F.when(F.col("_d") > 0, F.col("_d") * MAD_SCALE).otherwise(F.greatest(F.col("_a") * MAD_SCALE, F.lit(1.0)))
    return half.join(full, same(group, "a_")).select(*group, noise.alias("noise"))
