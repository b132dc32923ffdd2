"""Bounded parameter search on trial tables: clipping, scoring, pruning, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import bump_score, equivalent_diameter, range_score
from spotframe.operators.joins import same
from spotframe.operators.stats import group_percentiles, to_long
from spotframe.session import cut

#: Family, parameter, kind, lowest, highest, choices. The bounded search space.
PARAM_SPACE = [
    ("mean_fold", "threshold", "float", 1.05, 3.0, None),
    ("mean_fold", "abs_floor", "float", 0.0, 50.0, None),
    ("mean_fold", "blur_sigma", "float", 0.0, 2.0, None),
    ("mean_fold", "marker_h", "float", 0.5, 10.0, None),
    ("mean_fold", "watershed", "bool", None, None, None),
    ("mean_fold", "min_size", "int", 3.0, 300.0, None),
    ("mean_fold", "max_size", "int", 400.0, 40000.0, None),
    ("mad_tophat", "tophat_radius", "int", 2.0, 12.0, None),
    ("mad_tophat", "noise_k", "float", 1.0, 6.0, None),
    ("mad_tophat", "seed_h_k", "float", 0.1, 2.0, None),
    ("mad_tophat", "blur_sigma", "float", 0.0, 2.0, None),
    ("mad_tophat", "min_size", "int", 3.0, 300.0, None),
    ("log_dog", "variant", "cat", None, None, ["log", "dog"]),
    ("log_dog", "min_sigma", "float", 0.8, 3.0, None),
    ("log_dog", "max_sigma", "float", 2.0, 8.0, None),
    ("log_dog", "num_sigma", "int", 3.0, 8.0, None),
    ("log_dog", "threshold", "float", 0.002, 0.2, None),
    ("log_dog", "fg_floor_pct", "float", 40.0, 95.0, None),
    ("log_dog", "min_size", "int", 3.0, 300.0, None),
    ("h_dome", "h", "float", 0.02, 0.6, None),
    ("h_dome", "min_distance", "int", 1.0, 8.0, None),
    ("h_dome", "fg_floor_pct", "float", 40.0, 95.0, None),
    ("h_dome", "watershed", "bool", None, None, None),
    ("h_dome", "min_size", "int", 3.0, 300.0, None),
    ("otsu_adaptive", "method", "cat", None, None, ["otsu", "local"]),
    ("otsu_adaptive", "block_size", "int", 15.0, 151.0, None),
    ("otsu_adaptive", "offset_k", "float", -1.0, 3.0, None),
    ("otsu_adaptive", "watershed", "bool", None, None, None),
    ("otsu_adaptive", "marker_h", "float", 0.5, 10.0, None),
    ("otsu_adaptive", "min_size", "int", 3.0, 400.0, None),
    ("wavelet", "levels", "cat", None, None, ["1-2", "2-3", "1-3", "2-4"]),
    ("wavelet", "k", "float", 0.5, 5.0, None),
    ("wavelet", "watershed", "bool", None, None, None),
    ("wavelet", "min_size", "int", 3.0, 300.0, None),
]
#: Arms kept after each round.
KEEP = (6, 3, 2, 1)


def space_table(df: DataFrame) -> DataFrame:
    """The search space as a table; it is configuration of a few rows."""
    return df.sparkSession.createDataFrame(PARAM_SPACE, "family string, param string, kind string, lo double, hi double, choices array<string>")


def long_params(df: DataFrame, params: str, keys: list[str]) -> DataFrame:
    """``keys``, ``param``, ``val`` (text): one row per non-NULL field of a params struct."""
    cells = [F.struct(F.lit(f).alias("param"), F.col(f"{params}.{f}").cast("string").alias("val")) for f in df.schema[params].dataType.names]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_p")).select(*keys, "_p.*").where("val IS NOT NULL")


def clip_with_defaults(specs: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Every parameter of each spec's family, clipped to its domain; missing ones get defaults.

    ``specs``: keys, family. Numbers are clamped, an unknown choice becomes the first, unknown
    parameters drop out. Defaults: the middle of the range (integers half-even), the first
    choice, true. ``val`` is text.
    """
    full = specs.join(F.broadcast(space_table(specs)), "family").join(params, [*keys, "param"], "left")
    x = F.col("val").try_cast("double")
    number = F.least(F.greatest(F.when(F.col("kind") == "int", F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")).otherwise(x), F.col("lo")), F.col("hi"))
    middle = (F.col("lo") + F.col("hi")) / 2
    value = (
        F.when(F.col("kind") == "float", F.coalesce(F.when(x.isNotNull(), number), F.bround(middle, 3)))
        .when(F.col("kind") == "int", F.coalesce(F.when(x.isNotNull(), number), F.rint(middle)))
    )
    text = F.when(F.col("kind") == "cat", F.when(F.array_contains("choices", F.col("val")), F.col("val")).otherwise(F.col("choices")[0])).when(F.col("kind") == "bool", F.coalesce("val", F.lit("true")))
    return full.select(*keys, "family", "param", value.alias("num"), text.alias("text"), F.col("val").isNull().alias("defaulted"))


def proxy_score(cells: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Panel metrics of each group of cells.

    ``cells``: ``count``, ``fill`` and ``volume`` (of the nucleus) per cell; ``sizes``: ``size``
    (voxels) and ``contrast`` per spot. A group without counts has a count CV of 9.9, one
    without spots only tiny ones. A spot is huge against the group's median nucleus, whose
    ``volume`` is in the unit of ``size``.
    """
    cells, sizes = cut(cells), cut(sizes)
    out = cells.groupBy(*group).agg(F.coalesce(F.when(F.avg("count") > 0, F.stddev_pop("count") / F.avg("count")), F.lit(9.9)).alias("count_cv"))
    names = {"count": "median_count", "fill": "median_fill", "volume": "median_nucleus", "size": "median_vol", "contrast": "median_contrast"}
    long = to_long(cells, group, ["count", "fill", "volume"]).unionByName(to_long(sizes, group, ["size", "contrast"]))
    medians = group_percentiles(long, [*group, "feature"], "value", {"m": 0.5}).groupBy(*group)
    out = out.join(medians.agg(*[F.max(F.when(F.col("feature") == f, F.col("m"))).alias(n) for f, n in names.items()]), group, "left")
    out = cut(out)
    far = sizes.join(out.select(*group, "median_nucleus"), group).groupBy(*group).agg(F.avg((F.col("size") < 3).cast("int")).alias("frac_tiny"), F.avg((F.col("size") > 0.05 * F.col("median_nucleus")).cast("int")).alias("frac_huge"))
    return out.join(far, group, "left").fillna({"frac_tiny": 1.0, "frac_huge": 0.0})


def panel_score(m: DataFrame, expect: dict[str, tuple[float, float]] | None, voxel: float = 1.0) -> DataFrame:
    """``m`` with ``valid`` and ``score`` from its metric columns, by fixed weights; ``voxel`` is the volume of one."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    contrast, repro = F.tanh(c("median_contrast") / 5.0), 1 / (1 + F.col("count_cv"))
    clean = (1 - F.col("frac_tiny")) * (1 - F.col("frac_huge"))
    if expect:
        shape = 0.6 * range_score(equivalent_diameter(c("median_vol") * voxel), *expect["eq_diam"]) + 0.4 * clean
        score = 0.85 * (0.45 * range_score(c("median_count"), *expect["count"]) + 0.30 * shape + 0.25 * range_score(c("median_fill"), *expect["coverage"])) + 0.15 * (0.5 * contrast + 0.5 * repro)
    else:
        fill = bump_score(c("median_fill"), 0.002, 0.25)
        noisy = 0.45 * contrast + 0.30 * repro + 0.10 * fill + 0.15 * clean
        clear = 0.30 * contrast + 0.20 * repro + 0.25 * fill + 0.25 * clean
        score = F.when(F.col("snr") < 8, noisy).otherwise(clear)
    valid = (c("median_count") >= 1) & (c("median_fill") < 0.6) & (c("median_count") < 5000)
    return m.withColumn("valid", valid).withColumn("score", F.when(F.col("valid"), score).otherwise(score * 0.05))


def halving(rounds: DataFrame, run: list[str], score: str, confidence: str, tie: str, keep: tuple[int, ...] = KEEP) -> DataFrame:
    """Arms with their rank in the round and whether the schedule keeps them."""
    w = Window.partitionBy(*run, "round").orderBy(F.col(score).desc_nulls_last(), F.col(confidence).desc_nulls_last(), tie)
    most = F.element_at(F.array(*[F.lit(k) for k in keep]), F.least(F.greatest(F.col("round"), F.lit(1)), F.lit(len(keep))))
    return rounds.withColumn("rk", F.row_number().over(w)).withColumn("keep", F.col("rk") <= most)


def convergence(best: DataFrame, arm: list[str], min_rounds: int = 2, eps: float = 0.01, strong: float = 0.5) -> DataFrame:
    """Arms still improving over the last ``min_rounds`` or already strong; too few rounds count as converging."""
    w = Window.partitionBy(*arm).orderBy("round")
    rows = best.withColumn("first_recent", F.lag("best", min_rounds - 1).over(w)).withColumn("n", F.row_number().over(w))
    return rows.withColumn("converging", (F.col("n") < min_rounds) | (F.col("best") >= F.col("first_recent") + eps) | (F.col("best") >= strong))


def count_band(rounds: DataFrame, group: list[str], count: str, score: str, tie: str) -> DataFrame:
    """``rounds`` with ``anchor``, the count of the best round of the group that has one, and ``in_band``: within half to twice of it, both included."""
    best = rounds.where(F.col(score).isNotNull() & F.col(count).isNotNull()).groupBy(*[F.col(g).alias(f"b_{g}") for g in group]).agg(F.max_by(count, F.struct(F.col(score), -F.col(tie))).alias("anchor"))
    return rounds.join(best, same(group, "b_"), "left").drop(*[f"b_{g}" for g in group]).withColumn("in_band", F.col(count).between(0.5 * F.col("anchor"), 2 * F.col("anchor")))


def merged_params(old: Column, new: Column) -> Column:
    """Two maps as one; of a key in both the right one's value holds."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
