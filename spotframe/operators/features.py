"""Artefact flags, per-object features and co-localization on long spot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotframe.functions.exprs import safe_ratio


def by_marker(values: dict[str, float | None]) -> Column:
    """A number per marker as a CASE expression: the thresholds are configuration, so no join is needed."""
    out = F.lit(None).cast("double")
    for m, v in values.items():
        if v is not None:
            out = F.when(F.col("marker") == m, F.lit(float(v))).otherwise(out)
    return out


def bead_flag(intensity: Column, diameter: Column, least_intensity: dict[str, float], least_diameter: dict[str, float | None] | None = None) -> Column:
    """True where the intensity reaches the marker's threshold and, if one is set, the diameter does too.

    NULL, NaN and markers without a threshold give false.
    """
    lit = by_marker(least_intensity)
    size = by_marker(least_diameter or {})
    ok = ~F.isnan(intensity) & (intensity >= lit) & (size.isNull() | (~F.isnan(diameter) & (diameter >= size)))
    return F.coalesce(ok, F.lit(False))


def nucleus_marker_features(spots: DataFrame, nuclei: DataFrame, totals: DataFrame, markers: list[str], voxel: float) -> DataFrame:
    """One row per nucleus and marker; nuclei without spots of a marker get zeros.

    ``spots``: fov, nucleus, marker, volume, intensity, integrated, is_bead, local_dapi.
    ``nuclei``: fov, nucleus, nucleus_volume_um3, volume_vox. ``totals``: fov, nucleus, marker,
    ``total``, the image's sum over the nucleus. ``voxel``: volume of a voxel. Beads are counted
    apart, enter no other figure, and leave the total. One spot has no spread, so its
    ``vol_cv`` is NULL, as ``local_dapi`` is without spots, and ``partition_coefficient``
    where nothing is left beside the spots.
    """
    ok = ~F.col("is_bead")
    kept = lambda c: F.when(ok, F.col(c))
    agg = spots.where("nucleus <> 0").groupBy("fov", "nucleus", "marker").agg(
        F.count_if(ok).alias("n"),
        F.count_if(F.col("is_bead")).alias("beads"),
        F.avg(kept("volume")).alias("mean"),
        F.percentile(kept("volume"), F.lit(0.5)).alias("median"),
        F.stddev_samp(kept("volume")).alias("std"),
        F.sum(kept("integrated")).alias("foci_int"),
        F.sum(F.when(F.col("is_bead"), F.col("integrated"))).alias("bead_int"),
        F.avg(kept("intensity")).alias("mean_int"),
        F.avg(kept("local_dapi")).alias("local_dapi"),
    )
    grid = nuclei.select("fov", "nucleus", "nucleus_volume_um3", "volume_vox", F.explode(F.array(*[F.lit(m) for m in markers])).alias("marker"))
    rows = grid.join(agg, ["fov", "nucleus", "marker"], "left").join(totals, ["fov", "nucleus", "marker"], "left")
    rows = rows.fillna(0, ["n", "beads", "mean", "median", "foci_int", "bead_int", "mean_int", "total", "volume_vox"])
    rows = rows.withColumn("total", F.greatest(F.col("total") - F.col("bead_int"), F.col("foci_int"))).withColumn("foci_vox", F.col("mean") * F.col("n") / F.lit(voxel))
    inside = F.when(F.col("foci_vox") > 0, F.col("foci_int") / F.greatest(F.col("foci_vox"), F.lit(1.0))).otherwise(0.0)
    beside = (F.col("total") - F.col("foci_int")) / F.greatest(F.col("volume_vox") - F.col("foci_vox"), F.lit(1.0))
    return rows.select(
        "fov",
        "nucleus",
        "marker",
        "nucleus_volume_um3",
        F.col("n").alias("n_foci"),
        F.col("beads").alias("n_beads"),
        F.coalesce(safe_ratio(F.col("n"), F.col("nucleus_volume_um3")), F.lit(0.0)).alias("density_per_um3"),
        F.col("mean").alias("vol_mean"),
        F.col("median").alias("vol_median"),
        F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean")).alias("vol_cv"),
        F.coalesce(safe_ratio(F.col("foci_int"), F.col("total")), F.lit(0.0)).alias("condensed_fraction"),
        safe_ratio(inside, beside).alias("partition_coefficient"),
        F.col("mean_int").alias("mean_intensity"),
        "local_dapi",
    )


def coloc_features(nn: DataFrame, partners: DataFrame, nuclei: DataFrame, radius: float, pair: tuple[str, ...] = ()) -> DataFrame:
    """Per nucleus: share of spots with a partner strictly nearer than ``radius``, median distance, enrichment.

    Expected by chance: ``1 - (1 - min(ball / nucleus volume, 1)) ** n_partners``; NULL where it
    isn't positive. Spots without a distance don't count. ``pair``: columns of ``nn`` and
    ``nuclei`` that tell marker pairs apart; the last is the partner's marker, as in ``partners``.
    """
    key = ["fov", "nucleus", *pair]
    obs = nn.where("nn_dist IS NOT NULL").groupBy(*key).agg(F.avg((F.col("nn_dist") < radius).cast("double")).alias("frac"), F.percentile("nn_dist", F.lit(0.5)).alias("nn_um"))
    n_b = partners.groupBy("fov", "nucleus", *pair[-1:]).agg(F.count("*").alias("n_partners"))
    ball = 4.0 / 3.0 * 3.141592653589793 * radius**3
    rows = nuclei.join(n_b, ["fov", "nucleus", *pair[-1:]], "left").join(obs, key, "left").withColumn("n_partners", F.coalesce("n_partners", F.lit(0)))
    expected = 1 - F.pow(1 - F.least(F.lit(ball) / F.col("nucleus_volume_um3"), F.lit(1.0)), F.col("n_partners"))
    return rows.withColumn("enrich", safe_ratio(F.col("frac"), expected)).select(*key, "n_partners", "frac", "nn_um", "enrich")
