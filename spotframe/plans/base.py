"""Cleaned base tables that many queries read, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import finite
from spotframe.session import table

MARKERS = ["Brd4", "DAPI", "Pol2", "Sc35"]


def spots(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Each spot once (latest delivery), one spelling of marker and condition, bad measures NULL."""
    rows = table(spark, sf_dir, "foci")
    good = lambda c: F.when(F.col(c) >= 0, finite(F.col(c).cast("double")))
    w = Window.partitionBy("focus_id").orderBy(F.col("ingested_at").desc(), "acquired_at")
    marker = F.initcap(F.trim("marker"))
    narrow = rows.select(
        "focus_id",
        "ingested_at",
        "acquired_at",
        "fov",
        "nucleus",
        F.when(marker == "Dapi", "DAPI").otherwise(marker).alias("marker"),
        F.lower(F.trim("condition")).alias("condition"),
        "spot_label",
        good("volume_um3").alias("volume"),
        good("mean_intensity").alias("intensity"),
        good("integrated_intensity").alias("integrated"),
        *[F.col(c).cast("double").alias(c[4]) for c in ("com_z_um", "com_y_um", "com_x_um")],
        F.coalesce("is_bead", F.lit(False)).alias("is_bead"),
        *more,
    )
    return narrow.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "ingested_at")


SPOTS = """
spots AS (
  SELECT focus_id, acquired_at, fov, nucleus, CASE WHEN lower(trim(marker)) = 'dapi' THEN 'DAPI' ELSE upper(substr(trim(marker), 1, 1)) || lower(substr(trim(marker), 2)) END AS marker,
         lower(trim(condition)) AS condition, spot_label,
         CASE WHEN volume_um3 >= 0 AND lower(CAST(volume_um3 AS VARCHAR)) NOT IN ('nan', 'inf', 'infinity') THEN CAST(volume_um3 AS DOUBLE) END AS volume,
         CASE WHEN mean_intensity >= 0 AND lower(CAST(mean_intensity AS VARCHAR)) NOT IN ('nan', 'inf', 'infinity') THEN CAST(mean_intensity AS DOUBLE) END AS intensity,
         CASE WHEN integrated_intensity >= 0 AND lower(CAST(integrated_intensity AS VARCHAR)) NOT IN ('nan', 'inf', 'infinity') THEN CAST(integrated_intensity AS DOUBLE) END AS integrated,
         CAST(com_z_um AS DOUBLE) AS z, CAST(com_y_um AS DOUBLE) AS y, CAST(com_x_um AS DOUBLE) AS x, coalesce(is_bead, false) AS is_bead
  FROM (SELECT *, row_number() OVER (PARTITION BY focus_id ORDER BY ingested_at DESC, acquired_at) AS rn FROM foci) WHERE rn = 1)
"""


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nucleus once: of repeated rows the greatest non-NULL value of each column."""
    rows = table(spark, sf_dir, "nucleus_metrics")
    out = rows.groupBy("fov", F.col("label").alias("nucleus")).agg(
        F.max("volume_vox").alias("volume_vox"), F.max(finite(F.col("volume_um3"))).alias("nucleus_volume_um3"), F.max(finite(F.col("circularity"))).alias("circularity"), F.max("kept").alias("kept")
    )
    return out.where("fov IS NOT NULL AND nucleus IS NOT NULL")


NUCLEI = """
nuclei AS (
  SELECT fov, label AS nucleus, max(volume_vox) AS volume_vox, max(CASE WHEN NOT isnan(volume_um3) AND NOT isinf(volume_um3) THEN volume_um3 END) AS nucleus_volume_um3,
         max(CASE WHEN NOT isnan(circularity) AND NOT isinf(circularity) THEN circularity END) AS circularity, max(kept) AS kept
  FROM nucleus_metrics WHERE fov IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)
"""


class Registry:
    """Queries and their SQL of one module."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
