"""Queries on voxel images, masks and beads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.operators import geometry, joins, voxels
from spotframe.plans.base import SPOTS, Registry, spots
from spotframe.plans.measurements import _IMAGE, image, nucleus_mask, spot_places
from spotframe.session import cut

query = Registry()
QUERIES, SQL = query.queries, query.sql
R = F.round


@query(_IMAGE + "SELECT focus_id, mask.nucleus FROM places LEFT JOIN mask USING (fov, z, y, x)")
def spot_nucleus_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nucleus that the mask has at each spot's voxel; NULL outside."""
    places = cut(spot_places(spark, sf_dir))
    return places.drop("nucleus").join(nucleus_mask(places), ["fov", *voxels.PLACE], "left").select("focus_id", "nucleus")


@query(_IMAGE + """, painted AS (SELECT fov, marker, z, y, x, max(spot_label) AS spot_label FROM places GROUP BY 1, 2, 3, 4, 5), n AS (SELECT fov, marker, spot_label, count(*) AS n FROM painted GROUP BY 1, 2, 3)
SELECT focus_id, coalesce(n, 0) AS n_voxels FROM spots LEFT JOIN n USING (fov, marker, spot_label)""")
def label_spot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with the voxels of a label volume that carry their label; of several labels in a voxel the greatest is painted."""
    painted = spot_places(spark, sf_dir).groupBy("fov", "marker", *voxels.PLACE).agg(F.max("spot_label").alias("spot_label"))
    n = painted.groupBy("fov", "marker", "spot_label").agg(F.count("*").alias("n"))
    return spots(spark, sf_dir).join(n, ["fov", "marker", "spot_label"], "left").select("focus_id", F.coalesce("n", F.lit(0)).alias("n_voxels"))


@query(f"""WITH {SPOTS}, b AS (SELECT focus_id, fov, marker, z, y + 0.4 AS y, x - 0.3 AS x FROM spots WHERE marker = 'Pol2' AND lower(CAST(z + y + x AS VARCHAR)) <> 'nan'),
p AS (SELECT a.focus_id, b.focus_id AS partner, sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d FROM spots a JOIN b ON a.fov = b.fov AND a.marker = 'Brd4' AND abs(a.z - b.z) <= 3 AND lower(CAST(a.z + a.y + a.x AS VARCHAR)) <> 'nan'
      AND abs(a.y - b.y) <= 5 AND abs(a.x - b.x) <= 5)
SELECT focus_id, arg_min(partner, (d, partner)) AS partner, round(min(d), 5) AS distance FROM p WHERE d <= 5 GROUP BY 1""")
def bead_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two channels matched after a coarse shift: nearest within 5 in the plane and 3 in depth."""
    s = cut(spots(spark, sf_dir).select("focus_id", "fov", "marker", "z", "y", "x"))
    other = s.where("marker = 'Pol2'").withColumns({"y": F.col("y") + 0.4, "x": F.col("x") - 0.3})
    return joins.nearest_match(s.where("marker = 'Brd4'"), other, ["fov"], "focus_id", 5.0, ["y", "x"], "z").select("focus_id", "partner", R("distance", 5).alias("distance"))


@query(f"""WITH {SPOTS}, b AS (SELECT focus_id, fov, z, y, x FROM spots WHERE marker = 'Pol2' AND lower(CAST(z + y + x AS VARCHAR)) <> 'nan'),
p AS (SELECT a.fov, a.x, a.y, b.x AS u, b.y AS v, row_number() OVER (PARTITION BY a.focus_id ORDER BY sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), b.focus_id) AS rn
      FROM spots a JOIN b ON a.fov = b.fov AND a.marker = 'Brd4' AND lower(CAST(a.z + a.y + a.x AS VARCHAR)) <> 'nan' AND sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) <= 10),
m AS (SELECT fov, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p WHERE rn = 1 GROUP BY 1),
g AS (SELECT fov, mx, my, mu, mv, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS a FROM p JOIN m USING (fov) WHERE rn = 1 GROUP BY ALL)
SELECT fov, round(a, 6) AS angle, round(mu - cos(a) * mx + sin(a) * my, 4) AS dx, round(mv - sin(a) * mx - cos(a) * my, 4) AS dy FROM g""")
def rigid_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation and shift of each field of view between two channels, from nearest matches within 10."""
    s = cut(spots(spark, sf_dir).select("focus_id", "fov", "marker", "z", "y", "x"))
    m = joins.nearest_match(s.where("marker = 'Brd4'"), s.where("marker = 'Pol2'"), ["fov"], "focus_id", 10.0, ["y", "x"])
    other = s.select(F.col("focus_id").alias("partner"), F.col("x").alias("u"), F.col("y").alias("v"))
    pairs = cut(m.join(s.select("focus_id", "x", "y"), "focus_id").join(other, "partner"))
    return geometry.rigid_fit(pairs, ["fov"]).select("fov", R("angle", 6).alias("angle"), R("dx", 4).alias("dx"), R("dy", 4).alias("dy"))


@query(f"""WITH {SPOTS}, r AS (SELECT focus_id, fov, marker, row_number() OVER (PARTITION BY fov, marker ORDER BY intensity DESC, focus_id) AS rank FROM spots WHERE intensity < 5000)
SELECT focus_id, fov, marker, rank FROM r WHERE rank <= 20""")
def bead_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 brightest spots of each field and marker that aren't saturated."""
    s = spots(spark, sf_dir).select("fov", "marker", "focus_id", "intensity")
    return voxels.brightest(s, ["fov", "marker"], "intensity", 20, 5000.0).select("focus_id", "fov", "marker", "rank")


@query(_IMAGE + """, t AS (SELECT fov, marker, quantile_cont(v, 0.999) AS top FROM image GROUP BY 1, 2)
SELECT fov, marker, z, y, x, round(least(greatest(v / CASE WHEN top > 0 THEN top ELSE 1 END, 0), 1), 6) AS v FROM image JOIN t USING (fov, marker)""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image scaled to 0..1 by its 99.9th percentile per field and marker."""
    return voxels.unit_scaled(cut(image(spot_places(spark, sf_dir))), ["fov", "marker"]).withColumn("v", R("v", 6))


@query(_IMAGE + """, i AS (SELECT * FROM image JOIN mask USING (fov, z, y, x)), t AS (SELECT fov, nucleus, marker, quantile_cont(v, 0.6) AS t FROM i GROUP BY 1, 2, 3)
SELECT fov, nucleus, marker, count(*) AS n_voxels, round(min(v), 3) AS least FROM i JOIN t USING (fov, nucleus, marker) WHERE v > t GROUP BY 1, 2, 3""")
def floor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each nucleus above the 60th percentile of its values, per marker."""
    places = cut(spot_places(spark, sf_dir))
    kept = voxels.floor_mask(image(places), nucleus_mask(places), ["fov"], "nucleus", "marker", 0.6)
    return kept.groupBy("fov", "nucleus", "marker").agg(F.count("*").alias("n_voxels"), R(F.min("v"), 3).alias("least"))


@query(_IMAGE + """, i AS (SELECT * FROM image JOIN mask USING (fov, z, y, x)), m AS (SELECT fov, marker, 1.5 * avg(v) AS t FROM (SELECT fov, marker, y, x, max(v) AS v FROM image GROUP BY 1, 2, 3, 4) WHERE v > 0 GROUP BY 1, 2),
f AS (SELECT i.*, v > t AS fg FROM i JOIN m USING (fov, marker)), b AS (SELECT fov, nucleus, marker, median(v) AS med FROM f WHERE NOT fg GROUP BY 1, 2, 3),
d AS (SELECT fov, nucleus, marker, any_value(med) AS med, median(abs(v - med)) * 1.4826 AS mad FROM f JOIN b USING (fov, nucleus, marker) WHERE NOT fg GROUP BY 1, 2, 3)
SELECT fov, nucleus, marker, count(*) AS n_voxels, round(avg(CASE WHEN fg THEN 1 ELSE 0 END), 6) AS fill, round(coalesce(any_value(med), 0), 3) AS bg_median, round(coalesce(nullif(any_value(mad), 0), 1), 1) AS bg_mad
FROM f LEFT JOIN d USING (fov, nucleus, marker) GROUP BY 1, 2, 3""")
def cell_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill and background of each nucleus and marker, from voxels above a multiple of the mean projection."""
    places = cut(spot_places(spark, sf_dir))
    picture = cut(image(places))
    fg = voxels.detect(picture, ["fov", "marker"], "mean_fold")
    m = voxels.cell_metrics(picture, nucleus_mask(places), fg, ["fov"], "nucleus", "marker")
    return m.select("fov", "nucleus", "marker", "n_voxels", R("fill", 6).alias("fill"), R("bg_median", 3).alias("bg_median"), R("bg_mad", 1).alias("bg_mad"))
