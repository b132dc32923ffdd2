"""Queries over spots and nuclei: calibration, flags, features, co-localization and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.functions import exprs
from spotframe.operators import features, joins, stats, voxels
from spotframe.plans.base import MARKERS, NUCLEI, SPOTS, Registry, nuclei, spots
from spotframe.session import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

R = F.round
VOXEL = 0.108 * 0.108 * 0.3
BEAD_INTENSITY = {"Brd4": 2600.0, "Sc35": 2600.0, "Pol2": 2400.0, "DAPI": 400.0}
BEAD_DIAMETER = {"DAPI": 1.2}
BEAD_SQL = "coalesce(CASE marker WHEN 'DAPI' THEN intensity >= 400 AND diam >= 1.2 WHEN 'Pol2' THEN intensity >= 2400 ELSE intensity >= 2600 END, false)"


@query(f"""WITH {SPOTS}
SELECT focus_id, round(volume / {VOXEL}, 4) AS voxels, round(CASE WHEN volume > 0 THEN pow(volume * (6 / pi()), 1.0 / 3) WHEN volume IS NOT NULL THEN 0 END, 6) AS eq_diam,
       round(intensity * volume / {VOXEL}, 3) AS integrated FROM spots""")
def scan_project_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical calibration: voxel counts, equivalent diameter and integrated intensity."""
    s = spots(spark, sf_dir)
    vox = F.col("volume") / F.lit(VOXEL)
    return s.select("focus_id", R(vox, 4).alias("voxels"), R(exprs.equivalent_diameter(F.col("volume")), 6).alias("eq_diam"), R(F.col("intensity") * F.col("volume") / F.lit(VOXEL), 3).alias("integrated"))


@query(f"""WITH {SPOTS}
SELECT printf('fov%03d_%s_%d', fov, marker, spot_label) AS spot_key, printf('fov%03d_n%d', fov, nucleus) AS nucleus_key, focus_id FROM spots""")
def composite_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of spots and nuclei composed from their keys."""
    return spots(spark, sf_dir).select(exprs.spot_id(F.col("fov"), F.col("marker"), F.col("spot_label")).alias("spot_key"), exprs.nucleus_id(F.col("fov"), F.col("nucleus")).alias("nucleus_key"), "focus_id")


@query(f"""WITH {SPOTS}, d AS (SELECT *, CASE WHEN volume > 0 THEN pow(volume * (6 / pi()), 1.0 / 3) WHEN volume IS NOT NULL THEN 0 END AS diam FROM spots)
SELECT focus_id, {BEAD_SQL} AS bead FROM d""")
def bead_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artefact flag by marker thresholds on intensity and diameter."""
    flag = features.bead_flag(F.col("intensity"), exprs.equivalent_diameter(F.col("volume")), BEAD_INTENSITY, BEAD_DIAMETER)
    return spots(spark, sf_dir).select("focus_id", flag.alias("bead"))


@query(f"""WITH {SPOTS}
SELECT marker, count(*) AS n_total, count(*) FILTER (WHERE is_bead) AS n_beads, round(100.0 * count(*) FILTER (WHERE is_bead) / count(*), 4) AS percent FROM spots GROUP BY 1""")
def bead_qc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beads per marker, in numbers and percent."""
    n = F.count_if("is_bead")
    return spots(spark, sf_dir).groupBy("marker").agg(F.count("*").alias("n_total"), n.alias("n_beads"), R(100.0 * n / F.count("*"), 4).alias("percent"))


@query(f"""WITH {NUCLEI}
SELECT fov, nucleus, nucleus_volume_um3, circularity FROM nuclei
WHERE kept = 1 AND NOT coalesce(nucleus_volume_um3 < 150, false) AND NOT coalesce(nucleus_volume_um3 > 900, false) AND NOT coalesce(circularity < 0.7, false)""")
def nucleus_qc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept nuclei inside the optional bounds; a missing measure is not rejected."""
    v, c = F.col("nucleus_volume_um3"), F.col("circularity")
    reject = F.coalesce(v < 150, F.lit(False)) | F.coalesce(v > 900, F.lit(False)) | F.coalesce(c < 0.7, F.lit(False))
    return nuclei(spark, sf_dir).where((F.col("kept") == 1) & ~reject).select("fov", "nucleus", "nucleus_volume_um3", "circularity")


#: Edges of a voxel of the image that is made from spots.
SIZE = (1.0, 2.0, 2.0)


def spot_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with their voxel as ``z``, ``y``, ``x``; those without a place drop out."""
    s = spots(spark, sf_dir)
    return s.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "zyx")).withColumns({c: F.floor(F.col(c) / k).cast("int") for c, k in zip("zyx", SIZE)})


def image(places: DataFrame) -> DataFrame:
    """A voxel image per field of view and marker: integrated intensities with half as much one step around them."""
    v = places.where("integrated IS NOT NULL").select("fov", "marker", *voxels.PLACE, F.col("integrated").alias("v"))
    near = voxels.around(False)
    rows = voxels._shifted(v, ["fov", "marker"], near, [0.5 ** sum(map(abs, o)) for o in near])
    return rows.groupBy("fov", "marker", *voxels.PLACE).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def nucleus_mask(places: DataFrame) -> DataFrame:
    """The voxels of each nucleus: those of its spots and one step around; of several nuclei the smallest has it."""
    v = places.where("nucleus <> 0").groupBy("fov", *voxels.PLACE, "nucleus").agg(F.lit(1).alias("v"))
    return voxels._shifted(v, ["fov", "nucleus"], voxels.around(False)).groupBy("fov", *voxels.PLACE).agg(F.min("nucleus").alias("nucleus"))


def nucleus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = cut(spot_places(spark, sf_dir))
    picture = cut(image(places))
    totals = voxels.label_totals(picture, nucleus_mask(places), ["fov"], "nucleus", "marker")
    dapi = voxels.local_sums(places.where("nucleus <> 0 AND NOT is_bead"), picture.where("marker = 'DAPI'"), ["fov"], "marker").drop("marker").withColumnRenamed("local", "local_dapi")
    s = places.join(dapi, ["fov", *voxels.PLACE], "left").fillna(0.0, ["local_dapi"])
    # sums of a FLOAT's multiples are exact in any order, so the division comes last
    f = features.nucleus_marker_features(s, nuclei(spark, sf_dir).where("kept = 1"), totals, MARKERS, VOXEL)
    return f.withColumn("local_dapi", F.col("local_dapi") / 27)


_IMAGE = f"""WITH {SPOTS}, {NUCLEI},
places AS (SELECT * EXCLUDE (z, y, x), CAST(floor(z / 1.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x FROM spots WHERE z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL
  AND lower(CAST(z + y + x AS VARCHAR)) <> 'nan'),
near AS (SELECT a.d AS dz, b.d AS dy, c.d AS dx FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)),
image AS (SELECT fov, marker, z + dz AS z, y + dy AS y, x + dx AS x, sum(integrated * pow(0.5, abs(dz) + abs(dy) + abs(dx))) AS v FROM places, near WHERE integrated IS NOT NULL AND abs(dz) + abs(dy) + abs(dx) <= 1 GROUP BY 1, 2, 3, 4, 5),
mask AS (SELECT fov, z + dz AS z, y + dy AS y, x + dx AS x, min(nucleus) AS nucleus FROM places, near WHERE nucleus <> 0 AND abs(dz) + abs(dy) + abs(dx) <= 1 GROUP BY 1, 2, 3, 4),
totals AS (SELECT fov, nucleus, marker, sum(v) AS total FROM image JOIN mask USING (fov, z, y, x) GROUP BY 1, 2, 3),
asked AS (SELECT DISTINCT fov, z, y, x FROM places WHERE nucleus <> 0),
local AS (SELECT q.fov, q.z, q.y, q.x, i.marker, sum(i.v) AS whole, sum(i.v) / 27 AS local FROM asked q CROSS JOIN near JOIN image i ON i.fov = q.fov AND i.z = q.z + dz AND i.y = q.y + dy AND i.x = q.x + dx GROUP BY 1, 2, 3, 4, 5)
"""
_FEATURES = _IMAGE + f""",
agg AS (SELECT p.fov, nucleus, p.marker, count(*) FILTER (WHERE NOT is_bead) AS n_foci, count(*) FILTER (WHERE is_bead) AS n_beads,
        avg(volume) FILTER (WHERE NOT is_bead) AS vol_mean, median(volume) FILTER (WHERE NOT is_bead) AS vol_median, stddev_samp(volume) FILTER (WHERE NOT is_bead) AS vol_std,
        sum(integrated) FILTER (WHERE NOT is_bead) AS foci_int, sum(integrated) FILTER (WHERE is_bead) AS bead_int,
        avg(intensity) FILTER (WHERE NOT is_bead) AS mean_intensity, avg(coalesce(whole, 0)) FILTER (WHERE NOT is_bead) / 27 AS local_dapi
        FROM places p LEFT JOIN local l ON l.fov = p.fov AND l.z = p.z AND l.y = p.y AND l.x = p.x AND l.marker = 'DAPI' WHERE nucleus <> 0 GROUP BY 1, 2, 3),
grid AS (SELECT fov, nucleus, nucleus_volume_um3, volume_vox, marker FROM nuclei, (VALUES ('Brd4'), ('DAPI'), ('Pol2'), ('Sc35')) t(marker) WHERE kept = 1),
j AS (SELECT grid.*, coalesce(n_foci, 0) AS n_foci, coalesce(n_beads, 0) AS n_beads, coalesce(vol_mean, 0) AS vol_mean, coalesce(vol_median, 0) AS vol_median, vol_std, coalesce(foci_int, 0) AS fi,
      greatest(coalesce(total, 0) - coalesce(bead_int, 0), coalesce(foci_int, 0)) AS ti, coalesce(vol_mean, 0) * coalesce(n_foci, 0) / {VOXEL} AS fv, coalesce(volume_vox, 0) AS nv,
      coalesce(mean_intensity, 0) AS mean_intensity, local_dapi FROM grid LEFT JOIN agg USING (fov, nucleus, marker) LEFT JOIN totals USING (fov, nucleus, marker)),
f AS (SELECT fov, nucleus, marker, n_foci, n_beads, CASE WHEN nucleus_volume_um3 > 0 THEN n_foci / nucleus_volume_um3 ELSE 0 END AS density_per_um3, vol_mean, vol_median,
      CASE WHEN vol_mean = 0 THEN 0 ELSE vol_std / vol_mean END AS vol_cv, CASE WHEN ti > 0 THEN fi / ti ELSE 0 END AS condensed_fraction,
      CASE WHEN (ti - fi) / greatest(nv - fv, 1) > 0 THEN CASE WHEN fv > 0 THEN fi / greatest(fv, 1) ELSE 0 END / ((ti - fi) / greatest(nv - fv, 1)) END AS partition_coefficient,
      mean_intensity, local_dapi FROM j)
"""


@query(_FEATURES + """SELECT fov, nucleus, marker, n_foci, n_beads, round(density_per_um3, 8) AS density_per_um3, round(vol_mean, 6) AS vol_mean, round(vol_median, 6) AS vol_median, round(vol_cv, 6) AS vol_cv,
round(condensed_fraction, 6) AS condensed_fraction, round(partition_coefficient, 4) AS partition_coefficient, round(mean_intensity, 4) AS mean_intensity, round(local_dapi, 1) AS local_dapi FROM f""")
def nucleus_marker_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nucleus and marker: counts, density, volumes, condensed fraction, partition coefficient, local DAPI."""
    f = nucleus_features(spark, sf_dir)
    places = {"density_per_um3": 8, "vol_mean": 6, "vol_median": 6, "vol_cv": 6, "condensed_fraction": 6, "partition_coefficient": 4, "mean_intensity": 4, "local_dapi": 1}
    return f.select("fov", "nucleus", "marker", "n_foci", "n_beads", *[R(c, k).alias(c) for c, k in places.items()])


@query(_IMAGE + """, m AS (SELECT fov, nucleus, count(*) AS n FROM mask GROUP BY 1, 2)
SELECT focus_id, l.marker AS channel, round(l.local, 3) AS local, round(l.local / (total / n), 6) AS enrichment FROM places p JOIN local l ON l.fov = p.fov AND l.z = p.z AND l.y = p.y AND l.x = p.x
LEFT JOIN totals t ON t.fov = p.fov AND t.nucleus = p.nucleus AND t.marker = l.marker LEFT JOIN m ON m.fov = p.fov AND m.nucleus = p.nucleus WHERE p.nucleus <> 0""")
def spot_local_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's local mean at each spot, and that over the channel's mean in the spot's nucleus."""
    places = cut(spot_places(spark, sf_dir).where("nucleus IS NOT NULL"))
    picture, mask = cut(image(places)), cut(nucleus_mask(places))
    local = voxels.local_means(places.where("nucleus <> 0"), picture, ["fov"], "marker").withColumnRenamed("marker", "channel")
    mean = voxels.label_totals(picture, mask, ["fov"], "nucleus", "marker").join(mask.groupBy("fov", "nucleus").agg(F.count("*").alias("n")), ["fov", "nucleus"])
    mean = mean.select("fov", "nucleus", F.col("marker").alias("channel"), (F.col("total") / F.col("n")).alias("mean"))
    rows = places.where("nucleus <> 0").select("focus_id", "fov", "nucleus", *voxels.PLACE).join(local, ["fov", *voxels.PLACE]).join(mean, ["fov", "nucleus", "channel"], "left")
    return rows.select("focus_id", "channel", R("local", 3).alias("local"), R(exprs.safe_ratio(F.col("local"), F.col("mean")), 6).alias("enrichment"))


_EDGE = "CASE 1 + 2 * s + 10 * d WHEN 5 THEN 1 WHEN 7 THEN 1 WHEN 15 THEN 1 WHEN 17 THEN 1 WHEN 25 THEN 1 WHEN 27 THEN 1 WHEN 21 THEN sqrt(2) WHEN 33 THEN sqrt(2) WHEN 13 THEN (1 + sqrt(2)) / 2 WHEN 23 THEN (1 + sqrt(2)) / 2 ELSE 0 END"


@query(_IMAGE + f""", flat AS (SELECT DISTINCT fov, nucleus, y, x FROM mask), way AS (SELECT dy, dx, abs(dy) + abs(dx) AS far FROM near WHERE dz = 0 AND (dy <> 0 OR dx <> 0)),
border AS (SELECT f.* FROM flat f CROSS JOIN way LEFT JOIN flat g ON g.fov = f.fov AND g.nucleus = f.nucleus AND g.y = f.y + dy AND g.x = f.x + dx WHERE far = 1 GROUP BY ALL HAVING count(g.fov) < 4),
kind AS (SELECT b.fov, b.nucleus, b.y, b.x, count(c.fov) FILTER (WHERE far = 1) AS s, count(c.fov) FILTER (WHERE far = 2) AS d FROM border b CROSS JOIN way LEFT JOIN border c ON c.fov = b.fov AND c.nucleus = b.nucleus AND c.y = b.y + dy AND c.x = b.x + dx GROUP BY 1, 2, 3, 4),
p AS (SELECT fov, nucleus, sum({_EDGE}) AS p FROM kind GROUP BY 1, 2), a AS (SELECT fov, nucleus, count(*) AS a FROM flat GROUP BY 1, 2)
SELECT fov, nucleus, n_voxels, area, round(p, 6) AS perimeter, round(CASE WHEN p > 0 THEN 4 * pi() * a.area / (p * p) ELSE 0 END, 6) AS circularity, round(cz, 5) AS cz
FROM (SELECT fov, nucleus, count(*) AS n_voxels, avg(z) AS cz FROM mask GROUP BY 1, 2) m JOIN p USING (fov, nucleus) JOIN (SELECT fov, nucleus, a AS area FROM a) a USING (fov, nucleus)""")
def nucleus_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels, footprint area, perimeter and circularity of each nucleus of the mask."""
    shapes = voxels.label_shapes(cut(nucleus_mask(spot_places(spark, sf_dir))), ["fov"], "nucleus")
    return shapes.select("fov", "nucleus", "n_voxels", "area", R("perimeter", 6).alias("perimeter"), R("circularity", 6).alias("circularity"), R("cz", 5).alias("cz"))


@query(_FEATURES + "SELECT fov, nucleus, " + ", ".join(f"max(n_foci) FILTER (WHERE marker = '{m}') AS \"{m}_n_foci\", round(max(vol_mean) FILTER (WHERE marker = '{m}'), 6) AS \"{m}_vol_mean\"" for m in MARKERS) + " FROM f GROUP BY 1, 2")
def wide_nucleus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long features pivoted to one row per nucleus; the pivot values are given, so it is one pass."""
    p = nucleus_features(spark, sf_dir).groupBy("fov", "nucleus").pivot("marker", MARKERS)
    return p.agg(F.max("n_foci").alias("n_foci"), R(F.max("vol_mean"), 6).alias("vol_mean"))


@query(f"""WITH {SPOTS}
SELECT c.condition, coalesce(c.drug_target, 'none') AS drug_target, count(*) AS n_spots, count(DISTINCT s.fov) AS n_fovs
FROM spots s JOIN (SELECT * FROM conditions) c ON s.fov BETWEEN c.fov_start AND c.fov_end GROUP BY 1, 2""")
def fov_condition_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view assigned to conditions by inclusive ranges; gaps drop out."""
    assigned = joins.range_lookup(spots(spark, sf_dir).select("fov"), "fov", table(spark, sf_dir, "conditions"), "fov_start", "fov_end", ["condition", "drug_target"])
    return assigned.where("condition IS NOT NULL").groupBy("condition", F.coalesce("drug_target", F.lit("none")).alias("drug_target")).agg(F.count("*").alias("n_spots"), F.countDistinct("fov").alias("n_fovs"))


def brd4_to_pol2(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = cut(spots(spark, sf_dir).where("nucleus <> 0 AND marker IN ('Brd4', 'Pol2')").select("focus_id", "fov", "nucleus", "marker", "is_bead", "z", "y", "x"))
    partner = s.where("marker = 'Pol2' AND NOT is_bead")
    return joins.nearest(s.where("marker = 'Brd4'"), partner, ["fov", "nucleus"], ["z", "y", "x"]), partner


_NN = f"""WITH {SPOTS}, {NUCLEI},
b AS (SELECT * FROM spots WHERE nucleus <> 0 AND marker = 'Pol2' AND NOT is_bead),
nn AS (SELECT a.focus_id, any_value(a.fov) AS fov, any_value(a.nucleus) AS nucleus, any_value(a.is_bead) AS is_bead, sqrt(min((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS nn_dist
       FROM spots a LEFT JOIN b ON a.fov = b.fov AND a.nucleus = b.nucleus WHERE a.nucleus <> 0 AND a.marker = 'Brd4' GROUP BY a.focus_id)
"""


@query(_NN + "SELECT focus_id, round(nn_dist, 5) AS nn_dist FROM nn")
def nearest_neighbor_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each Brd4 spot's distance to the nearest Pol2 spot of its nucleus; beads ask but never answer."""
    nn, _ = brd4_to_pol2(spark, sf_dir)
    return nn.select("focus_id", R("nn_dist", 5).alias("nn_dist"))


_COLOC = _NN + """,
o AS (SELECT fov, nucleus, avg(CASE WHEN nn_dist < 1.0 THEN 1.0 ELSE 0.0 END) AS frac, median(nn_dist) AS nn_um FROM nn WHERE NOT is_bead AND nn_dist IS NOT NULL GROUP BY 1, 2),
n AS (SELECT fov, nucleus, count(*) AS n_partners FROM b GROUP BY 1, 2),
r AS (SELECT nuclei.fov, nuclei.nucleus, coalesce(n_partners, 0) AS n_partners, frac, nn_um, 1 - pow(1 - least(4.0 / 3 * pi() / nucleus_volume_um3, 1), coalesce(n_partners, 0)) AS expected
      FROM nuclei LEFT JOIN n USING (fov, nucleus) LEFT JOIN o USING (fov, nucleus) WHERE kept = 1 AND nucleus_volume_um3 > 0),
coloc AS (SELECT fov, nucleus, n_partners, frac, nn_um, CASE WHEN expected > 0 THEN frac / expected END AS enrich FROM r)
"""


def coloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn, partner = brd4_to_pol2(spark, sf_dir)
    kept = nuclei(spark, sf_dir).where("kept = 1 AND nucleus_volume_um3 > 0").select("fov", "nucleus", "nucleus_volume_um3")
    return features.coloc_features(nn.where("NOT is_bead"), partner, kept, 1.0)


@query(_COLOC + "SELECT fov, nucleus, n_partners, round(frac, 6) AS frac, round(nn_um, 5) AS nn_um, round(enrich, 4) AS enrich FROM coloc")
def coloc_fraction_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-localization fraction, median distance and enrichment over chance per nucleus."""
    return coloc(spark, sf_dir).select("fov", "nucleus", "n_partners", R("frac", 6).alias("frac"), R("nn_um", 5).alias("nn_um"), R("enrich", 4).alias("enrich"))


def coloc_figures(c: DataFrame, group: list[str]) -> DataFrame:
    """Mean, median and count of the fractions and the median enrichment, for groups of any size."""
    c = cut(c.select(*group, "frac", "enrich"))
    out = c.groupBy(*group).agg(R(F.avg("frac"), 6).alias("frac_mean"), F.count("frac").alias("frac_count"))
    for column, name, places in (("frac", "frac_median", 6), ("enrich", "enrich_median", 4)):
        out = out.join(stats.group_percentiles(c, group, column, {name: 0.5}).withColumn(name, R(name, places)), group, "left")
    return out


@query(_COLOC + """SELECT condition, round(avg(frac), 6) AS frac_mean, round(median(frac), 6) AS frac_median, count(frac) AS frac_count, round(median(enrich), 4) AS enrich_median
FROM coloc JOIN conditions ON fov BETWEEN fov_start AND fov_end GROUP BY 1""")
def coloc_summary_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and count of the co-localization columns per condition."""
    c = joins.range_lookup(coloc(spark, sf_dir), "fov", table(spark, sf_dir, "conditions"), "fov_start", "fov_end", ["condition"]).where("condition IS NOT NULL")
    return coloc_figures(c, ["condition"])


#: Fixed value: the pairs of the co-localization summaries.
PAIRS = [("Brd4", "Pol2"), ("Pol2", "Sc35"), ("Brd4", "Sc35")]


def nearest_of_pairs(spark: SparkSession, sf_dir: str, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Spots of marker ``a`` with the distance to the nearest spot of ``b``, for pairs (a, b); the partners."""
    s = cut(spots(spark, sf_dir).where("nucleus <> 0").where(F.col("marker").isin(MARKERS)).select("focus_id", "fov", "nucleus", "marker", "is_bead", "z", "y", "x"))
    others = lambda a: F.array(*[F.lit(b) for x, b in pairs if x == a])
    asked = F.explode(F.coalesce(*[F.when(F.col("marker") == a, others(a)) for a in dict(pairs)]))
    left = s.withColumn("b", asked).withColumnRenamed("marker", "a")
    partner = s.where("NOT is_bead").withColumnRenamed("marker", "b").where(F.col("b").isin([b for _, b in pairs]))
    return joins.nearest(left, partner, ["fov", "nucleus", "b"], ["z", "y", "x"]), partner


_NN_ALL = f"""WITH {SPOTS}, {NUCLEI},
b AS (SELECT fov, nucleus, marker AS b, z, y, x FROM spots WHERE nucleus <> 0 AND NOT is_bead),
pairs AS (SELECT p.a, q.b FROM (VALUES ('Brd4'), ('DAPI'), ('Pol2'), ('Sc35')) p(a), (VALUES ('Brd4'), ('DAPI'), ('Pol2'), ('Sc35')) q(b) WHERE p.a <> q.b),
nn AS (SELECT s.focus_id, pairs.a, pairs.b, any_value(s.fov) AS fov, any_value(s.nucleus) AS nucleus, any_value(s.is_bead) AS is_bead, sqrt(min((s.z - b.z) * (s.z - b.z) + (s.y - b.y) * (s.y - b.y) + (s.x - b.x) * (s.x - b.x))) AS nn_dist
       FROM spots s JOIN pairs ON s.marker = pairs.a LEFT JOIN b ON s.fov = b.fov AND s.nucleus = b.nucleus AND pairs.b = b.b WHERE s.nucleus <> 0 GROUP BY 1, 2, 3)
"""


@query(_NN_ALL + "SELECT focus_id, a, b, round(nn_dist, 5) AS nn_dist FROM nn")
def nearest_neighbor_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spot's distance to the nearest spot of every other marker of its nucleus; beads ask but never answer."""
    nn, _ = nearest_of_pairs(spark, sf_dir, [(a, b) for a in MARKERS for b in MARKERS if a != b])
    return nn.select("focus_id", "a", "b", R("nn_dist", 5).alias("nn_dist"))


_COLOC_ALL = _NN_ALL + """,
asked AS (SELECT * FROM (VALUES ('Brd4', 'Pol2'), ('Pol2', 'Sc35'), ('Brd4', 'Sc35')) t(a, b)),
o AS (SELECT fov, nucleus, a, b, avg(CASE WHEN nn_dist < 1.0 THEN 1.0 ELSE 0.0 END) AS frac, median(nn_dist) AS nn_um FROM nn WHERE NOT is_bead AND nn_dist IS NOT NULL GROUP BY 1, 2, 3, 4),
n AS (SELECT fov, nucleus, b, count(*) AS n_partners FROM b GROUP BY 1, 2, 3),
r AS (SELECT nuclei.fov, nuclei.nucleus, asked.a, asked.b, coalesce(n_partners, 0) AS n_partners, frac, nn_um, 1 - pow(1 - least(4.0 / 3 * pi() / nucleus_volume_um3, 1), coalesce(n_partners, 0)) AS expected
      FROM nuclei CROSS JOIN asked LEFT JOIN n ON nuclei.fov = n.fov AND nuclei.nucleus = n.nucleus AND asked.b = n.b
      LEFT JOIN o ON nuclei.fov = o.fov AND nuclei.nucleus = o.nucleus AND asked.a = o.a AND asked.b = o.b WHERE kept = 1 AND nucleus_volume_um3 > 0),
coloc AS (SELECT fov, nucleus, a, b, n_partners, frac, nn_um, CASE WHEN expected > 0 THEN frac / expected END AS enrich FROM r)
"""


def coloc_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nn, partner = nearest_of_pairs(spark, sf_dir, PAIRS)
    kept = nuclei(spark, sf_dir).where("kept = 1 AND nucleus_volume_um3 > 0").select("fov", "nucleus", "nucleus_volume_um3")
    grid = kept.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PAIRS]))).select(*kept.columns, "_p.a", "_p.b")
    return features.coloc_features(nn.where("NOT is_bead"), partner, grid, 1.0, ("a", "b"))


@query(_COLOC_ALL + "SELECT fov, nucleus, a, b, n_partners, round(frac, 6) AS frac, round(nn_um, 5) AS nn_um, round(enrich, 4) AS enrich FROM coloc")
def coloc_fraction_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-localization fraction, median distance and enrichment over chance per nucleus and marker pair."""
    return coloc_of_pairs(spark, sf_dir).select("fov", "nucleus", "a", "b", "n_partners", R("frac", 6).alias("frac"), R("nn_um", 5).alias("nn_um"), R("enrich", 4).alias("enrich"))


@query(_COLOC_ALL + """SELECT condition, a, b, round(avg(frac), 6) AS frac_mean, round(median(frac), 6) AS frac_median, count(frac) AS frac_count, round(median(enrich), 4) AS enrich_median
FROM coloc JOIN conditions ON fov BETWEEN fov_start AND fov_end GROUP BY 1, 2, 3""")
def coloc_summary_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and count of the co-localization columns per condition and marker pair."""
    c = joins.range_lookup(coloc_of_pairs(spark, sf_dir), "fov", table(spark, sf_dir, "conditions"), "fov_start", "fov_end", ["condition"]).where("condition IS NOT NULL")
    return coloc_figures(c, ["condition", "a", "b"])


def condition_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long spot values: feature = marker and measure, grp = condition."""
    s = spots(spark, sf_dir).where("NOT is_bead AND condition IS NOT NULL")
    return stats.to_long(s.select("marker", F.col("condition").alias("grp"), "volume", "intensity"), ["marker", "grp"], ["volume", "intensity"]).where("value IS NOT NULL")


_LONG = f"""WITH {SPOTS},
v AS (SELECT marker, condition AS grp, 'volume' AS feature, volume AS value FROM spots WHERE NOT is_bead AND condition IS NOT NULL AND volume IS NOT NULL
      UNION ALL SELECT marker, condition, 'intensity', intensity FROM spots WHERE NOT is_bead AND condition IS NOT NULL AND intensity IS NOT NULL),
g AS (SELECT DISTINCT marker, feature, grp FROM v WHERE grp <> 'control'),
x AS (SELECT g.marker, g.feature, g.grp, v.value, v.grp <> 'control' AS mine FROM g JOIN v ON g.marker = v.marker AND g.feature = v.feature AND (v.grp = g.grp OR v.grp = 'control')),
k AS (SELECT *, rank() OVER (PARTITION BY marker, feature, grp ORDER BY value) + (count(*) OVER (PARTITION BY marker, feature, grp, value) - 1) / 2.0 AS rk,
      count(*) OVER (PARTITION BY marker, feature, grp, value) AS t FROM x),
u AS (SELECT marker, feature, grp, count(*) FILTER (WHERE mine) AS na, count(*) FILTER (WHERE NOT mine) AS nb,
      sum(CAST(rk AS DOUBLE)) FILTER (WHERE mine) AS ra, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k GROUP BY 1, 2, 3),
s AS (SELECT marker, feature, grp, na, nb, ra - na * (na + 1) / 2.0 AS u, na * nb / 12.0 * ((na + nb + 1) - ties / (CAST(na + nb AS DOUBLE) * (na + nb - 1))) AS var FROM u),
st AS (SELECT *, CASE WHEN least(na, nb) >= 3 THEN 2 * u / (CAST(na AS DOUBLE) * nb) - 1 END AS cliffs_delta,
       CASE WHEN least(na, nb) >= 3 AND var > 0 THEN sign(u - na * nb / 2.0) * greatest(abs(u - na * nb / 2.0) - 0.5, 0) / sqrt(var) END AS z FROM s)
"""


@query(_LONG + "SELECT marker, feature, grp, na, nb, round(cliffs_delta, 6) AS cliffs_delta FROM st")
def cliffs_delta_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-based effect size of every condition against the control."""
    s = stats.rank_statistics(condition_values(spark, sf_dir), "control", ["marker", "feature"])
    return s.select("marker", "feature", "grp", "na", "nb", R("cliffs_delta", 6).alias("cliffs_delta"))


@query(_LONG + "SELECT marker, feature, grp, round(u, 1) AS u, round(z, 5) AS z FROM st")
def mann_whitney_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U and the tie- and continuity-corrected z of every condition against the control."""
    s = stats.rank_statistics(condition_values(spark, sf_dir), "control", ["marker", "feature"])
    return s.select("marker", "feature", "grp", R("u", 1).alias("u"), R("z", 5).alias("z"))


@query(_LONG + """, med AS (SELECT marker, feature, grp, median(value) AS m FROM v GROUP BY 1, 2, 3)
SELECT st.marker, st.feature, st.grp, round(cliffs_delta, 6) AS cliffs_delta, round(a.m, 6) AS median_cond, round(c.m, 6) AS median_ctrl FROM st JOIN med a USING (marker, feature, grp) JOIN med c ON c.marker = st.marker AND c.feature = st.feature AND c.grp = 'control'""")
def differential_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differential table without its p-values."""
    t = differential_table(spark, sf_dir)
    return t.select("marker", "feature", "grp", *[R(c, 6).alias(c) for c in ("cliffs_delta", "median_cond", "median_ctrl")])


@query()
def differential_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect size, p, adjusted p and both medians per condition and feature."""
    v = cut(condition_values(spark, sf_dir))
    s = stats.rank_statistics(v, "control", ["marker", "feature"]).withColumn("p", stats.two_sided_p("z"))
    med = cut(stats.group_percentiles(v, ["marker", "feature", "grp"], "value", {"median_cond": 0.5}))
    ctrl = med.where("grp = 'control'").select("marker", "feature", F.col("median_cond").alias("median_ctrl"))
    out = stats.bh_adjust(cut(s), ["grp"], "p").join(med, ["marker", "feature", "grp"]).join(ctrl, ["marker", "feature"])
    return out.select("marker", "feature", "grp", "cliffs_delta", "p", "padj", "median_cond", "median_ctrl")


@query(f"""WITH {SPOTS}, {NUCLEI},
p AS (SELECT fov % 5 AS grp, fov, nucleus, 1 / (1 + nucleus_volume_um3) AS p FROM nuclei WHERE nucleus_volume_um3 > 0),
r AS (SELECT *, p * count(*) OVER (PARTITION BY grp) / (rank() OVER (PARTITION BY grp ORDER BY p) + count(*) OVER (PARTITION BY grp, p) - 1) AS q FROM p)
SELECT fov, nucleus, round(least(min(q) OVER (PARTITION BY grp ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 9) AS padj FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg adjustment per group, on p-like numbers from the nuclei's volumes."""
    n = nuclei(spark, sf_dir).where("nucleus_volume_um3 > 0").select(F.pmod("fov", F.lit(5)).alias("grp"), "fov", "nucleus", (1 / (1 + F.col("nucleus_volume_um3"))).alias("p"))
    return stats.bh_adjust(n, ["grp"], "p").select("fov", "nucleus", R("padj", 9).alias("padj"))


CONDITIONS = ["auxin", "drb", "eed226", "jq1", "sgc_cbp30", "triptolide", "tsa"]


@query(_LONG + "SELECT marker || '_' || feature AS feature, " + ", ".join(f"round(max(cliffs_delta) FILTER (WHERE grp = '{c}'), 6) AS {c}" for c in CONDITIONS) + " FROM st WHERE regexp_matches(marker || '_' || feature, 'volume|Brd4') GROUP BY 1")
def response_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of interest by name, pivoted to one column per condition."""
    s = stats.rank_statistics(condition_values(spark, sf_dir), "control", ["marker", "feature"])
    s = s.withColumn("feature", F.concat_ws("_", "marker", "feature")).where(F.col("feature").rlike("volume|Brd4"))
    return s.groupBy("feature").pivot("grp", CONDITIONS).agg(R(F.max("cliffs_delta"), 6))


@query(f"""WITH {SPOTS}, t AS (SELECT condition, CAST(least(floor(volume / 0.5), 7) AS BIGINT) AS token FROM spots WHERE condition IS NOT NULL AND volume IS NOT NULL),
n AS (SELECT condition, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT condition, token, n, round(n / sum(n) OVER (PARTITION BY condition), 8) AS share FROM n""")
def token_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-normalised crosstab of conditions and volume classes."""
    t = spots(spark, sf_dir).where("volume IS NOT NULL").select("condition", F.least(F.floor(F.col("volume") / 0.5), F.lit(7)).alias("token"))
    return stats.composition(t, "condition", "token").withColumn("share", R("share", 8))


@query(f"""WITH {SPOTS}
SELECT condition, marker, round(stddev_samp(volume) / nullif(abs(avg(volume)), 0), 6) AS volume_cv, round(stddev_samp(intensity) / nullif(abs(avg(intensity)), 0), 6) AS intensity_cv
FROM spots WHERE NOT is_bead GROUP BY 1, 2""")
def heterogeneity_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of variation per condition and marker."""
    s = spots(spark, sf_dir).where("NOT is_bead").groupBy("condition", "marker")
    return s.agg(R(stats.coefficient_of_variation(F.col("volume")), 6).alias("volume_cv"), R(stats.coefficient_of_variation(F.col("intensity")), 6).alias("intensity_cv"))


_CORR = ["volume", "intensity", "integrated"]


@query(f"WITH {SPOTS}, c AS (" + " UNION ALL ".join(f"SELECT marker, '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS r FROM spots GROUP BY 1" for a in _CORR for b in _CORR) + ") SELECT marker, f1, f2, round(r, 6) AS r FROM c WHERE r IS NOT NULL AND NOT isnan(r)")
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation matrix per marker, pairwise complete."""
    return stats.correlation_matrix(spots(spark, sf_dir), ["marker"], _CORR).withColumn("r", R("r", 6))


@query(f"""WITH {NUCLEI}, x AS (SELECT fov, nucleus, coalesce(nucleus_volume_um3, 0) AS v, coalesce(circularity, 0) AS c FROM nuclei),
m AS (SELECT avg(v) AS vm, stddev_pop(v) AS vs, avg(c) AS cm, stddev_pop(c) AS cs FROM x)
SELECT fov, nucleus, round((v - vm) / vs, 6) AS nucleus_volume_um3, round((c - cm) / cs, 6) AS circularity FROM x, m""")
def zscore_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised nucleus features; bad values count as zero."""
    z = stats.z_scores(nuclei(spark, sf_dir), ["fov", "nucleus"], ["nucleus_volume_um3", "circularity"])
    return z.select("fov", "nucleus", R("nucleus_volume_um3", 6).alias("nucleus_volume_um3"), R("circularity", 6).alias("circularity"))


_NOISE = f"""WITH {SPOTS}, m AS (SELECT marker, median(intensity) AS med, quantile_cont(intensity, 0.99) AS p99 FROM spots GROUP BY 1),
d AS (SELECT marker, coalesce(nullif(median(abs(intensity - med)) * 1.4826, 0), 1) AS mad FROM spots JOIN m USING (marker) GROUP BY 1)
SELECT marker, round(med, 4) AS median, round(mad, 4) AS mad, round((p99 - med) / mad, 5) AS snr FROM m JOIN d USING (marker)"""


@query(_NOISE)
def robust_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, median absolute deviation and robust signal-to-noise ratio per marker."""
    return stats.robust_noise(spots(spark, sf_dir), ["marker"], "intensity").select("marker", R("median", 4).alias("median"), R("mad", 4).alias("mad"), R("snr", 5).alias("snr"))


@query(f"""WITH {SPOTS}, b AS (SELECT fov, marker, quantile_cont(intensity, 0.05) AS bg FROM spots WHERE intensity IS NOT NULL GROUP BY 1, 2)
SELECT focus_id, round(greatest(intensity - bg, 0), 3) AS signal FROM spots JOIN b USING (fov, marker) WHERE intensity IS NOT NULL""")
def percentile_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal above the 5th percentile of its field of view and marker, clipped at 0."""
    s = cut(spots(spark, sf_dir).where("intensity IS NOT NULL").select("focus_id", "fov", "marker", "intensity"))
    bg = stats.group_percentiles(s, ["fov", "marker"], "intensity", {"bg": 0.05})
    return s.join(bg, ["fov", "marker"]).select("focus_id", R(F.greatest(F.col("intensity") - F.col("bg"), F.lit(0.0)), 3).alias("signal"))


@query(f"""WITH {SPOTS}, q AS (SELECT marker, quantile_cont(volume, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM spots GROUP BY 1)
SELECT marker, round(q[1], 6) AS p5, round(q[2], 6) AS p25, round(q[3], 6) AS p50, round(q[4], 6) AS p75, round(q[5], 6) AS p95 FROM q""")
def percentile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5, p25, p50, p75 and p95 of the volume per marker."""
    q = stats.group_percentiles(spots(spark, sf_dir).select("marker", "volume"), ["marker"], "volume", {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)})
    return q.select("marker", *[R(f"p{p}", 6).alias(f"p{p}") for p in (5, 25, 50, 75, 95)])


@query(f"""WITH {SPOTS}
SELECT condition, marker, CAST(grouping_id(condition, marker) AS BIGINT) AS level, count(*) AS n_spots, count(DISTINCT fov) AS n_fovs FROM spots GROUP BY ROLLUP (condition, marker)""")
def spot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per condition and marker with their subtotals."""
    return spots(spark, sf_dir).rollup("condition", "marker").agg(F.grouping_id().alias("level"), F.count("*").alias("n_spots"), F.countDistinct("fov").alias("n_fovs"))


@query(f"""WITH {NUCLEI}
SELECT fov, nucleus, volume_vox, rk FROM (SELECT fov, nucleus, volume_vox, row_number() OVER (PARTITION BY fov ORDER BY volume_vox DESC NULLS LAST, nucleus DESC) AS rk FROM nuclei) WHERE rk <= 5""")
def top_n_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest nuclei of each field of view; ties go to the higher label."""
    w = Window.partitionBy("fov").orderBy(F.col("volume_vox").desc_nulls_last(), F.col("nucleus").desc())
    return nuclei(spark, sf_dir).select("fov", "nucleus", "volume_vox").withColumn("rk", F.row_number().over(w)).where("rk <= 5")


@query(f"""WITH {SPOTS}, n AS (SELECT fov, marker, nucleus, count(*) AS n FROM spots GROUP BY 1, 2, 3)
SELECT fov, marker, nucleus, n, CAST(sum(n) OVER (PARTITION BY fov, marker ORDER BY nucleus ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS base FROM n""")
def relabel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets that make per-nucleus labels unique in their field of view and marker."""
    n = spots(spark, sf_dir).groupBy("fov", "marker", "nucleus").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fov", "marker").orderBy("nucleus").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("base", F.sum("n").over(w) - F.col("n"))


@query(f"""WITH {SPOTS}, k AS (SELECT fov, marker, nucleus, count(*) AS n FROM spots GROUP BY 1, 2, 3 HAVING count(*) BETWEEN 3 AND 200)
SELECT fov, marker, nucleus, n, dense_rank() OVER (PARTITION BY fov, marker ORDER BY nucleus) AS label FROM k""")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within a size range, renumbered 1..N."""
    n = spots(spark, sf_dir).groupBy("fov", "marker", "nucleus").agg(F.count("*").alias("n")).where("n BETWEEN 3 AND 200")
    return n.withColumn("label", F.dense_rank().over(Window.partitionBy("fov", "marker").orderBy("nucleus")))


@query(f"""WITH {SPOTS}, o AS (SELECT *, z + CASE marker WHEN 'Brd4' THEN 0.3 WHEN 'Sc35' THEN -0.15 ELSE 0 END AS cz FROM spots WHERE NOT isnan(z) AND NOT isnan(y) AND NOT isnan(x))
SELECT focus_id, round(1 + 0.5 * x + 0.01 * x * x + 0.002 * x * y - 0.03 * cz, 4) AS tx, round(cos(0.1) * x - sin(0.1) * y + 2.5, 5) AS rx, round(sin(0.1) * x + cos(0.1) * y - 1.5, 5) AS ry FROM o""")
def coordinate_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant offset per marker, a cubic polynomial of 20 terms, and a rigid transform in the plane."""
    s = spots(spark, sf_dir).where("NOT isnan(z) AND NOT isnan(y) AND NOT isnan(x)")
    cz = F.col("z") + F.coalesce(features.by_marker({"Brd4": 0.3, "Sc35": -0.15}), F.lit(0.0))
    # terms in the order of exprs.monomials: 1, x, y, z, xx, xy, ...
    coefficients = F.array(*[F.lit(v) for v in [1.0, 0.5, 0.0, -0.03, 0.01, 0.002] + [0.0] * 14])
    tx = exprs.dot(exprs.monomials(F.col("x"), F.col("y"), cz), coefficients)
    c, n = F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    return s.select("focus_id", R(tx, 4).alias("tx"), R(c * F.col("x") - n * F.col("y") + 2.5, 5).alias("rx"), R(n * F.col("x") + c * F.col("y") - 1.5, 5).alias("ry"))


@query(f"""WITH {SPOTS}, s AS (SELECT marker, fov, quantile_cont(intensity, [0.01, 0.995]) AS q FROM spots WHERE intensity IS NOT NULL GROUP BY 1, 2)
SELECT focus_id, CAST(CASE WHEN q[2] > q[1] THEN round_even(least(greatest((intensity - q[1]) / (q[2] - q[1]), 0), 1) * 255, 0) ELSE 0 END AS INT) AS grey FROM spots JOIN s USING (marker, fov) WHERE intensity IS NOT NULL""")
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities stretched between two percentiles to 0..255 per field of view and marker."""
    s = cut(spots(spark, sf_dir).where("intensity IS NOT NULL").select("focus_id", "marker", "fov", "intensity"))
    q = stats.group_percentiles(s, ["marker", "fov"], "intensity", {"low": 0.01, "high": 0.995})
    return s.join(q, ["marker", "fov"]).select("focus_id", exprs.stretch(F.col("intensity"), F.col("low"), F.col("high")).alias("grey"))
