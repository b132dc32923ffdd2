"""Queries over search rounds, trials and raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.functions import exprs
from spotframe.operators import intervals, search, stats
from spotframe.plans.base import NUCLEI, SPOTS, Registry, nuclei, spots
from spotframe.session import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
R = F.round


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of each round."""
    return intervals.latest_rows(table(spark, sf_dir, "rounds"), ["round_id"], "logged_at")


_R = "WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY logged_at DESC NULLS LAST) AS rn FROM rounds) WHERE rn = 1)"
_T = _R + """, t AS (SELECT round_id, marker, family, round, CAST(unnest(generate_series(0, len(trials) - 1)) AS INT) AS trial_pos, unnest(trials) AS x FROM latest WHERE len(trials) > 0)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rounds(spark, sf_dir)
    return r.select("round_id", "marker", "family", "round", F.posexplode("trials").alias("trial_pos", "x"))


@query(_T + " SELECT marker, family, round_id, trial_pos, round(x.score, 6) AS score FROM t WHERE x.score IS NOT NULL ORDER BY x.score DESC, round_id, trial_pos LIMIT 50")
def leaderboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best trials of all; the sort keeps only 50 rows per task."""
    t = trials(spark, sf_dir).where("x.score IS NOT NULL")
    return t.orderBy(F.col("x.score").desc(), "round_id", "trial_pos").limit(50).select("marker", "family", "round_id", "trial_pos", R("x.score", 6).alias("score"))


@query(_R + """, k AS (SELECT round_id, run, marker, round, row_number() OVER (PARTITION BY run, marker, round ORDER BY score DESC NULLS LAST, verdict.confidence DESC NULLS LAST, round_id) AS rk FROM latest)
SELECT round_id, CAST(rk AS INT) AS rk, rk <= CASE least(greatest(round, 1), 4) WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS keep FROM k""")
def successive_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of each round by score and the judge's confidence, kept by schedule."""
    r = rounds(spark, sf_dir).withColumn("confidence", F.col("verdict.confidence"))
    return search.halving(r, ["run", "marker"], "score", "confidence", "round_id").select("round_id", "rk", "keep")


_B = _R + ", b AS (SELECT marker, family, round, max(score) AS best FROM latest WHERE score IS NOT NULL GROUP BY 1, 2, 3)"


def best_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(spark, sf_dir).where("score IS NOT NULL").groupBy("marker", "family", "round").agg(F.max("score").alias("best"))


@query(_B + """, w AS (SELECT *, lag(best) OVER (PARTITION BY marker, family ORDER BY round) AS f, row_number() OVER (PARTITION BY marker, family ORDER BY round) AS n FROM b)
SELECT marker, family, round, n < 2 OR best >= f + 0.01 OR best >= 0.5 AS converging FROM w""")
def arm_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each arm still improves, or is strong, at each round."""
    return search.convergence(best_by_round(spark, sf_dir), ["marker", "family"]).select("marker", "family", "round", "converging")


@query(_B + " SELECT marker, family, round, max(best) OVER (PARTITION BY marker, family ORDER BY round) AS best_so_far FROM b")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running best score of each arm."""
    w = Window.partitionBy("marker", "family").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return best_by_round(spark, sf_dir).select("marker", "family", "round", F.max("best").over(w).alias("best_so_far"))


@query(_R + """ SELECT marker, arg_max(round_id, (coalesce(verdict.plausible, false)::INT, coalesce(score, -1), -round_id)) AS round_id FROM latest WHERE marker IS NOT NULL GROUP BY 1""")
def search_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best round of each marker among the plausible ones, else among all."""
    key = F.struct(F.coalesce("verdict.plausible", F.lit(False)), F.coalesce("score", F.lit(-1.0)), -F.col("round_id"))
    return rounds(spark, sf_dir).where("marker IS NOT NULL").groupBy("marker").agg(F.max_by("round_id", key).alias("round_id"))


@query("""SELECT event_id, round(CASE WHEN value <= 0 THEN 0 WHEN value < 5 THEN pow(value / 5.0, 1.5) WHEN value > 20 THEN 20.0 / value ELSE 1 END, 8) AS range_score,
round(CASE WHEN value <= 0 THEN 0 WHEN value < 5 THEN greatest(0, 1 - log10(5.0 / value)) WHEN value > 20 THEN greatest(0, 1 - log10(value / 20.0)) ELSE 1 END, 8) AS bump_score FROM events""")
def range_and_bump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both score shapes on the events' values."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", R(exprs.range_score(F.col("value"), 5, 20), 8).alias("range_score"), R(exprs.bump_score(F.col("value"), 5, 20), 8).alias("bump_score"))


_PARAMS = ["threshold", "abs_floor", "blur_sigma", "marker_h", "watershed", "min_size", "max_size", "tophat_radius", "noise_k", "num_sigma", "h", "offset_k", "block_size", "levels", "k"]


def _clip_sql(family: str, param: str, kind: str, lo: float | None, hi: float | None, choices: list[str] | None) -> str:
    val = f"p.{param}" if param in _PARAMS else "NULL"
    num, text = "CAST(NULL AS DOUBLE)", "NULL"
    if kind in ("float", "int"):
        x = f"CAST({val} AS DOUBLE)"
        default = round((lo + hi) / 2) if kind == "int" else round((lo + hi) / 2, 3)
        num = f"coalesce(least(greatest({f'trunc({x})' if kind == 'int' else x}, {lo}), {hi}), {default})"
        num = f"CASE WHEN {x} IS NULL THEN {float(default)} ELSE {num} END"
    elif kind == "cat":
        text = f"CASE WHEN {val} IN ({', '.join(repr(c) for c in choices)}) THEN {val} ELSE '{choices[0]}' END"
    else:
        text = f"coalesce(CAST({val} AS VARCHAR), 'true')"
    return f"SELECT round_id, trial_pos, family, '{param}' AS param, {num} AS num, {text} AS text, {val} IS NULL AS defaulted FROM q WHERE family = '{family}'"


@query(_T + ", q AS (SELECT round_id, trial_pos, family, x.metrics.params AS p FROM t WHERE x.metrics.params IS NOT NULL)\n" + "\nUNION ALL ".join(_clip_sql(*r) for r in search.PARAM_SPACE))
def param_clip_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trial's parameters clipped to the family's space, with defaults for missing ones."""
    t = trials(spark, sf_dir).where("x.metrics.params IS NOT NULL").select("round_id", "trial_pos", "family", F.col("x.metrics.params").alias("params"))
    keys = ["round_id", "trial_pos"]
    return search.clip_with_defaults(t.select(*keys, "family"), search.long_params(t, "params", keys), keys)


_DIFF = "\nUNION ALL ".join(f"SELECT round_id, '{p}' AS param, '{p}: ' || coalesce(CAST(old.{p} AS VARCHAR), 'None') || ' -> ' || CAST(new.{p} AS VARCHAR) AS line FROM d WHERE new.{p} IS NOT NULL" for p in _PARAMS)


@query(_R + ", d AS (SELECT round_id, metrics.params AS old, proposal.params AS new FROM latest WHERE proposal.params IS NOT NULL)\n" + _DIFF)
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key: old -> new`` of every proposed parameter against the round's own."""
    r = rounds(spark, sf_dir).where("proposal.params IS NOT NULL").select("round_id", F.col("metrics.params").alias("old"), F.col("proposal.params").alias("new"))
    new = search.long_params(r, "new", ["round_id"])
    old = search.long_params(r.where("old IS NOT NULL"), "old", ["round_id"]).withColumnRenamed("val", "was")
    line = F.format_string("%s: %s -> %s", "param", F.coalesce("was", F.lit("None")), "val")
    return new.join(old, ["round_id", "param"], "left").select("round_id", "param", line.alias("line"))


VOXEL = 0.108 * 0.108 * 0.3
@query(_R + """, r AS (SELECT round_id, marker, score, metrics.median_count AS n FROM latest), b AS (SELECT marker, arg_max(n, (score, -round_id)) AS anchor FROM r WHERE score IS NOT NULL GROUP BY 1)
SELECT round_id, n >= 0.5 * anchor AND n <= 2 * anchor AS in_band FROM r LEFT JOIN b ON r.marker IS NOT DISTINCT FROM b.marker""")
def count_band_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each round's median count is within half to twice that of its marker's best round."""
    r = rounds(spark, sf_dir).select("round_id", "marker", "score", F.col("metrics.median_count").alias("n"))
    return search.count_band(cut(r), ["marker"], "n", "score", "round_id").select("round_id", "in_band")


_EXPECT = {"count": (2.0, 40.0), "eq_diam": (0.3, 1.5), "coverage": (0.001, 0.1)}


def panel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per condition and marker the panel metrics; cells are nuclei, contrasts are against the marker's noise."""
    s = cut(spots(spark, sf_dir).select("condition", "marker", "fov", "nucleus", "volume", "intensity"))
    noise = stats.robust_noise(s.select("marker", "intensity"), ["marker"], "intensity")
    n = nuclei(spark, sf_dir).where("nucleus_volume_um3 > 0").select("fov", "nucleus", "nucleus_volume_um3")
    rows = s.where("condition IS NOT NULL AND nucleus <> 0 AND volume IS NOT NULL AND intensity IS NOT NULL").join(n, ["fov", "nucleus"]).join(cut(noise), "marker")
    rows = cut(rows.select("condition", "marker", "fov", "nucleus", (F.col("nucleus_volume_um3") / VOXEL).alias("nv"), (F.col("volume") / VOXEL).alias("size"), ((F.col("intensity") - F.col("median")) / F.col("mad")).alias("contrast"), "snr"))
    by = ["condition", "marker"]
    cells = rows.groupBy(*by, "fov", "nucleus").agg(F.count("*").alias("count"), (F.sum("size") / F.max("nv")).alias("fill"), F.max("nv").alias("volume"))
    return search.proxy_score(cells, rows.select(*by, "size", "contrast"), by).join(rows.groupBy(*by).agg(F.max("snr").alias("snr")), by)


_M = f"""WITH {SPOTS}, {NUCLEI}, m0 AS (SELECT marker, median(intensity) AS med, quantile_cont(intensity, 0.99) AS p99 FROM spots GROUP BY 1),
d0 AS (SELECT marker, coalesce(nullif(median(abs(intensity - med)) * 1.4826, 0), 1) AS mad FROM spots JOIN m0 USING (marker) GROUP BY 1),
r AS (SELECT condition, marker, fov, nucleus, nucleus_volume_um3 / {VOXEL} AS nv, volume / {VOXEL} AS size, (intensity - med) / mad AS contrast, (p99 - med) / mad AS snr
      FROM spots JOIN nuclei USING (fov, nucleus) JOIN m0 USING (marker) JOIN d0 USING (marker)
      WHERE condition IS NOT NULL AND nucleus <> 0 AND volume IS NOT NULL AND intensity IS NOT NULL AND nucleus_volume_um3 > 0),
c AS (SELECT condition, marker, fov, nucleus, count(*) AS n, sum(size) / any_value(nv) AS fill, any_value(nv) AS nv FROM r GROUP BY 1, 2, 3, 4),
a AS (SELECT condition, marker, median(n) AS mc, stddev_pop(n) / avg(n) AS cv, median(fill) AS mf, median(nv) AS mn FROM c GROUP BY 1, 2),
b AS (SELECT condition, marker, median(size) AS mv, median(contrast) AS mcon, max(snr) AS snr, avg(CASE WHEN size < 3 THEN 1 ELSE 0 END) AS ft, avg(CASE WHEN size > 0.05 * mn THEN 1 ELSE 0 END) AS fh FROM r JOIN a USING (condition, marker) GROUP BY 1, 2),
e AS (SELECT *, tanh(mcon / 5) AS ct, 1 / (1 + cv) AS rt, (1 - ft) * (1 - fh) AS clean, pow(mv * {VOXEL} * 6 / pi(), 1.0 / 3) AS ed, mc >= 1 AND mf < 0.6 AND mc < 5000 AS valid FROM a JOIN b USING (condition, marker))
"""
_rs = lambda x, lo, hi: f"(CASE WHEN {x} <= 0 THEN 0 WHEN {x} < {lo} THEN pow({x} / {lo}, 1.5) WHEN {x} > {hi} THEN {hi} / {x} ELSE 1 END)"


@query(_M + f"SELECT condition, marker, valid, round((0.85 * (0.45 * {_rs('mc', 2.0, 40.0)} + 0.30 * (0.6 * {_rs('ed', 0.3, 1.5)} + 0.4 * clean) + 0.25 * {_rs('mf', 0.001, 0.1)}) + 0.15 * (0.5 * ct + 0.5 * rt)) * CASE WHEN valid THEN 1 ELSE 0.05 END, 6) AS score FROM e")
def panel_proxy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchored panel score of each condition and marker."""
    return search.panel_score(panel_metrics(spark, sf_dir), _EXPECT, VOXEL).select("condition", "marker", "valid", R("score", 6).alias("score"))


@query(_M + """, f AS (SELECT *, CASE WHEN mf <= 0 THEN 0 WHEN mf < 0.002 THEN greatest(0, 1 - log10(0.002 / mf)) WHEN mf > 0.25 THEN greatest(0, 1 - log10(mf / 0.25)) ELSE 1 END AS bp FROM e)
SELECT condition, marker, valid, round(CASE WHEN snr < 8 THEN 0.45 * ct + 0.30 * rt + 0.10 * bp + 0.15 * clean ELSE 0.30 * ct + 0.20 * rt + 0.25 * bp + 0.25 * clean END * CASE WHEN valid THEN 1 ELSE 0.05 END, 6) AS score FROM f""")
def agnostic_proxy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agnostic panel score, with weights by signal-to-noise ratio."""
    return search.panel_score(panel_metrics(spark, sf_dir), None, VOXEL).select("condition", "marker", "valid", R("score", 6).alias("score"))


@query(_T + """, c AS (SELECT round_id, trial_pos, unnest(x.metrics.cells) AS y FROM t WHERE len(x.metrics.cells) > 0)
SELECT round_id, trial_pos, round(median(y.n_foci), 4) AS per_cell_median, round(quantile_cont(y.n_foci, 0.25), 4) AS p25, round(quantile_cont(y.n_foci, 0.75), 4) AS p75 FROM c WHERE y.n_foci IS NOT NULL GROUP BY 1, 2""")
def cell_count_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles of the counts per cell of each trial."""
    c = trials(spark, sf_dir).select("round_id", "trial_pos", F.explode("x.metrics.cells").alias("y")).where("y.n_foci IS NOT NULL")
    q = c.groupBy("round_id", "trial_pos").agg(F.percentile("y.n_foci", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("round_id", "trial_pos", R(F.col("q")[1], 4).alias("per_cell_median"), R(F.col("q")[0], 4).alias("p25"), R(F.col("q")[2], 4).alias("p75"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def jsonl_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field read out and counted."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows over the events (beyond the surveyed operators)."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")
