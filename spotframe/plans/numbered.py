"""Queries of the core's numbered problems (schema drift, intervals, nested records)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.operators import drift, intervals, nested
from spotframe.session import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def panel_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest revision of each feature, with one spelling of the chromosome."""
    rows = table(spark, sf_dir, "coordinates_v2").select("panel_id", "name", "chr", "dna_start", "dna_end", "updated_at")
    return intervals.latest_rows(rows, ["panel_id", "name"], "updated_at").withColumn("chr", intervals.canonical_chromosome(F.col("chr")))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous stretches and the gaps between them, per panel and chromosome."""
    return intervals.merge_intervals(panel_intervals(spark, sf_dir), ["panel_id", "chr"], "dna_start", "dna_end")


_P3 = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, name ORDER BY updated_at DESC NULLS LAST) AS rn FROM coordinates_v2) WHERE rn = 1),
clean AS (
  SELECT panel_id, 'chr' || upper(regexp_replace(trim(chr), '^chr', '', 'i')) AS chr, least(dna_start, dna_end) AS s, greatest(dna_start, dna_end) AS e
  FROM latest WHERE dna_start IS NOT NULL AND dna_end IS NOT NULL AND dna_start <> dna_end),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY panel_id, chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM clean),
numbered AS (
  SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY panel_id, chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS no FROM marked),
m AS (SELECT panel_id, chr, no, min(s) AS s, max(e) AS e FROM numbered GROUP BY 1, 2, 3),
g AS (SELECT *, lag(e) OVER (PARTITION BY panel_id, chr ORDER BY no) AS f FROM m)
"""
SQL["p3_found"] = _P3 + """
SELECT panel_id, chr, 'merged' AS kind, s AS seg_start, e AS seg_end FROM m
UNION ALL SELECT panel_id, chr, 'gap', f, s FROM g WHERE f IS NOT NULL"""


@query
def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per panel and chromosome: stretches, covered length, gaps and the longest gap."""
    length = F.col("seg_end") - F.col("seg_start")
    merged, gap = F.col("kind") == "merged", F.col("kind") == "gap"
    return (
        p3_found(spark, sf_dir)
        .groupBy("panel_id", "chr")
        .agg(
            F.count_if(merged).alias("n_stretches"),
            F.sum(F.when(merged, length)).alias("covered_bp"),
            F.count_if(gap).alias("n_gaps"),
            F.coalesce(F.max(F.when(gap, length)), F.lit(0)).alias("longest_gap_bp"),
        )
    )


SQL["p3_coverage"] = _P3 + """
SELECT panel_id, chr, count(*) AS n_stretches, CAST(sum(e - s) AS BIGINT) AS covered_bp,
       count(f) AS n_gaps, coalesce(max(s - f), 0) AS longest_gap_bp
FROM g GROUP BY 1, 2"""


def round_tables(spark: SparkSession, sf_dir: str, *columns: str) -> dict[str, DataFrame]:
    """Flat tables of the latest version of each round; cells keep their trial's params shape.

    With ``columns`` only those are read, and versions that tie are told apart by those alone.
    """
    rows = table(spark, sf_dir, "rounds")
    rows = intervals.latest_rows(rows.select("round_id", "logged_at", *columns) if columns else rows, ["round_id"], "logged_at")
    return nested.flat_tables(rows, "round_id", inherit={"metrics_params_shape": "trials"})


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, routed by the params variant of their trial: those of the variants that carry a threshold."""
    cells = round_tables(spark, sf_dir, "trials")["trials_metrics_cells"].where("shape <> '0'")
    cells = cut(cells.select("round_id", F.col("trials_pos").alias("trial_pos"), F.col("cells_pos").alias("cell_pos"), "trials_metrics_params_shape"))
    known = nested.variants(cells, "trials_metrics_params_shape")
    tables = nested.routed(cells, "trials_metrics_params_shape", known)
    rare = tables.pop("").where(nested.has_field(F.col("trials_metrics_params_shape"), "threshold"))
    found = [t for s, t in tables.items() if "threshold" in known[s]]
    return reduce(DataFrame.unionByName, [*found, rare]).select("round_id", "trial_pos", "cell_pos")


_P5 = """
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY logged_at DESC NULLS LAST) AS rn FROM rounds) WHERE rn = 1),
t AS (SELECT round_id, unnest(generate_series(0, len(trials) - 1)) AS trial_pos, unnest(trials) AS x FROM latest WHERE len(trials) > 0),
c AS (SELECT round_id, trial_pos, x.metrics.params.threshold AS threshold, unnest(generate_series(0, len(x.metrics.cells) - 1)) AS cell_pos, unnest(x.metrics.cells) AS y
      FROM t WHERE len(x.metrics.cells) > 0)
"""
SQL["p5_found"] = _P5 + """
SELECT round_id, CAST(trial_pos AS INT) AS trial_pos, CAST(cell_pos AS INT) AS cell_pos FROM c WHERE threshold IS NOT NULL AND y IS NOT NULL"""


@query
def p5_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of trials: every element with its link, its scores and its params."""
    t = round_tables(spark, sf_dir, "trials")["trials"]
    return t.select("round_id", F.col("trials_pos").alias("trial_pos"), F.col("trial").cast("double").alias("trial"), "score", "metrics_valid", "metrics_score", "metrics_params_threshold", "metrics_params_levels", (F.col("shape") == "0").alias("is_null"))


SQL["p5_trials"] = _P5 + """
SELECT round_id, CAST(trial_pos AS INT) AS trial_pos, CAST(x.trial AS DOUBLE) AS trial, x.score AS score, x.metrics.valid AS metrics_valid, x.metrics.score AS metrics_score,
       x.metrics.params.threshold AS metrics_params_threshold, x.metrics.params.levels AS metrics_params_levels, x IS NULL AS is_null FROM t"""


@query
def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the cells' flags, three arrays deep, with the links to its parents."""
    t = round_tables(spark, sf_dir, "trials")["trials_metrics_cells_flags"]
    return t.select("round_id", F.col("trials_pos").alias("trial_pos"), F.col("cells_pos").alias("cell_pos"), F.col("flags_pos").alias("flag_pos"), F.col("value").alias("flag"))


SQL["p5_flags"] = _P5 + """
SELECT round_id, CAST(trial_pos AS INT) AS trial_pos, CAST(cell_pos AS INT) AS cell_pos, CAST(unnest(generate_series(0, len(y.flags) - 1)) AS INT) AS flag_pos, unnest(y.flags) AS flag
FROM c WHERE len(y.flags) > 0"""


#: The fields of the params of rounds, in the table's order.
PARAMS = ["threshold", "abs_floor", "blur_sigma", "marker_h", "watershed", "min_size", "max_size", "tophat_radius", "noise_k", "num_sigma", "h", "offset_k", "block_size", "levels", "k"]


@query
def p5_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables of the trials' params, one below the other: variant, link, and each of its fields."""
    t = round_tables(spark, sf_dir, "trials")["trials"].withColumnRenamed("trials_pos", "trial_pos")
    t = cut(t.select("round_id", "trial_pos", *[c for c in t.columns if c.startswith("metrics_params_")]))
    parts = []
    for variant, rows in nested.typed_tables(t, ["round_id", "trial_pos"], "metrics_params").items():
        names = [c for c in rows.columns if c not in ("round_id", "trial_pos", "variant")]
        cell = lambda f: F.struct(F.lit(f).alias("field"), (F.lit(None) if f == "levels" else F.col(f)).cast("double").alias("num"), F.when(F.lit(f == "levels"), F.col(f).cast("string")).alias("text"))
        if names:
            rows = rows.withColumn("_c", F.explode(F.array(*[cell(f) for f in names])))
            parts.append(rows.select("round_id", "trial_pos", (F.lit(variant) if variant else F.col("variant")).alias("variant"), "_c.*").where("num IS NOT NULL OR text IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts)


def _state_sql(x: str, kind: object) -> str:
    """The automaton's state of ``x`` in SQL; ``kind``: a dict of fields, a list for an array, else a scalar."""
    if isinstance(kind, dict):
        parts = [f"CASE WHEN {x}.{f} IS NOT NULL THEN '{f}{':' if isinstance(k, (dict, list)) else ''}'" + (f" || {_state_sql(f'{x}.{f}', k)}" if isinstance(k, (dict, list)) else "") + " END" for f, k in kind.items()]
        return f"CASE WHEN {x} IS NULL THEN '0' ELSE '{{' || array_to_string(list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL), ',') || '}}' END"
    return f"CASE WHEN {x} IS NULL THEN '0' WHEN len({x}) = 0 THEN 'e' WHEN len(list_filter({x}, lambda v: v IS NULL)) > 0 THEN 'n' ELSE 'f' END"


_P_KIND = dict.fromkeys(PARAMS)
SQL["p5_params"] = _P5 + f""", v AS (SELECT round_id, trial_pos, x.metrics.params AS p, {_state_sql('x.metrics.params', _P_KIND)} AS variant FROM t WHERE x.metrics.params IS NOT NULL)
""" + "\nUNION ALL ".join(
    f"SELECT round_id, CAST(trial_pos AS INT) AS trial_pos, variant, '{f}' AS field, {'NULL' if f == 'levels' else f'CAST(p.{f} AS DOUBLE)'} AS num, {'p.levels' if f == 'levels' else 'NULL'} AS text FROM v WHERE p.{f} IS NOT NULL" for f in PARAMS
)


@query
def p5_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape that the automaton met, per table and object, with its rows."""
    return nested.shape_catalogue(round_tables(spark, sf_dir))


_CELL = {"cell": 0, "n_foci": 0, "flags": []}
_TRIAL = {"trial": 0, "score": 0, "metrics": {"valid": 0, "score": 0, "params": _P_KIND, "cells": []}}
_VERDICT = {"plausible": 0, "confidence": 0, "issues": [], "notes": 0}
_PROPOSAL = {"family": 0, "params": _P_KIND, "rationale": 0, "structural_change": 0}
_METRICS = {"valid": 0, "median_count": 0, "count_cv": 0, "median_contrast": 0, "image_snr": 0, "anchored": 0, "score": 0, "family": 0, "params": _P_KIND, "per_cell_counts": []}
_ROUND = {"run": 0, "marker": 0, "round": 0, "family": 0, "score": 0, "metrics": _METRICS, "verdict": _VERDICT, "proposal": _PROPOSAL, "kept": 0, "trials": [], "logged_at": 0}
_SHAPES = [
    ("record", "", "r", _ROUND, "rec"),
    ("record", "metrics", "r.metrics", _METRICS, "rec"),
    ("record", "metrics_params", "r.metrics.params", _P_KIND, "rec"),
    ("record", "verdict", "r.verdict", _VERDICT, "rec"),
    ("record", "proposal", "r.proposal", _PROPOSAL, "rec"),
    ("record", "proposal_params", "r.proposal.params", _P_KIND, "rec"),
    ("trials", "", "x", _TRIAL, "t"),
    ("trials", "metrics", "x.metrics", _TRIAL["metrics"], "t"),
    ("trials", "metrics_params", "x.metrics.params", _P_KIND, "t"),
    ("trials_metrics_cells", "", "y", _CELL, "c"),
]
SQL["p5_shapes"] = _P5 + ", rec AS (SELECT latest AS r FROM latest), s AS (" + "\nUNION ALL ".join(f"SELECT '{t}' AS tbl, '{o}' AS object, {_state_sql(x, k)} AS shape FROM {of}" for t, o, x, k, of in _SHAPES) + ") SELECT tbl, object, shape, count(*) AS n_rows FROM s GROUP BY 1, 2, 3"


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of field between a log file and the one before it in its series."""
    return drift.changes(drift.file_catalogue(table(spark, sf_dir, "log_lines"))).select("file_name", "change", "old_path", "new_path")


@query
def p2_lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: from which file to which each field of a series held one type."""
    return drift.lifespans(drift.file_catalogue(table(spark, sf_dir, "log_lines")))


@query
def p2_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of the ``rounds`` stream, all spellings and types brought together."""
    return drift.consistent_table(table(spark, sf_dir, "log_lines"), "rounds")


@query
def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of the ``history`` stream."""
    return drift.consistent_table(table(spark, sf_dir, "log_lines"), "history")


@query
def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that no consistent table holds, with the reason."""
    return drift.rejected_lines(table(spark, sf_dir, "log_lines")).select("file_name", "line_no", "reason")
