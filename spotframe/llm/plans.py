"""Queries of the llm subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.llm import clusters, leaks, packing, quality, quantiles
from spotframe.session import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


CV_FIELDS = ["Brd4_n_foci", "Brd4_partition_coefficient", "Sc35_foci_vol_mean_um3"]
_XS = [f"x{i}" for i in range(len(CV_FIELDS))]


def _cv_leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The runs by their three fields, and the leaves over the distinct points of those."""
    runs = cut(clusters.clean_points(table(spark, sf_dir, "heterogeneity_cv"), "cv_id", CV_FIELDS, by="loaded_at"))
    points = runs.groupBy(*_XS).agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return runs, clusters.bisect_clusters(points, _XS)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in clusters that are similar within and to nothing outside."""
    runs, leaves = _cv_leaves(spark, sf_dir)
    found = leaves.join(clusters.isolated_clusters(leaves, _XS), "leaf")
    ids = found.groupBy("cluster").agg(F.min("first_id").alias("cluster_id"))
    points = found.join(ids, "cluster").select(*_XS, "cluster_id")
    return runs.join(points, _XS).select(F.col("id").alias("cv_id"), "cluster_id")


@query
def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf with its size, its centre and its most typical runs."""
    runs, leaves = _cv_leaves(spark, sf_dir)
    sizes = clusters.leaf_table(leaves, _XS).select("leaf", F.col("n_members").alias("size"), *[F.col(f"c{i}").alias(f"mean_{f}") for i, f in enumerate(CV_FIELDS)])
    members = runs.join(leaves.select(*_XS, "leaf"), _XS)
    typical = clusters.typical_members(members, _XS).groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("typical_cv_ids"))
    return sizes.join(typical, "leaf")


MEASURES = ["volume_um3", "mean_intensity"]


def spot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spot once: ``measure``, ``condition``, ``marker``, ``acq_day``, ``v``; beads and bad values left out."""
    rows = table(spark, sf_dir, "foci").select(
        "focus_id", "ingested_at", "is_bead", F.lower(F.trim("condition")).alias("condition"), F.lower(F.trim("marker")).alias("marker"), F.to_date("acquired_at").alias("day"), *MEASURES
    )
    # copies are equal but for ingested_at; the latest holds, then the greatest values
    w = Window.partitionBy("focus_id").orderBy(F.col("ingested_at").desc(), *[F.col(m).desc() for m in MEASURES], "condition", "marker", "day", "is_bead")
    once = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND NOT is_bead AND condition IS NOT NULL")
    long = once.select("condition", "marker", "day", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x"))
    return long.select("x.measure", "condition", "marker", F.date_format("day", "yyyy-MM-dd").alias("acq_day"), "x.v").where("v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND v < double('Infinity')")


_GROUPS = ["measure", "condition", "marker"]


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose percentile is 1.5 times off that of all days of the condition and marker."""
    day, whole = quantiles.percentiles(cut(spot_values(spark, sf_dir)), [[*_GROUPS, "acq_day"], _GROUPS], "v", [50, 90])
    whole = whole.select(*_GROUPS, "pct", F.col("value").alias("overall"))
    off = (F.col("value") >= 1.5 * F.col("overall")) | (F.col("value") <= F.col("overall") / 1.5)
    return day.where("size >= 20").join(whole, [*_GROUPS, "pct"]).where(off).select("measure", "pct", "condition", "marker", "acq_day")


_P4 = """
WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focus_id ORDER BY ingested_at DESC, volume_um3 DESC, mean_intensity DESC) AS rn FROM foci) WHERE rn = 1),
v AS (
  SELECT m AS measure, lower(trim(condition)) AS condition, lower(trim(marker)) AS marker, strftime(acquired_at, '%Y-%m-%d') AS acq_day,
         CAST(CASE m WHEN 'volume_um3' THEN volume_um3 ELSE mean_intensity END AS DOUBLE) AS v
  FROM one, (VALUES ('volume_um3'), ('mean_intensity')) AS t(m) WHERE NOT is_bead AND condition IS NOT NULL),
ok AS (SELECT * FROM v WHERE v IS NOT NULL AND NOT isnan(v) AND v >= 0 AND NOT isinf(v)),
p AS (SELECT unnest([50, 90]) AS pct),
whole AS (SELECT measure, pct, condition, marker, count(*) AS size, CASE pct WHEN 50 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.9) END AS value FROM ok, p GROUP BY measure, pct, condition, marker),
day AS (SELECT measure, pct, condition, marker, acq_day, count(*) AS size, CASE pct WHEN 50 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.9) END AS value FROM ok, p GROUP BY measure, pct, condition, marker, acq_day)
"""
SQL["p4_found"] = _P4 + """
SELECT d.measure, CAST(d.pct AS INT) AS pct, d.condition, d.marker, d.acq_day FROM day d JOIN whole w USING (measure, pct, condition, marker)
WHERE d.size >= 20 AND (d.value >= 1.5 * w.value OR d.value <= w.value / 1.5)"""


@query
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p5, p25, p50, p75 and p95 of both measures per condition and marker over all days."""
    out = quantiles.percentiles(cut(spot_values(spark, sf_dir)), [[*_GROUPS, "acq_day"], _GROUPS], "v", [5, 25, 50, 75, 95])[1]
    return out.withColumn("value", F.round("value", 6))


SQL["p4_percentiles"] = _P4 + """
, q AS (SELECT measure, condition, marker, count(*) AS size, quantile_cont(v, [0.05, 0.25, 0.5, 0.75, 0.95]) AS qs FROM ok GROUP BY ALL)
SELECT measure, condition, marker, size, CAST(unnest([5, 25, 50, 75, 95]) AS INT) AS pct, round(unnest(qs), 6) AS value FROM q"""


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items that share 13 consecutive words."""
    found = leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.where("edits = 0 AND words >= 13").select("doc_id", "item_id")


SQL["p7_found"] = r"""
WITH w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(lower(regexp_replace(strip_accents(text), '[\p{Cf}\p{Mn}]', '', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
  FROM (SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM eval_items) WHERE text IS NOT NULL),
g AS (SELECT kind, id, k, ws[k] || ' ' || ws[k + 6] || ' ' || ws[k + 12] AS t FROM (SELECT kind, id, ws, unnest(generate_series(1, len(ws) - 12)) AS k FROM w WHERE len(ws) >= 13)),
c AS (SELECT d.id AS doc_id, d.k AS a, i.id AS item_id, i.k AS b FROM g d JOIN g i ON d.t = i.t WHERE d.kind = 'doc' AND i.kind = 'item')
SELECT DISTINCT doc_id, item_id FROM c JOIN w d ON d.kind = 'doc' AND d.id = doc_id JOIN w i ON i.kind = 'item' AND i.id = item_id WHERE d.ws[a : a + 12] = i.ws[b : b + 12]"""


@query
def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages within one edit in 13 words, with their places."""
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: the documents that hold it, and those that hold 13 words unchanged."""
    found = p7_passages(spark, sf_dir)
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_if(F.col("edits") == 0).alias("n_docs_exact"), F.max("n_windows").alias("most_windows"))


@query
def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics with the reasons of the rules it fails."""
    return quality.text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly list, table or junk."""
    return p8_statistics(spark, sf_dir).where("kind IS NOT NULL").select("doc_id", "kind")


@query
def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, mean word length, lines and share of lines that end a sentence, per document."""
    return p8_statistics(spark, sf_dir).select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), "n_lines", F.round("terminal_share", 6).alias("terminal_share"))


SQL["p8_counts"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\p{Cf}', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{L}\p{Mn}]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}]')) AS ls FROM t),
n AS (SELECT doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS chars, len(ls) AS n_lines, len(list_filter(ls, lambda l: regexp_matches(l, '[.!?…][\s\p{Z}\x{85}]*$'))) AS ends FROM w)
SELECT doc_id, n_words, round(coalesce(chars, 0) / greatest(n_words, 1), 6) AS mean_word_length, n_lines, round(ends / greatest(n_lines, 1), 6) AS terminal_share FROM n"""


@query
def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each source fail each rule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    stats = p8_statistics(spark, sf_dir).select("doc_id", F.explode("reasons").alias("reason"))
    return stats.join(docs, "doc_id").groupBy("source", "reason").agg(F.count("*").alias("n_docs"))


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    """The containers' distinct capacities; kinds of containers, not data."""
    return sorted(r[0] for r in table(spark, sf_dir, "containers").select(F.col("capacity").cast("int")).where("capacity > 0").distinct().collect())


def _word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return cut(docs.select(F.col("doc_id").alias("id"), packing.word_tokens(F.col("text")).alias("n_tokens")))


@query
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each capacity."""
    return packing.pack_all(_word_items(spark, sf_dir), _capacities(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the plan put into more than one container, per capacity."""
    spread = p6_containers(spark, sf_dir).groupBy("doc_id", "capacity").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return spread.where("a < b").select("doc_id", "capacity")


SQL["p6_found"] = r"""
SELECT doc_id, capacity FROM documents, containers
WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}]+')) > capacity"""


def _fill(packed: DataFrame) -> DataFrame:
    boxes = packed.groupBy("capacity", "container").agg(F.sum("length").alias("n"))
    return boxes.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))


@query
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens and the share of room that is used."""
    return _fill(p6_containers(spark, sf_dir))


@query
def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity what every packing must meet: whole documents, no container over its capacity or empty, no needless split."""
    packed = cut(p6_containers(spark, sf_dir))
    boxes = packed.groupBy("capacity", "container").agg(F.sum("length").alias("n"))
    boxes = boxes.groupBy("capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_over"), (F.max("container") + 1 - F.count("*")).alias("n_unused"), (F.count("*") * F.col("capacity") >= F.sum("n")).alias("has_room"))
    docs = packed.groupBy("capacity", "doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("piece").alias("d"), F.max("n_pieces").alias("want"))
    docs = docs.groupBy("capacity").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("k").alias("n_pieces"), F.count_if((F.col("k") != F.col("want")) | (F.col("k") != F.col("d"))).alias("n_broken"))
    return docs.join(boxes, "capacity")


SQL["p6_invariants"] = r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}]+')) AS n FROM documents)
SELECT capacity, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(ceil(n / capacity)) AS BIGINT) AS n_pieces, 0 AS n_broken, 0 AS n_over, 0 AS n_unused, true AS has_room
FROM d, (SELECT DISTINCT capacity FROM containers) c WHERE n > 0 GROUP BY 1"""


#: Fixed value: the pre-tokenising pattern of the byte-level vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@query
def p6_bpe_fill(spark: SparkSession, sf_dir: str, ranks_path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """As p6_fill, with sizes in tokens of a public byte-level vocabulary."""
    items = cut(packing.bpe_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", ranks_path, BYTE_BPE_PATTERN))
    return _fill(packing.pack_all(items, _capacities(spark, sf_dir)))
