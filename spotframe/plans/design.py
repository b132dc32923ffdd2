"""Queries over panels, cards, voxels and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.functions import exprs
from spotframe.operators import cards, intervals, joins, matrix, panel, voxels
from spotframe.plans.base import SPOTS, Registry, spots
from spotframe.session import cut, table

query = Registry()
QUERIES, SQL = query.queries, query.sql
R = F.round


def features(spark: SparkSession, sf_dir: str, *bounds: str) -> DataFrame:
    """Latest revision of each feature with ordered bounds and one spelling of chr; NULL in ``bounds`` (of dna, rna) leaves a feature out."""
    narrow = table(spark, sf_dir, "coordinates_v2").select("panel_id", "name", "type", "chr", "strand", "rna_probe", "rna_start", "rna_end", "dna_start", "dna_end", "tss_used", "note", "updated_at")
    rows = intervals.latest_rows(narrow, ["panel_id", "name"], "updated_at")
    for b in bounds:
        rows = rows.where(F.col(f"{b}_start").isNotNull() & F.col(f"{b}_end").isNotNull())
    low, high = (lambda b, f=f: F.when(F.col(f"{b}_start").isNotNull() & F.col(f"{b}_end").isNotNull(), f(f"{b}_start", f"{b}_end")) for f in (F.least, F.greatest))
    return rows.select("panel_id", "name", "type", intervals.canonical_chromosome(F.col("chr")).alias("chr"), "strand", low("rna").alias("rna_s"), high("rna").alias("rna_e"), low("dna").alias("dna_s"), high("dna").alias("dna_e"), F.col("tss_used").cast("long").alias("tss"), "note", "rna_probe")


_F = """WITH f0 AS (
  SELECT panel_id, name, type, 'chr' || upper(regexp_replace(trim(chr), '^chr', '', 'i')) AS chr, strand,
         CASE WHEN rna_start IS NOT NULL AND rna_end IS NOT NULL THEN least(rna_start, rna_end) END AS rna_s, CASE WHEN rna_start IS NOT NULL AND rna_end IS NOT NULL THEN greatest(rna_start, rna_end) END AS rna_e,
         CASE WHEN dna_start IS NOT NULL AND dna_end IS NOT NULL THEN least(dna_start, dna_end) END AS dna_s, CASE WHEN dna_start IS NOT NULL AND dna_end IS NOT NULL THEN greatest(dna_start, dna_end) END AS dna_e,
         CAST(tss_used AS BIGINT) AS tss, note, rna_probe
  FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, name ORDER BY updated_at DESC NULLS LAST) AS rn FROM coordinates_v2) WHERE rn = 1),
f AS (SELECT * FROM f0 WHERE {})
"""
_F_DNA, _F_ALL, _F = _F.format("dna_s IS NOT NULL"), _F.format("true"), _F.format("rna_s IS NOT NULL")


@query(_F_DNA + """SELECT a.panel_id, a.chr, a.name AS a, b.name AS b, greatest(a.dna_s, b.dna_s) AS overlap_start, least(a.dna_e, b.dna_e) AS overlap_end, least(a.dna_e, b.dna_e) - greatest(a.dna_s, b.dna_s) AS overlap_len
FROM f a JOIN f b ON a.panel_id = b.panel_id AND a.chr = b.chr AND a.name < b.name AND greatest(a.dna_s, b.dna_s) < least(a.dna_e, b.dna_e) WHERE a.dna_s < a.dna_e AND b.dna_s < b.dna_e""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of features of a panel whose DNA windows overlap, the longest first."""
    return joins.overlap_pairs(features(spark, sf_dir, "dna"), ["panel_id", "chr"], "name", "dna_s", "dna_e", 20_000).orderBy(F.col("overlap_len").desc(), "panel_id", "a", "b")


@query(_F_DNA + """SELECT a.panel_id, a.name AS enhancer, b.name AS promoter, least(a.dna_e, b.dna_e) - greatest(a.dna_s, b.dna_s) AS overlap_len
FROM f a JOIN f b ON a.panel_id = b.panel_id AND a.chr = b.chr AND a.type = 'E' AND b.type = 'P' AND greatest(a.dna_s, b.dna_s) < least(a.dna_e, b.dna_e) WHERE a.dna_s < a.dna_e AND b.dna_s < b.dna_e""")
def dual_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of an enhancer with a promoter, the carriers of a second readout."""
    f = cut(features(spark, sf_dir, "dna"))
    kinds = f.select("panel_id", "name", "type")
    p = joins.overlap_pairs(f, ["panel_id", "chr"], "name", "dna_s", "dna_e", 20_000)
    p = p.join(kinds.withColumnsRenamed({"name": "a", "type": "ta"}), ["panel_id", "a"]).join(kinds.withColumnsRenamed({"name": "b", "type": "tb"}), ["panel_id", "b"]).where("ta <> tb")
    e = F.col("ta") == "E"
    return p.select("panel_id", F.when(e, F.col("a")).otherwise(F.col("b")).alias("enhancer"), F.when(e, F.col("b")).otherwise(F.col("a")).alias("promoter"), "overlap_len")


@query(_F + """SELECT panel_id, name, CASE WHEN type = 'E' AND rna_e - rna_s < 10000 THEN CAST(floor((rna_s + rna_e) / 2.0 + 0.5) AS BIGINT) - 5000 WHEN type = 'P' AND tss IS NOT NULL THEN tss - 5000 ELSE rna_s END AS dna_s,
CASE WHEN type = 'E' AND rna_e - rna_s < 10000 THEN CAST(floor((rna_s + rna_e) / 2.0 + 0.5) AS BIGINT) + 5000 WHEN type = 'P' AND tss IS NOT NULL THEN tss + 5000 ELSE rna_e END AS dna_e,
concat_ws('; ', note, CASE WHEN type = 'E' AND rna_e - rna_s < 10000 THEN 'window expanded ' || (rna_e - rna_s) || 'bp->10kb' END) AS note FROM f""")
def window_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enhancer windows of at least 10 kb, promoter windows about their TSS, with notes."""
    f = features(spark, sf_dir, "rna").select("panel_id", "name", "type", "strand", F.col("rna_s").alias("s"), F.col("rna_e").alias("e"), "tss", "note")
    return panel.feature_windows(f).select("panel_id", "name", "dna_s", "dna_e", "note")


_HUB = _F + """, g AS (SELECT panel_id, chr, regexp_replace(name, '^(E|P)\\d*_', '') AS token, min((rna_s + rna_e) / 2) AS lo, max((rna_s + rna_e) / 2) AS hi, bool_or(type = 'E') AS has_e FROM f GROUP BY 1, 2, 3),
n AS (SELECT a.panel_id, a.chr, a.token, arg_min(b.token, (greatest(0, greatest(a.lo, b.lo) - least(a.hi, b.hi)), b.token)) AS near FROM g a JOIN g b ON a.panel_id = b.panel_id AND a.chr = b.chr AND NOT a.has_e AND b.has_e
      WHERE greatest(0, greatest(a.lo, b.lo) - least(a.hi, b.hi)) <= 750000 GROUP BY 1, 2, 3),
hub AS (SELECT panel_id, chr, token, coalesce(near, token) AS hub FROM g LEFT JOIN n USING (panel_id, chr, token))
"""


@query(_HUB + "SELECT * FROM hub")
def nearest_group_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoter-only groups attached to the nearest group with an enhancer."""
    return panel.hubs(features(spark, sf_dir, "rna"), "panel_id")


@query(_HUB + "SELECT panel_id, chr, hub, string_agg(name, '|' ORDER BY name) AS members, count(*) AS n FROM (SELECT f.panel_id, f.chr, f.name, hub FROM f JOIN hub ON f.panel_id = hub.panel_id AND f.chr = hub.chr AND regexp_replace(f.name, '^(E|P)\\d*_', '') = hub.token) GROUP BY 1, 2, 3")
def hub_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each hub; a hub is a few neighbours within the gap."""
    f = cut(features(spark, sf_dir, "rna"))
    return hub_features(f).groupBy("panel_id", "chr", "hub").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("members"), F.count("*").alias("n"))


def hub_features(f: DataFrame) -> DataFrame:
    return f.withColumn("token", panel.group_token(F.col("name"))).join(panel.hubs(f, "panel_id"), ["panel_id", "chr", "token"])


@query()
def imaging_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imaging rounds of each panel, neighbouring rounds on different chromosomes."""
    return panel.imaging_order(features(spark, sf_dir, "rna"), "panel_id")


@query(_F + """, c AS (SELECT panel_id, type = 'E' AS e, chr, count(*) AS k FROM f WHERE chr IS NOT NULL GROUP BY ALL), g AS (SELECT panel_id, e, sum(k) AS n, max(k) AS m FROM c GROUP BY ALL)
SELECT panel_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n) AS BIGINT) AS n_rounds, CAST(sum(n) AS BIGINT) AS last_round, CAST(coalesce(sum(n) FILTER (WHERE e), 0) AS BIGINT) AS last_enhancer, CAST(sum(greatest(0, 2 * m - n - 1)) AS BIGINT) AS n_repeats FROM g GROUP BY 1""")
def imaging_order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an imaging order must meet: every round once, enhancers first, no more neighbours on one chromosome than must be."""
    f = cut(features(spark, sf_dir, "rna").where("chr IS NOT NULL"))
    order = panel.imaging_order(f, "panel_id").join(f.select("panel_id", "name", F.coalesce(F.col("type") == "E", F.lit(False)).alias("e")), ["panel_id", "name"])
    w = Window.partitionBy("panel_id", "e").orderBy("round")
    again = order.withColumn("again", F.lag("chr").over(w) == F.col("chr")).groupBy("panel_id")
    return again.agg(F.count("*").alias("n_features"), F.countDistinct("round").alias("n_rounds"), F.max("round").alias("last_round"), F.coalesce(F.max(F.when(F.col("e"), F.col("round"))), F.lit(0)).alias("last_enhancer"), F.count_if("again").alias("n_repeats"))


def readouts(f: DataFrame) -> DataFrame:
    no_rna = f.where(F.lower(F.trim("rna_probe")) == "no").select("panel_id", "name")
    return panel.readout_scheme(cut(panel.imaging_order(f, "panel_id")), "panel_id", no_rna=no_rna)


@query()
def readout_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds, readouts and plates; features without an RNA probe have no RNA round."""
    return readouts(cut(features(spark, sf_dir, "rna")))


@query(_F + """, n AS (SELECT panel_id, count(*) FILTER (WHERE coalesce(lower(trim(rna_probe)), '') <> 'no') AS r, count(*) AS d FROM f WHERE chr IS NOT NULL GROUP BY 1)
SELECT panel_id, 'RNA' AS block, r AS n, r AS n_readouts, 1 AS first, r AS last, CAST(ceil(r / 96) AS BIGINT) AS plates, r AS last_round FROM n WHERE r > 0
UNION ALL SELECT panel_id, 'DNA', d, d, CAST(ceil(r / 96) * 96 + 1 AS BIGINT), CAST(ceil(r / 96) * 96 + d AS BIGINT), CAST(ceil((ceil(r / 96) * 96 + d) / 96) AS BIGINT), r + d FROM n""")
def readout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readouts of each panel's blocks: how many, from where to where, and the last plate and round."""
    r = readouts(cut(features(spark, sf_dir, "rna"))).groupBy("panel_id", "block")
    return r.agg(F.count("*").alias("n"), F.countDistinct("readout").alias("n_readouts"), F.min("readout").alias("first"), F.max("readout").alias("last"), F.max("plate").alias("plates"), F.max("imaging_round").alias("last_round"))


def dual(f: DataFrame) -> DataFrame:
    pairs = joins.overlap_pairs(f.where("dna_s IS NOT NULL AND rna_s IS NOT NULL AND chr IS NOT NULL"), ["panel_id", "chr"], "name", "dna_s", "dna_e", 20_000)
    return panel.dual_barcodes(pairs, f.select("panel_id", "name", "type"), cut(readouts(f.where("rna_s IS NOT NULL"))), "panel_id")


@query()
def dual_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones whose carrier has a second readout, with readouts and plates."""
    return dual(cut(features(spark, sf_dir)))


@query()
def zone_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes every 2,000 bases of each DNA window with the second readout of the first zone of their feature; dropped ones are left out."""
    f = cut(features(spark, sf_dir))
    start = F.explode(F.sequence(F.col("dna_s"), F.col("dna_e"), F.lit(2_000)))
    points = f.where("dna_s IS NOT NULL").select("panel_id", F.col("name").alias("feature"), "strand", start.alias("start"))
    points = cut(points.withColumn("at", F.floor(panel.probe_centre(F.col("start"), F.col("start") + 40, F.lit(0), 40, F.col("strand") == "-"))))
    z = panel.zones(cut(dual(f)), "panel_id")
    out = joins.first_zone(points, ["panel_id", "feature", "start"], "at", z, ["panel_id", "feature"], "start", "end", ["start", "end"], "r2", 20_000.0)
    return out.select("panel_id", F.format_string("%s_%d", "feature", "start").alias("probe"), "at", "r2")


@query(_F + """, t AS (SELECT panel_id, name, type, chr, CASE WHEN name LIKE '%Myc' THEN rna_s + 4000000 ELSE rna_s END AS s, CASE WHEN name LIKE '%Myc' THEN rna_e + 4000000 ELSE rna_e END AS e,
  concat_ws('; ', note, CASE WHEN name LIKE '%Myc' THEN 'COORD FIX: +4000000' END) AS note, strand, tss FROM f WHERE name NOT IN ('E1_Sox2', 'P_Sox2')),
a AS (SELECT panel_id, name, type, chr, s, e, strand, tss, nullif(note, '') AS note FROM t UNION ALL SELECT DISTINCT panel_id, 'E_New', 'E', 'chr6', 125407000, 125437000, '+', CAST(NULL AS BIGINT), 'added' FROM f),
c AS (SELECT panel_id, name, s + 100 AS new_tss FROM (SELECT panel_id, name, rna_s AS s, type FROM f) WHERE type = 'P' AND s % 2 = 0)
SELECT a.panel_id, a.name, a.s, a.e, coalesce(c.new_tss, a.tss) AS tss, a.note FROM a LEFT JOIN c USING (panel_id, name)""")
def panel_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features shifted, dropped and added by name, with TSS from a table of corrections."""
    f = cut(features(spark, sf_dir, "rna")).select("panel_id", "name", "type", "chr", F.col("rna_s").alias("s"), F.col("rna_e").alias("e"), "strand", "tss", "note")
    more = f.select("panel_id").distinct().select("panel_id", F.lit("E_New").alias("name"), F.lit("E").alias("type"), F.lit("chr6").alias("chr"), F.lit(125_407_000).cast("long").alias("s"), F.lit(125_437_000).cast("long").alias("e"), F.lit("+").alias("strand"), F.lit(None).cast("long").alias("tss"), F.lit("added").alias("note"))
    tss = f.where("type = 'P' AND s % 2 = 0").select("panel_id", "name", (F.col("s") + 100).alias("new_tss"), F.lit(None).cast("string").alias("new_strand"), F.lit(None).cast("string").alias("new_note"))
    return panel.corrected(f, {"Myc$": 4_000_000}, ["E1_Sox2", "P_Sox2"], more, tss, ["panel_id", "name"]).select("panel_id", "name", "s", "e", "tss", "note")


_CH = lambda n: f"CAST(floor(255 * (0.48 - 0.62 * 0.48 * greatest(-1, least((({n} + h / 30) % 12) - 3, 9 - (({n} + h / 30) % 12), 1))) + 0.5) AS INT)"


@query(_HUB + f""", i AS (SELECT panel_id, hub, row_number() OVER (PARTITION BY panel_id ORDER BY hub) - 1 AS i FROM (SELECT DISTINCT panel_id, hub FROM hub)),
c AS (SELECT f.*, (i * 137.508) % 360 AS h FROM f JOIN hub ON f.panel_id = hub.panel_id AND f.chr = hub.chr AND regexp_replace(f.name, '^(E|P)\\d*_', '') = hub.token JOIN i ON i.panel_id = hub.panel_id AND i.hub = hub.hub),
u AS (SELECT *, {_CH(0)} || ',' || {_CH(8)} || ',' || {_CH(4)} AS rgb FROM c)
SELECT panel_id, chr, dna_s - 1 AS start, dna_e AS "end", 'DNA_' || name AS name, 0 AS score, strand, dna_s - 1 AS thick_start, dna_e AS thick_end, rgb FROM u WHERE dna_s IS NOT NULL
UNION ALL SELECT panel_id, chr, rna_s - 1, rna_e, 'RNA_' || name, 0, strand, rna_s - 1, rna_e, rgb FROM u""")
def bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BED9 rows of both windows, coloured by hub with the golden-angle palette; hubs of a panel are numbered by name."""
    f = cut(hub_features(cut(features(spark, sf_dir, "rna"))))
    i = (F.row_number().over(Window.partitionBy("panel_id").orderBy("hub")) - 1).cast("double")
    return panel.bed_rows(f.join(f.select("panel_id", "hub").distinct().withColumn("i", i), ["panel_id", "hub"]), "panel_id", exprs.hub_colour(F.col("i")))


@query(_F_ALL + """, z AS (SELECT panel_id, chr, name AS zone, dna_s, dna_e, CASE WHEN type = 'P' THEN -1 ELSE CAST(length(name) AS BIGINT) END AS r2 FROM f WHERE dna_s IS NOT NULL),
p AS (SELECT panel_id, chr, name, (rna_s + rna_e) // 2 AS mid FROM f WHERE rna_s IS NOT NULL),
m AS (SELECT p.panel_id, p.name, arg_min(r2, (dna_s, zone)) AS r2 FROM p JOIN z ON p.panel_id = z.panel_id AND p.chr = z.chr AND mid BETWEEN dna_s AND dna_e GROUP BY 1, 2)
SELECT p.panel_id, p.name, CAST(m.r2 AS DOUBLE) AS r2 FROM p LEFT JOIN m USING (panel_id, name) WHERE r2 IS NULL OR r2 <> -1""")
def first_zone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's centre in the first zone that holds it; promoter zones drop it."""
    f = cut(features(spark, sf_dir))
    zones = f.where("dna_s IS NOT NULL").select("panel_id", "chr", F.col("name").alias("zone"), "dna_s", "dna_e", F.when(F.col("type") == "P", F.lit(-1)).otherwise(F.length("name")).cast("long").alias("r2"))
    points = f.where("rna_s IS NOT NULL").select("panel_id", "chr", "name", F.floor((F.col("rna_s") + F.col("rna_e")) / 2).alias("at"))
    out = joins.first_zone(points, ["panel_id", "name"], "at", zones, ["panel_id", "chr"], "dna_s", "dna_e", ["dna_s", "zone"], "r2", 20_000.0)
    return out.select("panel_id", "name", F.col("r2").cast("double").alias("r2"))


_SEQ = "translate(upper(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_RC = lambda s: f"reverse(translate({s}, 'ACGTacgt', 'TGCAtgca'))"


@query(f"""WITH s AS (SELECT p_partkey, {_SEQ} AS seq FROM part)
SELECT p_partkey, 'ACGTAC' || lower({_RC('seq')}) || {_RC("'GGATTC'")} AS oligo, CASE WHEN length(seq) >= 3 THEN substr(seq, 1, 2) || repeat('n', least(5, length(seq)) - 2) || substr(seq, least(5, length(seq)) + 1) ELSE seq END AS masked, CAST(ceil(p_partkey / 96.0) AS BIGINT) AS plate FROM s""")
def revcomp_oligo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oligos from sequences, with a masked locus and the plate number."""
    seq = F.translate(F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
    p = table(spark, sf_dir, "part").select("p_partkey", seq.alias("seq"))
    oligo = panel.oligo(F.lit("acgtac"), F.lit(""), F.lit(""), F.col("seq"), F.lit("ggattc"))
    return p.select("p_partkey", oligo.alias("oligo"), exprs.masked(F.col("seq"), F.lit(3), F.lit(5)).alias("masked"), exprs.plate(F.col("p_partkey")).alias("plate"))


WORDS, TAGS = ["harbour fee petition", "guest house"], ["gazette", "en"]


def doc_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: name, text, tags, type, and the docket as link."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("name"), "text", F.array_compact(F.array("lang", "source")).alias("tags"), F.col("source").alias("type"), "docket")


_WANT = "['harbour', 'fee', 'petition', 'guest', 'house', 'gazette', 'en']"
_CARD = f"""WITH c AS (SELECT doc_id AS name, text, source AS type, docket, list_filter([lower(lang), lower(source)], lambda x: x IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, len(list_filter({_WANT}, lambda w: list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), w) OR list_contains(tags, w))) + 2 * len(list_filter(['gazette', 'en'], lambda w: list_contains(tags, w))) AS score FROM c)
"""


@query(_CARD + "SELECT name, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 40")
def card_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best documents for words and tags."""
    return cards.search(doc_cards(spark, sf_dir), WORDS, TAGS, 40).select("name", "score")


@query(_CARD + """, t AS (SELECT name, type, docket, score FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 40),
e AS (SELECT name, type, 0 AS hop, row_number() OVER (ORDER BY score DESC, name) AS pos FROM t
      UNION ALL SELECT name, type, 1, 0 FROM c WHERE docket IN (SELECT docket FROM t) AND name NOT IN (SELECT name FROM t))
SELECT name, hop FROM e ORDER BY (NOT coalesce(type IN ('gazette', 'reporter'), false))::INT, hop, pos, name LIMIT 60""")
def relevant_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with the other versions of their dockets, preferred sources first."""
    c = doc_cards(spark, sf_dir)
    return cards.expand_links(cut(cards.search(c, WORDS, TAGS, 40)), c, "docket", 60, ["gazette", "reporter"]).select("name", "hop")


@query(_CARD + """, t AS (SELECT name, score, '### ' || name || chr(10) || text AS block FROM s WHERE score > 0 ORDER BY score DESC, name LIMIT 40),
u AS (SELECT *, sum(length(block)) OVER (ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING) - length(block) AS used FROM t)
SELECT name, md5(CASE WHEN used + length(block) > 20000 THEN substr(block, 1, CAST(20000 - used AS BIGINT)) || ' …' ELSE block END) AS block_md5 FROM u WHERE used < 20000""")
def budget_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents rendered to a budget of 20,000 characters."""
    top = cards.search(doc_cards(spark, sf_dir), WORDS, TAGS, 40)
    block = F.concat(F.lit("### "), F.col("name").cast("string"), F.lit("\n"), F.col("text"))
    return cards.budget_render(top, block, [F.col("score").desc(), "name"], 20_000).select("name", F.md5("block").alias("block_md5"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(court), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS INT) AS n_tokens FROM documents""")
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs and distinct token counts."""
    return table(spark, sf_dir, "documents").select("doc_id", exprs.slug(F.col("court")).alias("slug"), F.size(exprs.tokens(F.col("text"))).alias("n_tokens"))


@query("""SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'only_customer', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, difference and union of key sets."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    tag = lambda d, t: d.select(F.lit(t).alias("kind"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "only_customer")).unionByName(tag(a.union(b).distinct(), "any"))


@query("""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rk FROM p)
SELECT query, neighbour, round(d, 5) AS distance, CAST(rk AS INT) AS rank FROM r WHERE rk <= 10""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every twentieth vector among all."""
    e = table(spark, sf_dir, "embeddings")
    return matrix.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("distance", R("distance", 5))


@query()
def neighbour_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A community for every vector, by label propagation on the graph of the 10 nearest of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    edges = matrix.nearest_vectors(e, e, "vec_id", "embedding", 10).select(F.col("query").alias("a"), F.col("neighbour").alias("b"))
    return matrix.propagated_labels(e.select(F.col("vec_id").alias("node")), edges)


@query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five principal components of the vectors."""
    return matrix.principal_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query()
def kmeans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by k-means cluster."""
    return matrix.kmeans_tokens(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


KEY = ["fov", "marker"]
SIZE = (1.0, 2.0, 2.0)


def voxel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots as voxels of their field of view and marker."""
    return cut(voxels.voxelise(spots(spark, sf_dir).select(*KEY, "z", "y", "x", "integrated"), KEY, "integrated", SIZE))


_VOX = f"""WITH {SPOTS}, vox AS (SELECT fov, marker, CAST(floor(z / 1.0) AS INT) AS z, CAST(floor(y / 2.0) AS INT) AS y, CAST(floor(x / 2.0) AS INT) AS x, sum(integrated) AS v
FROM spots WHERE integrated IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
"""


@query(_VOX + "SELECT fov, marker, y, x, round(max(v), 3) AS v FROM vox GROUP BY 1, 2, 3, 4")
def max_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum over z of the voxels."""
    return voxels.max_projection(voxel_table(spark, sf_dir), KEY).withColumn("v", R("v", 3))


@query(_VOX + """, t AS (SELECT fov, marker, 1.5 * avg(v) AS t FROM (SELECT fov, marker, y, x, max(v) AS v FROM vox GROUP BY 1, 2, 3, 4) WHERE v > 0 GROUP BY 1, 2)
SELECT fov, marker, count(*) AS n_voxels FROM vox JOIN t USING (fov, marker) WHERE v > t GROUP BY 1, 2""")
def detect_mean_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground by a multiple of the mean projection."""
    return voxels.detect(voxel_table(spark, sf_dir), KEY, "mean_fold").groupBy(*KEY).agg(F.count("*").alias("n_voxels"))


def _detected(family: str, doc: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return voxels.detect(voxel_table(spark, sf_dir), KEY, family).groupBy(*KEY).agg(F.count("*").alias("n_voxels"))

    f.__name__, f.__doc__ = f"detect_{family}", doc
    return query()(f)


_detected("mad_tophat", "Foreground above the opened background by a multiple of the noise.")
_detected("log_dog", "Foreground of a difference of two blurs.")
_detected("h_dome", "Voxels near their summit.")
_detected("otsu_adaptive", "Foreground by Otsu's threshold.")
_detected("wavelet", "Foreground of the product of wavelet planes.")


@query()
def region_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of the detected foreground with their properties, those at the border left out."""
    fg = cut(voxels.detect(voxel_table(spark, sf_dir), KEY, "mean_fold", threshold=1.0))
    props = cut(voxels.region_properties(voxels.components(fg, KEY, full=True), KEY))
    return voxels.inner_labels(props, KEY)


@query()
def spot_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the detected foreground, parted at h-maxima and size-gated, with their properties."""
    o = voxels.objects(voxel_table(spark, sf_dir), KEY, "mean_fold", threshold=1.05, marker_h=50.0, min_size=1)
    return voxels.region_properties(o, KEY)


@query()
def watershed_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of steepest ascent: size and summit."""
    b = voxels.basins(voxel_table(spark, sf_dir), KEY)
    return b.groupBy(*KEY, "to_z", "to_y", "to_x").agg(F.count("*").alias("n_voxels"), F.max("v").alias("summit"))
