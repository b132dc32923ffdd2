"""Interval panel design: windows, overlaps, hubs, imaging order, readouts, oligos."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions import exprs
from spotframe.operators.joins import lookup, nearest_group, running_total, same

#: Half of a window about a centre, the least width of an enhancer, the widest gap in a hub.
HALF = 5_000
LEAST = 10_000
GAP = 750_000


def group_token(name: Column) -> Column:
    """Name without its ``E1_`` / ``P_`` mark."""
    return F.regexp_replace(name, r"^(E|P)\d*_", "")


def feature_windows(f: DataFrame) -> DataFrame:
    """``dna_s``, ``dna_e``, ``tss_off``, ``note``: enhancers below the least width are widened about their centre; promoters are centred on their TSS if known.

    ``f``: name, type, strand, s, e, tss (NULL for unknown). NULL bounds stay NULL.
    """
    small = (F.col("type") == "E") & (F.col("e") - F.col("s") < LEAST)
    centre = F.floor((F.col("s") + F.col("e")) / 2 + 0.5).cast("long")
    tss = (F.col("type") == "P") & F.col("tss").isNotNull()
    edge = F.when(F.col("strand") == "+", F.col("s")).otherwise(F.col("e"))
    note = F.concat_ws("; ", "note", F.when(small, F.format_string("window expanded %dbp->10kb", F.col("e") - F.col("s"))))
    return f.withColumns(
        {
            "dna_s": F.when(small, centre - HALF).when(tss, F.col("tss") - HALF).otherwise(F.col("s")),
            "dna_e": F.when(small, centre + HALF).when(tss, F.col("tss") + HALF).otherwise(F.col("e")),
            "tss_off": F.when(tss, F.col("tss") - edge),
            "note": note,
        }
    )


def group_spans(f: DataFrame, key: list[str]) -> DataFrame:
    """Per key, chr and token: span of centres and whether it has an enhancer."""
    c = (F.col("rna_s") + F.col("rna_e")) / 2
    return f.groupBy(*key, "chr", group_token(F.col("name")).alias("token")).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.bool_or(F.col("type") == "E").alias("has_e"), F.count("*").alias("n"))


def hubs(f: DataFrame, panel: str, gap: float = GAP) -> DataFrame:
    """``panel``, ``chr``, ``token``, ``hub``: groups without enhancer join the nearest one with, within the gap."""
    g = group_spans(f, [panel]).withColumn("_k", F.concat_ws("|", F.col(panel).cast("string"), "chr"))
    near = nearest_group(g.select("_k", "token", "lo", "hi", "has_e"), "_k", "token", "lo", "hi", "has_e", gap)
    return g.join(near.select("_k", "token", "nearest"), ["_k", "token"], "left").select(panel, "chr", "token", F.coalesce("nearest", "token").alias("hub"))


def corrected(f: DataFrame, shifts: dict[str, int], drop: list[str], more: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """Features with their corrections, drops and additions, then their TSS.

    ``shifts``: name pattern -> number added to ``s`` and ``e`` (noted). ``drop``: names left
    out. ``more``: features that are added. ``corrections``: ``key`` and ``new_tss``,
    ``new_strand``, ``new_note``; of several for a feature the least holds. What one gives wins
    over the feature's own, NULL keeps it.
    """
    rows = f.where(~F.coalesce(F.col("name").isin(drop), F.lit(False)))
    for pattern, by in shifts.items():
        hit = F.coalesce(F.col("name").rlike(pattern), F.lit(False))
        note = F.concat_ws("; ", "note", F.when(hit, F.lit(f"COORD FIX: {by:+d}")))
        rows = rows.withColumns({"s": F.when(hit, F.col("s") + by).otherwise(F.col("s")), "e": F.when(hit, F.col("e") + by).otherwise(F.col("e")), "note": F.nullif(note, F.lit(""))})
    rows = rows.unionByName(more)
    first = corrections.groupBy(*[F.col(k).alias(f"c_{k}") for k in key]).agg(F.min(F.struct("new_tss", "new_strand", "new_note")).alias("c"))
    rows = rows.join(first, same(key, "c_"), "left")
    return rows.select(*[F.coalesce(f"c.new_{c}", c).alias(c) if c in ("tss", "strand", "note") else F.col(c) for c in f.columns])


def imaging_order(f: DataFrame, panel: str, pinned: list[str] | None = None) -> DataFrame:
    """``panel``, ``name``, ``chr``, ``round``: enhancers, then promoters, then the pinned promoters in their order.

    Within enhancers and promoters each round takes the chromosome with most features left,
    unlike the one before where possible; of equals the one with most at first, then by name.
    Which chromosome comes when depends only on their counts, a few per panel; that sequence is
    made from one row per panel and type and streamed out, and features take their places by
    their position in the chromosome. Without a ``type`` all are promoters. Features without a chromosome have no round.
    """
    names = F.array(*[F.lit(n) for n in pinned or []]).cast("array<string>")
    sort = F.col("type") if "type" in f.columns else F.lit("P")
    tail = F.when(F.coalesce(sort != "E", F.lit(True)), F.nullif(F.array_position(names, F.col("name")), F.lit(0).cast("long")))
    rows = f.where("chr IS NOT NULL").withColumn("_tail", tail).withColumn("_part", F.when(F.col("_tail").isNotNull(), 2).when(sort == "E", 0).otherwise(1))
    free = rows.where("_part < 2")
    counts = free.groupBy(panel, "_part", "chr").agg(F.count("*").alias("n")).groupBy(panel, "_part").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "chr"))).alias("counts"))
    kind = f.schema[panel].dataType.simpleString()
    columns = [panel, "_part", "chr", "_k", "_turn"]

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for ident, part, counts in zip(p[panel], p["_part"], p["counts"]):
                left, seen, last, out = {c["chr"]: -c["m"] for c in counts}, {}, None, []
                for i in range(sum(left.values())):
                    pool = [c for c in left if left[c] and c != last] or [c for c in left if left[c]]
                    last = max(pool, key=lambda c: left[c])
                    left[last] -= 1
                    seen[last] = seen.get(last, 0) + 1
                    out.append((ident, part, last, seen[last], i + 1))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    order = counts.mapInPandas(turns, f"`{panel}` {kind}, _part int, chr string, _k long, _turn long")
    place = F.row_number().over(Window.partitionBy(panel, "_part", "chr").orderBy("rna_s", "name")).cast("long")
    placed = free.withColumn("_k", place).join(order, [panel, "_part", "chr", "_k"]).select(panel, "name", "chr", "_part", "_turn")
    placed = placed.unionByName(rows.where("_part = 2").select(panel, "name", "chr", "_part", F.col("_tail").alias("_turn")))
    sizes = rows.groupBy(panel, "_part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(panel).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return placed.join(before, [panel, "_part"]).select(panel, "name", "chr", (F.col("_before") + F.col("_turn")).alias("round"))


def readout_scheme(order: DataFrame, panel: str, wells: int = 96, no_rna: DataFrame | None = None, staged: DataFrame | None = None) -> DataFrame:
    """``panel``, ``imaging_round``, ``block``, ``plate``, ``readout``, ``feature``: RNA readouts from 1, DNA ones from the next plate on.

    Features in ``no_rna`` (panel, name) get no RNA round; the DNA rounds follow the RNA rounds.
    ``staged``: panel, ``sub``, ``rna``, ``dna``: readouts without a round, given as they are.
    """
    skip = order.select(panel, "name", F.lit(False).alias("_rna")).limit(0) if no_rna is None else no_rna.select(panel, "name", F.lit(False).alias("_rna")).distinct()
    rows = order.join(skip, [panel, "name"], "left").withColumn("_rna", F.coalesce("_rna", F.lit(True)))
    rows = running_total(rows.withColumn("_one", F.col("_rna").cast("long")), [panel], "round", "_one", "_nth")
    n = rows.groupBy(panel).agg(F.sum("_one").alias("_n"))
    rna = F.when(F.col("_rna"), F.struct(F.lit("RNA").alias("block"), F.col("_nth").alias("imaging_round"), F.col("_nth").alias("readout")))
    dna = F.struct(F.lit("DNA").alias("block"), (F.col("_n") + F.col("round")).alias("imaging_round"), (F.ceil(F.col("_n") / wells) * wells + F.col("round")).alias("readout"))
    cells = rows.join(n, panel).select(panel, "name", F.explode(F.array_compact(F.array(rna, dna))).alias("b")).select(panel, "name", "b.*")
    if staged is not None:
        more = [staged.select(panel, F.col("sub").alias("name"), F.lit(f"{b}-sub").alias("block"), F.lit(None).cast("long").alias("imaging_round"), F.col(b.lower()).cast("long").alias("readout")) for b in ("RNA", "DNA")]
        cells = cells.unionByName(more[0]).unionByName(more[1])
    return cells.select(panel, "imaging_round", "block", exprs.plate(F.col("readout"), wells).alias("plate"), "readout", F.concat_ws("_", F.substring("block", 1, 3), "name").alias("feature"))


def dual_barcodes(overlaps: DataFrame, types: DataFrame, readouts: DataFrame, panel: str, wells: int = 96) -> DataFrame:
    """Overlaps of an enhancer with a promoter as zones: the carrier has its own DNA readout and the partner's as second.

    ``overlaps``: panel, chr, a, b, overlap_start, overlap_end; ``types``: panel, name, type;
    ``readouts``: of ``readout_scheme``. The partner's probes in the zone are dropped. A feature
    without a DNA readout is an error when read.
    """
    t = lambda side: types.select(panel, F.col("name").alias(side), F.col("type").alias(f"_t{side}"))
    rows = overlaps.join(t("a"), [panel, "a"]).join(t("b"), [panel, "b"]).where("_ta <> _tb")
    dna = readouts.where("block = 'DNA'").select(F.concat_ws("|", F.col(panel).cast("string"), F.expr("substring(feature, 5)")).alias("_key"), "readout")
    for side, name in (("a", "primary"), ("b", "secondary")):
        keyed = rows.withColumn("_key", F.concat_ws("|", F.col(panel).cast("string"), side))
        rows = lookup(keyed, dna, "_key", "readout", "DNA readout").withColumnRenamed("readout", name).drop("_key")
    plate = lambda c: exprs.plate(F.col(c), wells).alias(f"plate_{c}")
    return rows.select(panel, F.lit("overlap").alias("zone"), F.col("a").alias("carrier"), F.col("b").alias("partner"), F.lit("drop").alias("partner_action"), "chr", F.col("overlap_start").alias("region_start"), F.col("overlap_end").alias("region_end"), "primary", plate("primary"), "secondary", plate("secondary"))


def zones(dual: DataFrame, panel: str) -> DataFrame:
    """``panel``, ``feature``, ``start``, ``end``, ``r2``: carriers' zones with the second readout, partners' dropped ones with -1."""
    z = lambda who, r2: dual.select(panel, F.col(who).alias("feature"), F.col("region_start").alias("start"), F.col("region_end").alias("end"), r2.cast("long").alias("r2"), "partner_action")
    return z("carrier", F.col("secondary")).unionByName(z("partner", F.lit(-1)).where("partner_action = 'drop'")).drop("partner_action")


def bed_rows(f: DataFrame, panel: str, colour: Column) -> DataFrame:
    """Two BED9 rows per feature, 0-based starts, thick over their whole length; a window without bounds has no row."""
    cell = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), F.col(s).alias("s"), F.col(e).alias("e"))
    rows = f.select(panel, "chr", "name", "strand", colour.alias("rgb"), F.explode(F.array(cell("DNA", "dna_s", "dna_e"), cell("RNA", "rna_s", "rna_e"))).alias("b"))
    start = F.col("b.s") - 1
    return rows.where("b.s IS NOT NULL AND b.e IS NOT NULL").select(panel, "chr", start.alias("start"), F.col("b.e").alias("end"), F.concat_ws("_", "b.kind", "name").alias("name"), F.lit(0).alias("score"), "strand", start.alias("thick_start"), F.col("b.e").alias("thick_end"), "rgb")


def oligo(forward: Column, second: Column, first: Column, target: Column, back: Column) -> Column:
    """Forward primer, second readout or placeholder, first readout, target reversed in lower case, reverse primer."""
    return F.concat(F.upper(forward), second, first, F.lower(exprs.reverse_complement(target)), F.upper(exprs.reverse_complement(back)))


def probe_centre(start: Column, end: Column, offset: Column, length: int, reversed_: Column) -> Column:
    """Genomic centre of a probe; mirrored where the target was reverse-complemented."""
    return F.when(reversed_, end - offset - length / 2).otherwise(start + offset + length / 2)
