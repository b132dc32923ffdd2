"""Keyword ranking of cards, link expansion and rendering to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import tokens


def card_score(text: Column, tags: Column, words: list[str], want_tags: list[str]) -> Column:
    """Distinct query tokens in the text or tags, plus 2 for each exact tag."""
    want = F.array(*[F.lit(w) for w in sorted({*[x for w in words for x in w.lower().split()], *[t.lower() for t in want_tags]})]).cast("array<string>")
    hay = F.array_union(tokens(text), F.transform(tags, lambda t: F.lower(t)))
    low = F.transform(tags, lambda t: F.lower(t))
    bonus = F.size(F.array_intersect(low, F.array(*[F.lit(t.lower()) for t in want_tags]).cast("array<string>")))
    return F.size(F.array_intersect(want, hay)) + 2 * bonus


def search(cards: DataFrame, words: list[str], want_tags: list[str], limit: int, kind: str | None = None) -> DataFrame:
    """The best ``limit`` cards by (-score, name); zero scores only for an empty query.

    ``cards``: name, text, tags, type. The limit is the feature: the sort keeps ``limit`` rows
    per task.
    """
    rows = cards if kind is None else cards.where(F.col("type") == kind)
    rows = rows.withColumn("score", card_score(F.col("text"), F.col("tags"), words, want_tags))
    if words or want_tags:
        rows = rows.where("score > 0")
    return rows.orderBy(F.col("score").desc(), "name").limit(limit)


def expand_links(seed: DataFrame, cards: DataFrame, link: str, limit: int, first_types: list[str]) -> DataFrame:
    """Seed cards, then cards one link away that are not seeds; preferred types first, then seeds, then name."""
    seeds = seed.select("name", "type", link, F.lit(0).alias("hop"), F.row_number().over(Window.orderBy(F.col("score").desc(), "name")).alias("pos"))
    linked = cards.join(F.broadcast(seeds.select(link).where(F.col(link).isNotNull()).distinct()), link, "left_semi").join(F.broadcast(seeds.select("name")), "name", "left_anti")
    rows = seeds.select("name", "type", "hop", "pos").unionByName(linked.select("name", "type", F.lit(1).alias("hop"), F.lit(0).alias("pos")))
    return rows.orderBy((~F.coalesce(F.col("type").isin(first_types), F.lit(False))).cast("int"), "hop", "pos", "name").limit(limit)


def budget_render(ranked: DataFrame, block: Column, order: list, budget: int) -> DataFrame:
    """Blocks in rank order, cut where the running length passes the budget.

    ``ranked`` is a bounded top list; its running sum is one small window.
    """
    rows = ranked.withColumn("block", block)
    upto = F.sum(F.length("block")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", upto - F.length("block")).where(F.col("used") < budget)
    return rows.withColumn("block", F.expr(f"CASE WHEN used + length(block) > {budget} THEN concat(substring(block, 1, {budget} - used), ' …') ELSE block END"))


def upsert(cards: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Cards with changed ones replaced; tags and sources of both are kept, in order, once."""
    merged = changes.alias("n").join(cards.alias("o"), key, "left").select(
        key, *[(F.array_distinct(F.concat(F.coalesce(f"o.{c}", F.array().cast("array<string>")), F.coalesce(f"n.{c}", F.array().cast("array<string>")))) if c in ("tags", "sources") else F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in cards.columns if c != key]
    )
    return cards.join(changes.select(key), key, "left_anti").unionByName(merged)


def expectations(markers: DataFrame, cards: DataFrame, value: str) -> DataFrame:
    """``markers`` with ``value`` of the card whose slug is ``<marker>-biology``, in lower case; NULL without one.

    ``cards``: ``slug`` (once each) and ``value``.
    """
    known = cards.select(F.lower("slug").alias("_slug"), F.col(value))
    return markers.join(known, F.concat(F.lower("marker"), F.lit("-biology")) == F.col("_slug"), "left").drop("_slug")
