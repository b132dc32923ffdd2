"""Merging overlapping intervals per key into disjoint stretches, and their gaps.

The work follows a mergeable aggregate whose state is a sorted list of disjoint intervals.
Partial lists are combined by linear merges in a reduction tree:

* inside a task, before any shuffle, each Arrow batch gives a list of each key, and two lists
  of equal height are merged into one of the next height;
* the lists of a (key, slot) from all tasks meet in one task, which merges them;
* the slots of a key are joined by a running maximum over one row per slot.

A slot is a range of start positions. Keys of up to ``slot_rows`` intervals have one slot; a
larger key is cut at quantiles of its starts until every slot is within that, so no task ever
holds an unbounded key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import coarse_cuts, slot_of
from spotframe.session import cut

#: Lists of several keys: the key's number, start and end, by number and start.
Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def canonical_chromosome(c: Column) -> Column:
    """``chr7``, ``Chr7``, ``CHR7`` and ``7`` all become ``chr7``; sex chromosomes upper-case."""
    return F.concat(F.lit("chr"), F.upper(F.regexp_replace(F.trim(c), "(?i)^chr", "")))


def clean_intervals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """``key``, ``s``, ``e``: NULL bounds and empty intervals dropped, swapped bounds put right.

    NULL keys are kept as a group of their own. Other columns are dropped, so clashing names
    can't disturb the operators below.
    """
    a, b = F.col(start).cast("long"), F.col(end).cast("long")
    return df.select(*key, F.least(a, b).alias("s"), F.greatest(a, b).alias("e")).where(
        a.isNotNull() & b.isNotNull() & (F.col("s") < F.col("e"))
    )


def _joined(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> Lists:
    """Ordered intervals as disjoint ones; touching ones join."""
    upto = pd.Series(e).groupby(code).cummax().to_numpy()
    new = np.r_[True, (code[1:] != code[:-1]) | (s[1:] > upto[:-1])]
    at = np.flatnonzero(new)
    return code[at], s[at], np.maximum.reduceat(e, at)


def _merged(a: Lists, b: Lists) -> Lists:
    """One list of two. The stable sort finds the two ascending runs and merges them in linear time."""
    code, s, e = (np.concatenate(x) for x in zip(a, b))
    low, span = int(s.min()), int(s.max()) - int(s.min()) + 1
    if span * (int(code.max()) + 1) < 2**62:
        order = np.argsort(code * span + (s - low), kind="stable")
    else:
        order = np.lexsort((s, code))
    return _joined(code[order], s[order], e[order])


class _Keys:
    """Numbers for the keys that a task has met."""

    def __init__(self, key: list[str]):
        self.key, self.number, self.types = key, {}, None

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        mixed = np.zeros(batch.num_rows, "int64")
        for c in self.key:
            d = batch.column(c).dictionary_encode(null_encoding="encode")
            mixed = mixed * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False)
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        some = batch.select(self.key).take(pa.array(first))
        self.types = some.schema
        found = zip(*[c.to_pylist() for c in some.columns])
        return np.array([self.number.setdefault(k, len(self.number)) for k in found], "int64")[back]

    def batch(self, lists: Lists) -> pa.RecordBatch:
        code, s, e = lists
        keys = [pa.array(v, self.types.field(i).type).take(pa.array(code)) for i, v in enumerate(zip(*self.number))]
        return pa.RecordBatch.from_arrays([*keys, pa.array(s), pa.array(e)], names=[*self.key, "s", "e"])


def _lists_of(batch: pa.RecordBatch, keys: _Keys) -> Lists:
    code, s, e = keys.codes(batch), batch.column("s").to_numpy(), batch.column("e").to_numpy()
    order = np.lexsort((s, code))
    return _joined(code[order], s[order], e[order])


def disjoint_intervals(df: DataFrame, key: list[str], slot_rows: int = 200_000) -> DataFrame:
    """``key``, ``slot``, ``s``, ``e``: sorted disjoint lists per key and slot of ``clean_intervals``.

    Intervals of different slots of one key may still overlap; ``stretches_and_gaps`` joins them.
    """
    names = [*key, "slot"]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tree = _Keys(key), []  # the tree's open lists with their heights, highest first
        for b in batches:
            if not b.num_rows:
                continue
            height, lists = 0, _lists_of(b, keys)
            while tree and tree[-1][0] == height:
                height, lists = height + 1, _merged(tree.pop()[1], lists)
            tree.append((height, lists))
            if len(lists[0]) > slot_rows:  # what doesn't shrink goes out, so that a task stays small
                yield keys.batch(reduce(_merged, [t for _, t in reversed(tree)]))
                keys, tree = _Keys(key), []
        if tree:
            yield keys.batch(reduce(_merged, [t for _, t in reversed(tree)]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is not None and not b.num_rows:
                continue
            rows = b if held is None else held if b is None else pa.concat_batches([held, b])
            if rows is None:
                continue
            keys = _Keys(names)
            code = keys.codes(rows)
            last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if b is not None and (code != code[-1]).any() else 0
            if b is None:
                last = rows.num_rows
            held = rows.slice(last)
            if last:
                yield keys.batch(_lists_of(rows.slice(0, last), keys))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    lists = cut(df.mapInArrow(partial, types))
    slotted = _slots(lists, key, slot_rows)
    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key]
    near = slotted.repartition(*names).sortWithinPartitions(*names)
    return cut(near.mapInArrow(whole, ", ".join([*kept, "slot long", "s long", "e long"])))


def _slots(lists: DataFrame, key: list[str], slot_rows: int, ways: int = 1024) -> DataFrame:
    """``lists`` with ``slot``: (key, slot) above ``slot_rows`` are cut into up to ``ways`` until none is left.

    Only intervals with one and the same start stay together.
    """
    names = [*key, "slot"]
    rows = lists.withColumn("slot", F.lit(0).cast("long"))
    while True:
        large = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).where((F.col("n") > slot_rows) & (F.col("lo") < F.col("hi")))
        large = cut(large.select(*[F.col(c).alias(f"k_{c}") for c in names], "n", "lo"))
        if large.isEmpty():
            return rows
        on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in names])
        points = F.percentile_approx("s", [i / ways for i in range(1, ways)], F.lit(10_000))
        hot = rows.join(large, on).groupBy(*[f"k_{c}" for c in names]).agg(points.alias("q"), F.max(F.ceil(F.lit(ways * slot_rows) / F.col("n"))).alias("step"), F.max("lo").alias("lo"))
        cuts = F.array_distinct(F.filter(F.filter("q", lambda _, i: (i + 1) % F.col("step") == 0), lambda x: x > F.col("lo")))
        hot = hot.withColumn("cuts", F.when(F.size(cuts) > 0, cuts).otherwise(F.array(F.col("lo") + 1))).withColumn("coarse", coarse_cuts(F.col("cuts")))
        slot = F.col("slot") * ways + slot_of(F.col("coarse"), F.col("cuts"), F.col("s"), inclusive=True)
        rows = cut(rows.join(hot, on, "left").select(*key, slot.alias("slot"), "s", "e"))


def stretches_and_gaps(lists: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``kind``, ``seg_start``, ``seg_end`` from ``disjoint_intervals``.

    ``merged`` for each continuous stretch (a single interval included; end = start touches),
    ``gap`` from the end of a stretch to the start of the next of the same key. An empty table
    gives no rows.
    """
    slot, row = Window.partitionBy(*key).orderBy("slot"), Window.partitionBy(*key, "slot").orderBy("s")
    first = slot.rowsBetween(Window.unboundedPreceding, -1)
    # per slot: the furthest end before it, and how many stretches begin before it
    ends = lists.groupBy(*key, "slot").agg(F.max("e").alias("slot_end")).withColumn("carry", F.max("slot_end").over(first)).drop("slot_end")
    ends = ends.select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("slot").alias("k_slot"), "carry")
    cond = F.col("slot") == F.col("k_slot")
    for c in key:
        cond = cond & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    rows = lists.join(ends, cond).select(*key, "slot", "s", "e", "carry")
    rows = rows.withColumn("prev", F.greatest("carry", F.lag("e").over(row))).withColumn(
        "new", (F.col("prev").isNull() | (F.col("s") > F.col("prev"))).cast("long")
    )
    counts = rows.groupBy(*key, "slot").agg(F.sum("new").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(first), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("slot").alias("k_slot"), "base")
    rows = rows.join(counts, cond).withColumn("no", F.col("base") + F.sum("new").over(row))
    merged = rows.groupBy(*key, "no").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("new") == 1, F.col("prev"))).alias("from"))
    return merged.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit("merged").alias("kind"), F.col("s").alias("seg_start"), F.col("e").alias("seg_end")),
                F.struct(F.lit("gap").alias("kind"), F.col("from").alias("seg_start"), F.col("s").alias("seg_end")),
            )
        ).alias("x"),
    ).select(*key, "x.*").where(F.col("seg_start").isNotNull())


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, slot_rows: int = 200_000) -> DataFrame:
    """Stretches and gaps of the intervals ``start``..``end`` per ``key``, whole and exact."""
    return stretches_and_gaps(disjoint_intervals(clean_intervals(df, key, start, end), key, slot_rows), key)


def latest_rows(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """Per key the row with the greatest ``by`` (NULL counts least), once.

    Rows that tie are told apart by a hash of all their columns, so the choice doesn't depend
    on the partitioning. The key's rows are its revisions, a few.
    """
    w = Window.partitionBy(*key).orderBy(F.col(by).desc_nulls_last(), F.xxhash64(*[F.to_json(F.struct("*"))]))
    return df.withColumn("_latest_rank", F.row_number().over(w)).where("_latest_rank = 1").drop("_latest_rank")
