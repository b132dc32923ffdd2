"""Texts in containers of fixed capacity: optimal length buckets and token-budget batches.

Only a text longer than the capacity is split, into pieces of exactly the capacity and one rest.
The histogram of piece lengths over all data has at most ``capacity`` entries, so it is the one
thing the driver sees. On it, dynamic programming chooses the bucket boundaries that minimise
padding; then a plan is made for counts of equal lengths, not for items: the pieces of a bucket
form batches by token budget among themselves, and the shortest buckets, as many as it takes, use
up the room that these leave, the tightest fit first. An item takes its place in the plan by its length and its rank
among the items of that length; ranks come from salted counts, so a length that a third of all
items share is spread over all tasks.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.exprs import coarse_cuts, slot_of
from spotframe.session import cut

#: A token is a longest run of letters, digits and underscores, or of other characters that
#: aren't white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def word_tokens(text: Column) -> Column:
    """Number of tokens of a text by ``TOKEN``; NULL for a NULL text. Runs inside the JVM."""
    return F.regexp_count(text, F.lit("(?U)" + TOKEN)).cast("long")


def bpe_tokens(docs: DataFrame, doc_id: str, text: str, ranks_path: str, pattern: str, most_bytes: int = 64_000_000) -> DataFrame:
    """``id``, ``n_tokens`` by a byte-pair vocabulary in tiktoken's format.

    The driver reads the file at ``ranks_path`` (a vocabulary; more than ``most_bytes`` is an
    error) and broadcasts it, so executors need no copy.
    """
    if os.path.getsize(ranks_path) > most_bytes:
        raise ValueError(f"{ranks_path}: more than {most_bytes} bytes")
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoder = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "n_tokens": [0 if t is None else len(encoder.encode_ordinary(t)) for t in p["text"]]})

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInPandas(count, "id long, n_tokens long")


def split_text(text: str, capacity: int) -> list[str]:
    """Pieces of at most ``capacity`` tokens whose concatenation is the text."""
    import regex

    starts = [m.start() for m in regex.finditer(TOKEN, text)]
    cuts = [0, *starts[capacity::capacity], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, capacity: int, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding, by dynamic programming.

    An item of bucket b is padded to b; the last bound is the largest length.
    The plain recurrence over all distinct lengths, one bucket more per round. A start of the last
    bucket is a line in its bound, with slopes that fall and bounds that grow, so the least one
    moves forward along their lower hull and a round takes linear time.
    """
    order = np.argsort(lengths)
    upper = [int(v) for v in lengths[order]]
    n = [0, *np.cumsum(counts[order]).tolist()]
    t = [0, *np.cumsum(lengths[order] * counts[order]).tolist()]
    m = len(upper)
    best: list[int | None] = [0] + [None] * m  # of the first j lengths; None: not possible
    choice = []
    for _ in range(buckets):
        new, arg = [0] + [None] * m, [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, start
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                k, v = -n[j - 1], best[j - 1] + t[j - 1]
                while len(hull) > 1 and (v - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - k):
                    hull.pop()
                hull.append((k, v, j - 1))
            u, at = upper[j - 1], min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * u + hull[at + 1][1] <= hull[at][0] * u + hull[at][1]:
                at += 1
            new[j] = hull[at][0] * u + hull[at][1] + u * n[j] - t[j]
            arg[j] = hull[at][2]
        choice.append(arg)
        best = new
    out, j = [], m
    for arg in reversed(choice):
        if j == 0:
            break
        out.append(upper[j - 1])
        j = arg[j]
    return sorted(set(out))


def packing_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, boundaries: list[int]) -> pd.DataFrame:
    """Runs: items ``rank_from``..``rank_to`` of a ``length`` go, ``per`` to a container, to containers from ``first``.

    The items of a bucket form batches of at most ``capacity`` tokens among themselves; then the
    shortest buckets, which are held back, fill the room that these leave, bucket by bucket. So
    many are held back as give the fewest containers, and of equal plans the fewest. Open
    containers are held as runs of equal room, by room; a run is cut where it is used in part. The
    number of runs depends on the distinct lengths, not on the items.
    """
    bucket = np.searchsorted(np.array(boundaries), lengths, "left")
    members = [sorted(((int(lengths[i]), int(counts[i])) for i in np.flatnonzero(bucket == b)), reverse=True) for b in range(len(boundaries))]
    least, plan, rooms, fresh = None, [], [], 0
    batches, left = [], []  # of the buckets that aren't held back
    for held in range(len(boundaries) - 1, -1, -1):
        rows, more, fresh = _batches(members[held], capacity, [], fresh)
        batches, left = batches + rows, sorted(left + more)
        rows, rooms, end = [], left, fresh
        for b in range(held - 1, -1, -1):
            filled, rooms, end = _batches(members[b], capacity, rooms, end)
            rows += filled
        if least is None or end <= least:
            least, plan = end, batches + rows
    return pd.DataFrame(plan, columns=["length", "rank_from", "rank_to", "per", "first"])


def _batches(members: list[tuple[int, int]], capacity: int, rooms: list[tuple[int, int, int]], fresh: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """Runs of ``members`` (length, items; longest first), the rooms left and the next new container.

    Items go to the tightest of ``rooms`` (room, first container, containers; sorted), else to new
    containers from ``fresh``.
    """
    rows, rooms = [], list(rooms)
    for length, left in members:
        rank = 0
        while left:
            k = bisect_left(rooms, (length, -1, -1))
            if k < len(rooms):
                room, first, n = rooms.pop(k)
                per = min(room // length, left)
            else:
                room, first, n = capacity, fresh, None
                per = min(capacity // length, left)
                n = left // per
                fresh += n
            use = min(n, left // per)
            rows.append((length, rank, rank + use * per, per, first))
            rank, left = rank + use * per, left - use * per
            if use < n:
                insort(rooms, (room, first + use, n - use))
            if room - per * length > 0:
                insort(rooms, (room - per * length, first, use))
    return rows, rooms, fresh


def pieces(items: DataFrame, capacities: list[int]) -> DataFrame:
    """``capacity``, ``id``, ``n_pieces``, ``piece`` (from 0), ``length``: an item within the capacity is one piece; empty items none."""
    rows = items.where("n_tokens > 0").select("id", "n_tokens", F.explode(F.array(*[F.lit(c) for c in capacities])).alias("capacity"))
    n = F.ceil(F.col("n_tokens") / F.col("capacity"))
    rest = F.col("n_tokens") - (n - 1) * F.col("capacity")
    length = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.when(i < n, F.col("capacity").cast("long")).otherwise(rest))
    return rows.select("capacity", "id", n.alias("n_pieces"), F.posexplode(length).alias("piece", "length")).withColumn("length", F.col("length").cast("int"))


def pack_all(items: DataFrame, capacities: list[int], buckets: int = 16, salt_rows: int = 1_000_000) -> DataFrame:
    """``capacity``, ``id``, ``piece``, ``n_pieces``, ``length``, ``container``: where each piece goes, for each capacity.

    ``items``: ``id``, ``n_tokens``. Containers of a capacity are numbered from 0 and hold at
    most ``capacity`` tokens. Items of equal length are placed by their id's hash, so the result
    doesn't depend on the partitioning; they are ranked in as many salted parts as keep one near
    ``salt_rows`` even if all items were equally long. Items without tokens take no room and get
    no row; an empty table gives no rows.
    """
    spark, key = items.sparkSession, ["capacity", "length", "salt"]
    parts = cut(pieces(items, capacities))
    salts = max(16, -(-parts.count() // salt_rows))
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    sizes = parts.groupBy(*key).agg(F.count("*").alias("n"))
    rows = sizes.groupBy("capacity", "length").agg(F.sum("n").alias("n")).toPandas()  # at most the sum of the capacities
    runs = []
    for capacity, h in rows.groupby("capacity"):
        lengths, counts = h["length"].to_numpy("int64"), h["n"].to_numpy("int64")
        plan = packing_plan(lengths, counts, int(capacity), bucket_boundaries(lengths, counts, int(capacity), buckets)).sort_values(["length", "rank_from"])
        for length, g in plan.groupby("length"):
            runs.append((int(capacity), int(length), *[g[c].astype("int64").tolist() for c in ("rank_from", "per", "first")]))
    table = spark.createDataFrame(runs, "capacity int, length int, rank_from array<long>, per array<long>, first array<long>").withColumn("coarse", coarse_cuts(F.col("rank_from")))
    before = Window.partitionBy("capacity", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*key).orderBy(F.xxhash64("id"), "id", "piece")
    ranked = parts.withColumn("rn", F.row_number().over(within) - 1).join(offsets, key).withColumn("rank", F.col("rn") + F.col("offset"))
    # the plan has at most as many rows as the histogram
    placed = ranked.join(F.broadcast(table), ["capacity", "length"]).withColumn("i", slot_of(F.col("coarse"), F.col("rank_from"), F.col("rank"), inclusive=True) - 1)
    run = lambda c: F.col(c)[F.col("i")]
    return placed.select("capacity", "id", "piece", "n_pieces", "length", (run("first") + F.floor((F.col("rank") - run("rank_from")) / run("per"))).alias("container"))


def pack(items: DataFrame, capacity: int, buckets: int = 16) -> DataFrame:
    """``pack_all`` for one capacity, without that column."""
    return pack_all(items, [capacity], buckets).drop("capacity")
