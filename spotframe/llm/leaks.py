"""Evaluation passages inside a corpus, by q-gram counts in diagonal bands and banded alignment.

Every item is covered by windows of ``window_words`` consecutive words (an item of fewer words
is one window). A document holds a window within ``e`` edits only if, in a band of ``e``
diagonals either way, it shares at least ``n + 1 - q * (e + 1)`` of the window's q-grams (n: its
characters). Bands worth counting are found without loss: of any ``e + 1`` q-grams of a window
that don't overlap, at least one survives ``e`` edits, so each window is looked up by the
``e + 1`` that are rarest together; every hit opens the band around its diagonal. Counted bands that meet the
bound are verified by banded alignment, all windows of a batch at once.

The items are the query set. Their index is broadcast in blocks of bounded size; the documents
are read where they lie, once per block of items, and never shuffled. A window of under
``q * (e + 1)`` characters allows as many edits fewer as it is short of; one of under q none is
looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.text import chunks, gram_hashes, plain_words

_BITS = 24


def _rarest_disjoint(f: np.ndarray, many: int, q: int) -> np.ndarray:
    """Places of ``many`` q-grams that don't overlap with the least sum of ``f``, chosen together.

    A text of ``many * q`` characters or more always has them.
    """
    sums = [f]
    for _ in range(many - 1):
        before = np.minimum.accumulate(sums[-1])
        sums.append(np.r_[np.full(min(q, len(f)), np.inf), f[q:] + before[: len(f) - q]])
    out, end = [], len(f)
    for s in reversed(sums):
        out.append(int(s[:end].argmin()))
        end = out[-1] - q + 1
    return np.array(out)


class PassageIndex:
    """Windows, q-grams and the rarest-gram postings of a block of items."""

    def __init__(self, ids: list[int], texts: list[str | None], window_words: int = 13, max_edits: int = 1, q: int = 12):
        self.q, self.max_edits = q, max_edits
        self.chars, starts = plain_words(texts)
        self.ids, self.starts = np.array(ids, "int64"), starts[:-1]
        h = self.hashes = gram_hashes(self.chars, q)
        spaces = np.flatnonzero(self.chars == 32)
        item = np.searchsorted(self.starts, spaces, "right") - 1
        # windows from space to space, both included, inside one item
        rows = []
        for i in range(len(ids)):
            s = spaces[item == i] if len(ids) < 2 else spaces[np.searchsorted(item, i) : np.searchsorted(item, i, "right")]
            k = min(window_words, len(s) - 1)
            if k > 0:
                rows.append(np.stack([np.full(len(s) - k, i), s[:-k], s[k:] + 1, np.full(len(s) - k, k)], 1))
        w = np.concatenate(rows) if rows else np.zeros((0, 4), "int64")
        w = w[w[:, 2] - w[:, 1] >= q]
        self.w_item, self.w_from, self.w_to, self.w_words = (w[:, c].astype("int64") for c in range(4))
        n = self.w_to - self.w_from
        self.w_edits = np.minimum(max_edits, n // q - 1)
        # how rare a gram is among the items: its own document frequency and those of its 5-grams
        rare = self._frequency(q)
        short = np.r_[0.0, np.cumsum(self._frequency(5))]
        k = q - 5 + 1
        rare = 2 * rare + (short[k : k + len(rare)] - short[: len(rare)])
        chosen = np.zeros(len(rare), "bool")
        for a, b, e in zip(self.w_from, self.w_to, self.w_edits):
            # of equals, those that were chosen before: fewer postings
            chosen[a + _rarest_disjoint(rare[a : b - q + 1] - 1e-9 * chosen[a : b - q + 1], int(e) + 1, q)] = True
        at = np.flatnonzero(chosen)
        order = np.argsort(h[at], kind="stable") if len(at) else at
        self.p_hash, self.p_at = h[at][order] if len(at) else h[:0], at[order] if len(at) else at
        self.bitmap = np.zeros(1 << _BITS, "bool")
        self.bitmap[(self.p_hash >> np.uint64(64 - _BITS)).astype("int64")] = True
        # the windows that hold a posted gram whole are consecutive, as are their characters
        item_first = np.searchsorted(self.w_item, np.arange(len(ids) + 1))
        key = self.w_item * (len(self.chars) + 1)
        own = np.searchsorted(self.starts, self.p_at, "right") - 1
        lo = np.searchsorted(key + self.w_to, own * (len(self.chars) + 1) + self.p_at + q)
        hi = np.searchsorted(key + self.w_from, own * (len(self.chars) + 1) + self.p_at, "right")
        self.p_low, self.p_high = np.maximum(lo, item_first[own]), np.minimum(hi, item_first[own + 1])

    def _frequency(self, q: int) -> np.ndarray:
        """Log of the number of items that hold each q-gram, at every place."""
        h = gram_hashes(self.chars, q)
        if not len(h):
            return np.zeros(0)
        owner = np.searchsorted(self.starts, np.arange(len(h)), "right") - 1
        pairs = np.unique(np.stack([h, owner.astype("uint64")], 1), axis=0)
        grams, df = np.unique(pairs[:, 0], return_counts=True)
        return np.log(df)[np.searchsorted(grams, h)]

    def find(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """Verified windows: ``doc`` (place in texts), ``item`` (place in ids), ``words``, ``edits``,
        ``shared`` q-grams, and where they begin in the normalised item and document."""
        q, E = self.q, self.max_edits
        chars, starts = plain_words(texts)
        h = gram_hashes(chars, q)
        none = {k: np.zeros(0, "int64") for k in ("doc", "item", "words", "edits", "shared", "item_at", "doc_at")}
        hit = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype("int64")]) if len(h) and len(self.p_hash) else np.zeros(0, "int64")
        lo, hi = np.searchsorted(self.p_hash, h[hit]), np.searchsorted(self.p_hash, h[hit], "right")
        n = hi - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        if not len(hit):
            return none
        pos = np.repeat(hit, n)
        which = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        some = self.p_low[which] < self.p_high[which]
        pos, which = pos[some], which[some]
        diag = pos - self.p_at[which]
        doc = np.searchsorted(starts, pos, "right") - 1
        # first only every q-th gram from the hit on: an edit destroys one of those at most
        for step in (q, 1):
            w0, w1 = self.p_low[which], self.p_high[which]
            left = (self.p_at[which] - self.w_from[w0]) // step
            f = self.p_at[which] - left * step
            size = left + (self.w_to[w1 - 1] - q - self.p_at[which]) // step + 1
            base = np.r_[0, np.cumsum(size)]
            at = np.repeat(f - step * base[:-1], size) + step * np.arange(base[-1])
            there = at + np.repeat(diag, size)
            first, last = np.repeat(starts[doc], size), np.repeat(starts[doc + 1] - q, size)
            mine, meets = self.hashes[at], np.zeros(len(at), "bool")
            for k in range(-E, E + 1):
                x = there + k
                meets |= (h[np.clip(x, 0, len(h) - 1)] == mine) & (x >= first) & (x < last)
            if step == q:
                cs, many = np.r_[0, np.cumsum(meets)], w1 - w0
                hit_of = np.repeat(np.arange(len(pos)), many)
                w = np.repeat(w0 - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                x = -((f[hit_of] - self.w_from[w]) // q) + base[hit_of]
                y = (self.w_to[w] - q - f[hit_of]) // q + 1 + base[hit_of]
                keep = np.unique(hit_of[cs[y] - cs[x] >= y - x - self.w_edits[w]])
                pos, which, diag, doc = pos[keep], which[keep], diag[keep], doc[keep]
                if not len(pos):
                    return none
        # counts of each window in its band
        cs = np.r_[0, np.cumsum(meets)]
        many = w1 - w0
        hit_of = np.repeat(np.arange(len(pos)), many)
        w = np.repeat(w0 - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        x, y = self.w_from[w] - f[hit_of] + base[hit_of], self.w_to[w] - q + 1 - f[hit_of] + base[hit_of]
        shared, length = cs[y] - cs[x], y - x + q - 1
        keep = shared >= length + 1 - q * (self.w_edits[w] + 1)
        if not keep.any():
            return none
        rows = np.unique(np.stack([doc[hit_of], w, diag[hit_of], shared], 1)[keep], axis=0)
        doc, w, diag, shared = rows.T
        edits = np.concatenate([self._align(chars, w[s : s + 20_000], diag[s : s + 20_000]) for s in range(0, len(w), 20_000)])
        ok = edits <= self.w_edits[w]
        return {"doc": doc[ok], "item": self.w_item[w[ok]], "words": self.w_words[w[ok]], "edits": edits[ok], "shared": shared[ok], "item_at": self.w_from[w[ok]] - self.starts[self.w_item[w[ok]]], "doc_at": (self.w_from[w] + diag)[ok] - starts[doc[ok]]}

    def _align(self, chars: np.ndarray, w: np.ndarray, diag: np.ndarray) -> np.ndarray:
        """Least edits between each window and the document along its band, in one sweep.

        Column k of the band is diagonal ``diag + k - E``; the window must be used up, the
        document may begin and end anywhere in the band.
        """
        E, far = self.max_edits, 10**6
        width = 2 * E + 1
        a, n = self.w_from[w], self.w_to[w] - self.w_from[w]
        pad = np.r_[np.full(E + 1, 1, "uint32"), chars, np.full(E + 1, 1, "uint32")]
        cost = np.zeros((len(w), width), "int32")
        result = np.full(len(w), far, "int64")
        for t in range(int(n.max(initial=0))):
            live = t < n
            own = self.chars[np.minimum(a + t, len(self.chars) - 1)]
            at = np.clip((a + t + diag)[:, None] + np.arange(-E, E + 1) + E + 1, 0, len(pad) - 1)
            step = cost + (pad[at] != own[:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the window is left out
            for k in range(1, width):
                step[:, k] = np.minimum(step[:, k], step[:, k - 1] + 1)  # a character of the document is
            cost = np.where(live[:, None], step, cost)
        result[:] = cost.min(1) if width else far
        return result


def index_blocks(items: DataFrame, item_id: str, text: str, max_chars: int = 16_000_000, **options: int) -> Iterator[PassageIndex]:
    """Indexes over all items, each of about ``max_chars`` characters, which bounds what is broadcast; the driver holds one at a time."""
    rows = items.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / max_chars))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).orderBy("id").collect() if n > 1 else rows.orderBy("id").collect()
        yield PassageIndex([r[0] for r in part], [r[1] for r in part], **options)


SCHEMA = "doc_id long, item_id long, n_windows int, words int, edits int, shared_qgrams int, doc_at int, item_at int"


def leaked_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", **options: int) -> DataFrame:
    """One row per document and item of which a window stands in the document within the edits.

    ``n_windows`` verified windows; of the best one (fewest edits, then first in the document)
    its ``words``, ``edits``, ``shared_qgrams`` and its places in the normalised texts. NULL and
    empty texts hold nothing; items without a window of q characters are never found; of items
    and documents with equal texts each is reported.
    """
    spark, parts = docs.sparkSession, []
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    for index in index_blocks(items, item_id, text, **options):
        shared = spark.sparkContext.broadcast(index)
        del index

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                for a, b in chunks(texts):
                    r = ix.find(texts[a:b])
                    if not len(r["doc"]):
                        continue
                    order = np.lexsort((r["item_at"], r["doc_at"], r["edits"], r["item"], r["doc"]))
                    r = {k: v[order] for k, v in r.items()}
                    first = np.flatnonzero(np.r_[True, (np.diff(r["doc"]) != 0) | (np.diff(r["item"]) != 0)])
                    count = np.diff(np.r_[first, len(order)])
                    cols = [ids[a:b][r["doc"][first]], ix.ids[r["item"][first]], count, *[r[k][first] for k in ("words", "edits", "shared", "doc_at", "item_at")]]
                    kinds = [pa.int64()] * 2 + [pa.int32()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        parts.append(narrow.mapInArrow(scan, SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
