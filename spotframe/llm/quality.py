"""Per-document text quality statistics and fixed-threshold rules with a reason per failure.

All counts are taken over whole Arrow batches at once: the texts become one array of code
points, their classes give the runs that are words, and lines and documents are sums over
ranges. Rules only compare those statistics with published or stated constants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotframe.llm.text import DIGIT, FORMAT, LETTER, PUNCT, SYMBOL, UPPER, char_classes, chunks, code_points

#: Characters that begin an entry of a list.
BULLETS = "•*-–—·◦▪‣●○"
#: Characters that end a sentence.
TERMINALS = ".!?…"
#: Latin-1 readings of UTF-8 bytes, as mangled texts show them.
MANGLED = "ÃÂâ€ï¿½™œ�"
#: Vowels of the four languages.
VOWELS = "aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüÿ"
#: Common words that also stand inside dates and names; they don't make a line a sentence.
BINDERS = ("de", "des", "du", "del", "of", "von", "y", "and", "et", "und", "la", "le", "los", "las")

_RANDOM = np.random.default_rng(7).integers(1, 2**63, 64, dtype="uint64") | np.uint64(1)


def _sums(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Sums of a 0/1 or number array over [starts[i], starts[i+1])."""
    c = np.r_[0, np.cumsum(values, dtype="int64")]
    return c[np.r_[starts[1:], size]] - c[starts]


def _word_hash(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each lower-cased word, from its characters and their places."""
    if not len(start):
        return np.zeros(0, "uint64")
    n = end - start
    at = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    c = cp[np.repeat(start, n) + at].astype("uint64") + np.uint64(0x9E37)
    with np.errstate(over="ignore"):
        c = (c * np.uint64(0x9E3779B97F4A7C15) ^ (c << np.uint64(31))) * _RANDOM[np.minimum(at, 63)]
        return np.add.reduceat(c, np.r_[0, np.cumsum(n)[:-1]]) + n.astype("uint64")


def hash_words(words: list[str]) -> np.ndarray:
    """Sorted hashes of words, as ``Lines`` looks them up."""
    text = " ".join(w.lower() for w in words)
    cp = code_points(text)
    cut = np.flatnonzero(cp == 32)
    return np.unique(_word_hash(cp, np.r_[0, cut + 1], np.r_[cut, len(cp)])) if words else np.zeros(0, "uint64")


class Lines:
    """Statistics of every line of a batch of texts; arrays have one element per line."""

    def __init__(self, texts: list[str | None], common: np.ndarray, binders: np.ndarray):
        cls_of = char_classes()
        whole = "\n".join((t or "").replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n") for t in texts) + "\n"
        cp = code_points(whole)
        hidden = cls_of[cp] == FORMAT  # invisible characters count for nothing and part no word
        if hidden.any():
            cp = cp[~hidden]
            whole = cp.tobytes().decode("utf-32-le", "surrogatepass")
        low = code_points(whole.lower())
        if len(low) != len(cp):  # a few capitals lower to two characters
            low = np.array([ord(c.lower()[0]) for c in whole], "uint32")
        size = len(cp)
        newline = cp == 10
        ends = np.flatnonzero(newline)
        starts = np.r_[0, ends[:-1] + 1]
        lengths = np.array([(t or "").replace("\r\n", "\n").count("\n") + (t or "").replace("\r\n", "\n").count("\r") + 1 for t in texts])
        self.doc = np.repeat(np.arange(len(texts)), lengths)
        cls = cls_of[cp]
        letter = (cls == LETTER) | (cls == UPPER) | (cls == 4)
        digit = cls == DIGIT
        space = (cp == 32) | (cp == 9) | (cp == 160) | newline | (cls == 8)
        solid = ~space
        per = lambda v: _sums(v, starts, size)
        self.start, self.chars, self.letters, self.digits = starts, per(solid), per(letter), per(digit)
        self.uppers, self.symbols, self.punct = per(cls == UPPER), per(cls == SYMBOL), per(cls == PUNCT)
        self.tabs, self.pipes, self.semis, self.commas = per(cp == 9), per(cp == 124), per(cp == 59), per(cp == 44)
        self.quoted = per((cp == 34) & np.r_[cp[1:] == 44, False])
        self.mangled = per(np.isin(cp, np.array([ord(c) for c in MANGLED], "uint32")))
        self.slashes = per(cp == 47)
        self.vowels = per(np.isin(low, np.array([ord(c) for c in VOWELS], "uint32")))
        self.dots = per((cp == 46) & np.r_[cp[1:] == 46, False] & np.r_[cp[2:] == 46, False, False])
        # runs of blanks inside a line
        blank = (cp == 32) | (cp == 160)
        gap = blank & np.r_[blank[1:], False] & ~np.r_[False, blank[:-1]]
        first_solid = np.minimum.reduceat(np.where(solid, np.arange(size), size), starts)
        self.gaps = per(gap & (np.arange(size) > np.repeat(first_solid, np.diff(np.r_[starts, size]))))
        # tokens: longest runs without white space
        t0 = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
        t1 = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
        tline = np.searchsorted(starts, t0, "right") - 1
        n_lines = len(starts)
        self.tokens = np.bincount(tline, minlength=n_lines)
        self.longest = np.zeros(n_lines, "int64")
        if len(t0):
            at = np.flatnonzero(np.r_[True, np.diff(tline) > 0])
            self.longest[tline[at]] = np.maximum.reduceat(t1 - t0, at)
        hexa = digit & (cp < 128) | (cp >= 97) & (cp <= 102)
        ch = np.r_[0, np.cumsum(hexa)]
        cd = np.r_[0, np.cumsum(digit)]
        self.hex4 = np.bincount(tline[(t1 - t0 == 4) & (ch[t1] - ch[t0] == 4)], minlength=n_lines)
        self.numeric = np.bincount(tline[cd[t1] - cd[t0] > 0], minlength=n_lines)
        cl = np.r_[0, np.cumsum(letter)]
        self.alphabetic = np.bincount(tline[cl[t1] - cl[t0] > 0], minlength=n_lines)
        # words: longest runs of letters (with marks)
        w0 = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        w1 = np.flatnonzero(letter & ~np.r_[letter[1:], False]) + 1
        wline = np.searchsorted(starts, w0, "right") - 1
        self.words = np.bincount(wline, minlength=n_lines)
        self.word_chars = np.bincount(wline, w1 - w0, n_lines).astype("int64")
        h = _word_hash(low, w0, w1)
        found = lambda s: s[np.minimum(np.searchsorted(s, h), len(s) - 1)] == h if len(s) else np.zeros(len(h), "bool")
        is_common = found(common)
        self.common = np.bincount(wline[is_common], minlength=n_lines)
        self.joining = np.bincount(wline[is_common & ~found(binders)], minlength=n_lines)
        met = np.zeros((len(texts), max(len(common), 1)), "bool")
        met[self.doc[wline[is_common]], np.searchsorted(common, h[is_common])] = True
        self.distinct_common = met.sum(1)
        self.capital = np.bincount(wline[cls[w0] == UPPER], minlength=n_lines)
        self.single = np.bincount(wline[w1 - w0 == 1], minlength=n_lines)
        # the first token and the last character
        first = np.full(n_lines, 0)
        has = self.tokens > 0
        k = np.searchsorted(t0, starts)
        first[has] = k[has]
        f0, f1 = np.where(has, t0[np.minimum(first, max(len(t0) - 1, 0))] if len(t0) else 0, 0), np.where(has, t1[np.minimum(first, max(len(t1) - 1, 0))] if len(t1) else 0, 0)
        self.first_cp = np.where(has, cp[np.minimum(f0, size - 1)], 0)
        n_first = f1 - f0
        tail = np.where(has, cp[np.maximum(f1 - 1, 0)], 0)
        close = np.isin(tail, np.array([ord(c) for c in ".)]:"], "uint32"))
        inner = n_first - close - np.isin(self.first_cp, np.array([ord("("), ord("["), 167], "uint32"))
        fl = np.r_[0, np.cumsum(letter)]
        self.numbered = has & ((cd[f1] - cd[f0] > 0) & (cd[f1] - cd[f0] + (np.r_[0, np.cumsum(cp == 46)][f1] - np.r_[0, np.cumsum(cp == 46)][f0]) >= inner) | close & (inner == 1) & (fl[f1] - fl[f0] == 1) & np.isin(tail, np.array([41], "uint32")))
        self.bulleted = has & (n_first == 1) & np.isin(self.first_cp, np.array([ord(c) for c in BULLETS], "uint32")) & (self.tokens > 1)
        last_solid = np.maximum.reduceat(np.where(solid, np.arange(size), -1), starts)
        self.last_cp = np.where(has, cp[np.maximum(last_solid, 0)], 0)
        self.terminal = np.isin(self.last_cp, np.array([ord(c) for c in TERMINALS], "uint32"))
        with np.errstate(over="ignore"):
            weight = cp.astype("uint64") * (np.uint64(0x9E3779B97F4A7C15) * (np.arange(size) - np.repeat(starts, np.diff(np.r_[starts, size]))).astype("uint64") + np.uint64(0xBF58476D1CE4E5B9))
            self.key = np.add.reduceat(np.where(newline, np.uint64(0), weight * weight), starts)

    def kinds(self) -> np.ndarray:
        """Kind of each line by fixed thresholds: prose, list, table, junk, heading, or none of them."""
        n = np.maximum(self.chars, 1)
        full = self.chars > 0
        # place among the non-empty lines of its document
        k = np.cumsum(full)
        first = np.flatnonzero(np.r_[True, np.diff(self.doc) > 0])
        place = k - (k[first] - full[first])[self.doc]
        place = np.where(full, place, 0)
        docket = full & (place == 2) & (self.slashes >= 1) & (self.chars < 40) & (self.tokens <= 6) & (self.last_cp >= 48) & (self.last_cp <= 57)
        named = np.zeros(self.doc[-1] + 1 if len(self.doc) else 0, "bool")
        named[self.doc[docket]] = True
        heading = docket | (full & (place == 1) & named[self.doc])
        edge = np.isin(self.first_cp, np.array([42, 45], "uint32")) & (self.first_cp == self.last_cp) & (self.tokens >= 3) & (self.digits > 0)
        heading |= edge | (full & (self.slashes >= 2) & (self.gaps >= 1) & (self.words <= 4) & (self.chars < 40))
        # sentences have joining words; an entry's letter in brackets is not one
        letter = self.numbered & (self.digits + self.letters > 0) & ~((self.first_cp >= 48) & (self.first_cp <= 57)) & (self.single > 0)
        joining = np.maximum(self.joining - letter, 0) / np.maximum(self.words - letter, 1)
        prose = (self.words >= 5) & (joining >= 0.1)
        table = (self.tabs >= 2) | ((self.pipes >= 3) & (self.first_cp == 124) & (self.vowels > 0)) | ((self.pipes >= 3) & (self.first_cp == 124) & (self.letters == 0))
        table |= (self.semis >= 2) & (self.numeric >= 1) & (joining < 0.15) | (self.quoted >= 1) & (self.first_cp == 34)
        table |= (self.gaps >= 1) & (self.numeric >= 1) & (joining < 0.2) | (self.dots >= 5) & (self.numeric >= 1) & (joining < 0.1)
        speechless = (self.letters >= 8) & (self.vowels < 0.15 * self.letters)
        junk = ((self.letters + self.digits) < 0.3 * n) | (self.longest >= 30) & (self.tokens <= 3) | (self.hex4 >= 0.6 * self.tokens) & (self.tokens >= 3)
        junk |= (self.mangled >= 0.15 * n) | speechless
        loose = (self.words >= 6) & (joining < 0.05) & (self.punct + self.symbols + self.digits <= 0.04 * n)
        menu = full & (self.symbols >= 1) & (self.words >= 1) & (self.words <= 6) & (self.joining == 0) & ~self.bulleted & ~self.numbered
        entry = (self.bulleted | self.numbered) & ~prose & (self.chars < 110)
        names = (self.commas >= 4) & (self.words <= 4.5 * (self.commas + 1)) & (joining < 0.08)
        bare = full & (self.words >= 1) & (self.words <= 5) & (self.joining == 0) & (self.capital >= 0.5 * self.words) & (self.digits == 0)
        kind = np.select([~full, heading, table & ~speechless, junk | menu, entry | names, prose, loose], ["", "heading", "table", "junk", "list", "prose", "junk"], "")
        # lines that a document repeats are filler, whatever they say
        k, d = self.key[full], self.doc[full]
        order = np.lexsort((k, d))
        at = np.flatnonzero(np.r_[True, (np.diff(d[order]) != 0) | (np.diff(k[order]) != 0)]) if len(d) else np.zeros(0, "int64")
        size = np.diff(np.r_[at, len(d)])
        times = np.zeros(len(d), "int64")
        times[order] = np.repeat(size, size)
        filler, self.repeated = np.zeros(len(n), "bool"), np.zeros(len(n), "bool")
        self.repeated[full] = times >= 2
        filler[full] = (times >= 4) & np.isin(kind[full], ["", "prose"]) | (times >= 2) & (kind[full] == "")
        kind[filler] = "junk"
        # three or more bare names in a row are a list without marks
        f = np.flatnonzero(full)
        b = bare[f] & (kind[f] == "")
        run = np.cumsum(np.r_[True, (b[1:] != b[:-1]) | (self.doc[f][1:] != self.doc[f][:-1])]) if len(f) else np.zeros(0, "int64")
        length = np.bincount(run)[run] if len(f) else run
        kind[f[b & (length >= 3)]] = "list"
        return kind


STATS = "n_chars long, n_lines long, n_words long, mean_word_length double, symbol_ratio double, digit_share double, upper_share double, alpha_share double, terminal_share double, bullet_share double, ellipsis_share double, common_share double, n_stop_words long, short_line_share double, repeated_char_share double, list_share double, table_share double, junk_share double"

#: Rule name, statistic, lowest and highest value that pass. From the quality rules of
#: Rae et al. 2021 (MassiveText): words, word length, symbols to words, bullets, ellipses, tokens with
#: a letter, two different stop words. From Penedo et al. 2024 (FineWeb): lines that end in
#: punctuation, short lines, characters in repeated lines. List, table and junk: "more than half".
RULES = (
    ("too_few_words", "n_words", 50, None),
    ("too_many_words", "n_words", None, 100_000),
    ("word_length_low", "mean_word_length", 3.0, None),
    ("word_length_high", "mean_word_length", None, 10.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("bullets", "bullet_share", None, 0.9),
    ("ellipses", "ellipsis_share", None, 0.3),
    ("few_alphabetic_tokens", "alpha_share", 0.8, None),
    ("few_stop_words", "n_stop_words", 2, None),
    ("few_terminal_lines", "terminal_share", 0.12, None),
    ("short_lines", "short_line_share", None, 0.67),
    ("repeated_lines", "repeated_char_share", None, 0.1),
    ("list", "list_share", None, 0.5),
    ("table", "table_share", None, 0.5),
    ("junk", "junk_share", None, 0.5),
)


def _stats(texts: list[str | None], common: np.ndarray, binders: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text, as sums over its lines."""
    lines = Lines(texts, common, binders)
    size = len(texts)
    total = lambda v: np.bincount(lines.doc, v, size)
    chars, words = total(lines.chars), total(lines.words)
    full = lines.chars > 0
    n_lines = total(full)
    kinds = lines.kinds()
    body = total(np.where(kinds == "heading", 0, lines.chars))
    safe = lambda a, b: a / np.maximum(b, 1)
    out = {
        "n_chars": chars.astype("int64"),
        "n_lines": n_lines.astype("int64"),
        "n_words": words.astype("int64"),
        "mean_word_length": safe(total(lines.word_chars), words),
        "symbol_ratio": safe(total(lines.symbols), words),
        "digit_share": safe(total(lines.digits), chars),
        "upper_share": safe(total(lines.uppers), total(lines.letters)),
        "alpha_share": safe(total(lines.alphabetic), total(lines.tokens)),
        "terminal_share": safe(total(lines.terminal & full), n_lines),
        "bullet_share": safe(total(lines.bulleted & full), n_lines),
        "ellipsis_share": safe(total((lines.dots > 0) & full), n_lines),
        "common_share": safe(total(lines.common), words),
        "n_stop_words": lines.distinct_common.astype("int64"),
        "short_line_share": safe(total(full & (lines.chars <= 30)), n_lines),
        "repeated_char_share": safe(total(np.where(lines.repeated, lines.chars, 0)), chars),
    }
    for k in ("list", "table", "junk"):
        out[f"{k}_share"] = safe(total(np.where(kinds == k, lines.chars, 0)), body)
    return out


def text_quality(docs: DataFrame, common_words: DataFrame, doc_id: str = "doc_id", text: str = "text", word: str = "word", binders: tuple[str, ...] = BINDERS, most_words: int = 100_000) -> DataFrame:
    """One row per document: its statistics, ``reasons`` (names of the failed rules), ``kind``.

    ``kind`` is ``list``, ``table`` or ``junk`` where more than half of the characters outside
    heading and page lines are of that kind, else NULL. NULL and empty texts have zero counts,
    fail ``too_few_words`` and have no kind; invisible (format) characters count for nothing. Whole texts are read; nothing is shuffled. The
    common words are a dictionary, not data: more than ``most_words`` of them is an error.
    """
    rows = common_words.select(F.lower(word).alias("w")).where("w IS NOT NULL").distinct().limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common, binding = hash_words(sorted(r[0] for r in rows)), hash_words(list(binders))
    fields = [x.split() for x in STATS.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 500_000):
                s = _stats(texts[a:b], common, binding)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(s[n], kinds[k]) for n, k in fields]], names=["doc_id", *[n for n, _ in fields]])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stats = narrow.mapInArrow(scan, f"doc_id long, {STATS}")
    failed = []
    for name, stat, low, high in RULES:
        bad = F.col(stat) < low if low is not None else F.col(stat) > high
        failed.append(F.when(bad, F.lit(name)))
    kind = F.coalesce(*[F.when(F.col(f"{k}_share") > 0.5, F.lit(k)) for k in ("list", "table", "junk")])
    return stats.withColumn("reasons", F.array_compact(F.array(*failed))).withColumn("kind", kind)
