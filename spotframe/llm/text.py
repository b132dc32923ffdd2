"""Whole batches of texts as arrays of code points, with their Unicode classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LETTER, UPPER, DIGIT, MARK, FORMAT, PUNCT, SYMBOL, SPACE, OTHER = 1, 2, 3, 4, 5, 6, 7, 8, 0


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, by general category; white space by ``str.isspace``."""
    by = {"Lu": UPPER, "Lt": UPPER, "Mn": MARK, "Cf": FORMAT}
    first = {"L": LETTER, "N": DIGIT, "P": PUNCT, "S": SYMBOL}
    out = np.zeros(0x110000, "uint8")
    for i in range(0x110000):
        c = chr(i)
        k = unicodedata.category(c)
        if k != "Cn" and k != "Co":
            out[i] = SPACE if c.isspace() else by.get(k) or first.get(k[0], OTHER)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def chunks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with about ``most`` characters each; a longer text is alone in its range."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as words parted by single spaces, and where each begins.

    Words are the longest runs of letters and digits after NFKD, removal of combining marks and
    format characters, and lower-casing. Each text begins with a space, has one after every
    word, and ends with a NUL, so a run of whole words is found with its spaces.
    """
    classes = char_classes()
    parts = [(t if t.isascii() else unicodedata.normalize("NFKD", t)) if t else "" for t in texts]
    whole = "\0".join(p.replace("\0", " ") for p in parts) + "\0"
    cp = code_points(whole)
    if not whole.isascii():
        cls = classes[cp]
        cp = cp[(cls != MARK) & (cls != FORMAT)]
        whole = cp.tobytes().decode("utf-32-le", "surrogatepass")
        low = whole.lower()
        cp = code_points(low)
        cls = classes[cp]
        cp = cp[(cls != MARK) & (cls != FORMAT)] if len(low) != len(whole) else cp
    else:
        cp = code_points(whole.lower())
    cls = classes[cp]
    word = (cls >= LETTER) & (cls <= DIGIT)
    end = cp == 0
    # a space at the start of each text and after each word
    before = np.r_[False, word[:-1]]
    first = np.r_[True, end[:-1]]
    keep = word | end | before
    out = np.where(word, cp, np.where(end, 0, 32)).astype("uint32")
    extra = np.zeros(len(out), "int64")
    extra += first  # one space before the first character of a text
    extra += end & before  # and one between the last word and the NUL
    at = np.cumsum(extra + keep) - keep - 0
    size = int(extra.sum() + keep.sum())
    res = np.full(size, 32, "uint32")
    res[at[keep]] = out[keep]
    ends = np.flatnonzero(res == 0)
    starts = np.r_[0, ends + 1]
    return res, starts


def gram_hashes(cp: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling; element i is of ``cp[i:i+q]``."""
    base = 0x9E3779B97F4A7C15
    have = {1: (cp.astype("uint64") + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)}
    n = 1
    with np.errstate(over="ignore"):
        while n * 2 <= q:
            h, p = have[n], np.uint64(pow(base, n, 2**64))
            have[n * 2] = h[: len(h) - n] * p + h[n:] if len(h) > n else h[:0]
            n *= 2
        out, done = have[n], n
        while done < q:
            m = max(k for k in have if k <= q - done)
            p, tail = np.uint64(pow(base, m, 2**64)), have[m][done:]
            k = min(len(out), len(tail))
            out = out[:k] * p + tail[:k]
            done += m
        out = out ^ (out >> np.uint64(29))
        return out * np.uint64(0x94D049BB133111EB)
