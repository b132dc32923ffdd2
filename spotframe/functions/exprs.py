"""Scalar expressions: calibration, ids, scores, text, sequences and geometry."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, else the value."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def zero_filled(c: Column) -> Column:
    """0 for NULL, NaN and infinities, else the value."""
    return F.coalesce(finite(c), F.lit(0.0))


def equivalent_diameter(volume: Column) -> Column:
    """Diameter of the sphere of a volume; 0 at or below 0, NULL for NULL."""
    return F.when(volume > 0, F.pow(volume * F.lit(6.0 / math.pi), F.lit(1.0 / 3.0))).when(volume.isNotNull(), 0.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else NULL."""
    return F.when(den > 0, num / den)


def spot_id(fov: Column, marker: Column, label: Column) -> Column:
    return F.format_string("fov%03d_%s_%d", fov, marker, label)


def nucleus_id(fov: Column, nucleus: Column) -> Column:
    return F.format_string("fov%03d_n%d", fov, nucleus)


def range_score(x: Column, low: float, high: float) -> Column:
    """1 inside [low, high]; (x / low)^1.5 below, high / x above, 0 at or below 0."""
    return F.when(x <= 0, 0.0).when(x < low, F.pow(x / F.lit(float(low)), F.lit(1.5))).when(x > high, F.lit(float(high)) / x).when(x.isNotNull(), 1.0)


def bump_score(x: Column, low: float, high: float, decades: float = 1.0) -> Column:
    """1 inside [low, high], falling linearly per decade of log10 outside; 0 at or below 0."""
    fall = lambda r: F.greatest(F.lit(0.0), 1 - F.log10(r) / F.lit(float(decades)))
    return F.when(x <= 0, 0.0).when(x < low, fall(F.lit(float(low)) / x)).when(x > high, fall(x / F.lit(float(high)))).when(x.isNotNull(), 1.0)


def slug(c: Column) -> Column:
    """Lower-case, runs of other characters than a-z and 0-9 as one ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(c: Column) -> Column:
    """Distinct ``[a-z0-9]+`` tokens of the lower-cased text; empty for NULL."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def headings(c: Column) -> Column:
    """Texts of Markdown headings."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^#{1,6}\s*(.+)$"), F.lit(1))


def snippet(c: Column, n: int) -> Column:
    """White space squeezed, pipes escaped, cut to n characters with an ellipsis."""
    flat = F.replace(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def reverse_complement(s: Column) -> Column:
    """Of a nucleotide string, letter case kept; other letters stay as they are."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def masked(seq: Column, start: Column, end: Column) -> Column:
    """``seq`` with the 1-based inclusive range as ``n``; ranges outside the sequence change nothing."""
    a, b = F.greatest(start, F.lit(1)), F.least(end, F.length(seq))
    return F.when(a <= b, F.concat(F.substr(seq, F.lit(1), a - 1), F.repeat(F.lit("n"), b - a + 1), F.substr(seq, b + 1))).otherwise(seq)


def plate(readout: Column, wells: int = 96) -> Column:
    """Number of the plate that holds a readout, from 1."""
    return F.ceil(readout / F.lit(wells))


#: Saturation and lightness of hub colours.
SATURATION, LIGHTNESS = 0.62, 0.48


def hub_colour(i: Column) -> Column:
    """``r,g,b`` of hub i (from 0): hues by the golden angle, halves rounded up."""
    hue = F.pmod(i * F.lit(137.508), F.lit(360.0))
    a = SATURATION * min(LIGHTNESS, 1 - LIGHTNESS)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hue / 30.0, F.lit(12.0))
        return F.floor((F.lit(LIGHTNESS) - F.lit(a) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255 + 0.5).cast("int")

    return F.concat_ws(",", channel(0), channel(8), channel(4))


def readout_handle(seq: Column) -> Column:
    """The reverse complement of a readout's first 20 letters."""
    return reverse_complement(F.substring(seq, 1, 20))


def monomials(x: Column, y: Column, z: Column, degree: int = 3) -> Column:
    """All monomials of three coordinates up to a degree (20 for degree 3), by total degree."""
    out = []
    for n in range(degree + 1):
        for i in range(n, -1, -1):
            for j in range(n - i, -1, -1):
                out.append(reduce(lambda a, b: a * b, [x] * i + [y] * j + [z] * (n - i - j), F.lit(1.0)))
    return F.array(*out)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Linear stretch of [low, high] to 0..255 as INT; 0 where the range is empty."""
    return F.when(high > low, F.rint(F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255)).otherwise(0).cast("int")


def wavelengths(name: Column) -> Column:
    """Three-digit numbers from 300 to 850 in a file name; two or more tell the channels."""
    return F.filter(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: (F.length(x) == 3) & (x >= "300") & (x <= "850"))


def coarse_cuts(cuts: Column) -> Column:
    """Every 32nd of ascending cuts, made once per group for ``slot_of``."""
    return F.filter(cuts, lambda _, i: (i + 1) % 32 == 0)


def slot_of(coarse: Column, cuts: Column, x: Column, inclusive: bool = False) -> Column:
    """How many of the ascending ``cuts`` lie below ``x`` (or at it); 0 for NULL cuts.

    The coarse cuts first, then the 32 in between, so 1,000 cuts take about 64 comparisons.
    """
    below = (lambda y: y <= x) if inclusive else (lambda y: y < x)
    n = F.size(F.filter(coarse, below))
    fine = F.size(F.filter(F.slice(cuts, n * 32 + 1, F.lit(32)), below))
    return F.when(cuts.isNull(), 0).otherwise(n * 32 + fine).cast("int")
